"""Task time of named stages of a plan, from Spark's own metrics.

Catalyst would run stages together, so each is written before the next is built.
Its jobs have a group of their own; what their tasks took is read from Spark's
status store, which is there with and without the UI."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from quarry import scratch


def _run_time(store, stage: int) -> int:
    """Milliseconds of a stage's last attempt; 0 where the store keeps nothing of it (``spark.ui.retainedStages``)."""
    try:
        return store.lastStageAttempt(stage).executorRunTime()
    except Py4JJavaError as gone:
        if "NoSuchElement" not in str(gone.java_exception):
            raise
        return 0


def task_seconds(spark: SparkSession, group: str) -> float:
    """What all tasks of a job group took together, in seconds; a stage that several jobs share counts once."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs, stages = store.jobsList(None), set()
    for i in range(jobs.size()):
        job = jobs.apply(i)
        if job.jobGroup().isDefined() and job.jobGroup().get() == group:
            ids = job.stageIds()
            stages |= {int(ids.apply(k)) for k in range(ids.size())}
    return sum(_run_time(store, s) for s in stages) / 1000


class StageTimes:
    """Seconds of task time and rows of each stage, in the order in which they ran."""

    def __init__(self, spark: SparkSession):
        self.spark, self.run = spark, uuid.uuid4().hex
        self.seconds: dict[str, float] = {}
        self.rows: dict[str, int] = {}

    def group(self, name: str) -> str:
        return f"{self.run}-{name}"

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table that ``make`` plans, written; what it does while it plans counts as well."""
        context = self.spark.sparkContext
        before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
        context.setJobGroup(self.group(name), f"stage {name}")
        try:
            out = scratch.written(make(), name)
            self.rows[name] = out.count()
        finally:
            for k, v in before.items():
                context.setLocalProperty(k, v)
        self.spark._jsc.sc().listenerBus().waitUntilEmpty(120_000)
        self.seconds[name] = task_seconds(self.spark, self.group(name))
        return out

    def to_dict(self) -> dict[str, dict[str, float]]:
        return {name: {"task_seconds": round(s, 3), "rows": self.rows[name]} for name, s in self.seconds.items()}
