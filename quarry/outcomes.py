"""Calls of a model that are made once: outcomes in a table by what was asked, so that a run goes on where one broke off.

A call's key is a hash over model, settings and text. What the table holds is not
asked again; equal texts are asked once. The rest goes out in waves of ``WAVE``
calls, a job each, and a wave that is through is in the table, whatever becomes
of the next. A task asks again when a service is busy, after as long as the
service says, else after 2, 4, 8 ... seconds; what fails for good is an outcome
too, with its reason, and the next run asks for it again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.providers import LanguageModel

OUTCOME = "call string, said string, error string, tries int, at double"
WAVE = 20_000
TRIES = 5
LONGEST = 120.0  # seconds that a service may ask a task to wait


class Busy(Exception):
    """A service that asks for patience: seconds, where it says how long."""

    def __init__(self, retry_after: float | str | None = None):
        super().__init__("the service is busy")
        self.retry_after = seconds(retry_after)


def seconds(header: float | str | None) -> float | None:
    """A Retry-After header in seconds; none where it has no number."""
    try:
        return None if header is None else max(0.0, float(header))
    except ValueError:
        return None


def patient(call: Callable[[], str], tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """What a call says, or why it fails, and how often it was tried."""
    for n in range(1, tries + 1):
        try:
            return call(), None, n
        except Busy as busy:
            pause = 2.0**n if busy.retry_after is None else busy.retry_after
            why = str(busy)
            if pause > LONGEST:
                return None, f"{why} for {pause:g} seconds", n
            if n < tries:
                wait(pause)
        except Exception as failed:  # noqa: BLE001  the reason is the outcome
            return None, f"{type(failed).__name__}: {failed}", n
    return None, why, tries


@dataclass
class Outcomes:
    """The table at ``root``. ``make`` builds the model in a task; ``identity`` names model and settings."""

    spark: SparkSession
    root: str
    make: Callable[[], LanguageModel]
    identity: str
    system: str = ""
    temperature: float = 0.0
    max_tokens: int = 1024
    tries: int = TRIES
    wait: Callable[[float], None] = time.sleep
    wave: int = WAVE

    def key(self, text: Column) -> Column:
        settings = f"{self.identity}|{self.temperature}|{self.max_tokens}|{self.system}"
        return F.sha2(F.concat_ws("\n", F.lit(settings), text), 256)

    def table(self) -> DataFrame:
        """All outcomes, failed ones too: a row for each call of each run."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_SUCCESS")
        there = files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files)
        return self.spark.read.schema(OUTCOME).parquet(self.root) if there else self.spark.createDataFrame([], OUTCOME)

    def known(self) -> DataFrame:
        """call, said: the last words of each call that has any."""
        return self.table().where("said is not null").groupBy("call").agg(F.max_by("said", "at").alias("said"))

    def _asked(self, missing: DataFrame) -> DataFrame:
        make, tries, wait = self.make, self.tries, self.wait
        first = [{"role": "system", "content": self.system}] if self.system else []
        settings = {"temperature": self.temperature, "max_tokens": self.max_tokens}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            for b in batches:
                rows = []
                for call, text in zip(b["call"], b["text"], strict=True):
                    said, error, n = patient(lambda: model.complete([*first, {"role": "user", "content": text}], **settings).content, tries, wait)  # noqa: B023
                    rows.append((call, said, error, n, time.time()))
                yield pd.DataFrame(rows, columns=["call", "said", "error", "tries", "at"])

        return missing.mapInPandas(run, OUTCOME)

    def complete(self, rows: DataFrame, asked: str, out: str) -> DataFrame:
        """Adds ``out``, what the model says to column ``asked``; null where that is null, or where it has failed."""
        texts = rows.where(F.col(asked).isNotNull()).select(self.key(F.col(asked)).alias("call"), F.col(asked).alias("text"))
        missing = texts.groupBy("call").agg(F.first("text").alias("text")).join(self.known(), "call", "left_anti")
        waves = -(-missing.count() // self.wave)
        for i in range(waves):
            now = missing.where(F.pmod(F.xxhash64("call"), F.lit(waves)) == i)
            self._asked(now).write.mode("append").parquet(self.root)
        answered = self.known().withColumnRenamed("said", out)
        return rows.withColumn("call", self.key(F.col(asked))).join(answered, "call", "left").drop("call")

    def failures(self) -> DataFrame:
        """call, error: the last reason of each call that has no words yet."""
        failed = self.table().where("said is null").groupBy("call").agg(F.max_by("error", "at").alias("error"))
        return failed.join(self.known(), "call", "left_anti")
