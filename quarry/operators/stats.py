"""Bootstrap intervals, by Python's generator for equal numbers and by hashes."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import scratch
from quarry.sources import draws

RESAMPLES, ALPHA = 1000, 0.05
UNIT = 1e-12  # values are summed in whole units


def _bounds(n: int, alpha: float) -> tuple[int, int]:
    clamp = lambda i: max(0, min(i, n - 1))
    return clamp(int(alpha / 2 * n)), clamp(int((1 - alpha / 2) * n) - 1)


def bootstrap_interval(values: Sequence[float], n: int = RESAMPLES, seed: int = 0, alpha: float = ALPHA) -> tuple[float, float]:
    """Percentile interval of the mean; indices come from random.Random(seed), one draw a value."""
    if len(values) < 2:
        return (values[0], values[0]) if len(values) else (0.0, 0.0)
    draw, size = random.Random(seed).randrange, len(values)
    means = sorted(sum(values[draw(size)] for _ in range(size)) / size for _ in range(n))
    low, high = _bounds(n, alpha)
    return means[low], means[high]


def paired_win_rate(base: Sequence[float], cand: Sequence[float], n: int = RESAMPLES, seed: int = 0) -> float:
    """How often the candidate's resampled mean is larger, over the same items."""
    if len(base) != len(cand):
        raise ValueError("base and candidate must have the same items")
    if not base:
        return 0.0
    draw, size, wins = random.Random(seed).randrange, len(base), 0
    for _ in range(n):
        picked = [draw(size) for _ in range(size)]
        wins += sum(cand[i] for i in picked) / size > sum(base[i] for i in picked) / size
    return wins / n


def _resampled(values: DataFrame, n: int, seed: int, columns: tuple[str, ...]) -> DataFrame:
    """dataset, metric, size, b and each column's sum over resample ``b``, in units of ``UNIT``.

    Draws depend on the number of values alone, so metrics of one set share
    theirs. The different sizes, a few, are brought to the driver. Sums are of
    whole units: they do not depend on the order in which Spark adds."""
    group = ["dataset", "metric"]
    order = Window.partitionBy(*group).orderBy("item_id")
    units = [F.round(F.col(c) / UNIT).cast("decimal(24,0)").alias(c) for c in columns]
    placed = values.select(*group, (F.row_number().over(order) - 1).cast("long").alias("place"), F.count("*").over(Window.partitionBy(*group)).alias("size"), *units)
    placed = scratch.written(placed, "placed")
    sizes = [r["size"] for r in placed.select("size").distinct().collect()]
    drawn = draws.read(values.sparkSession, sizes, n, seed).join(placed, ["size", "place"])
    return drawn.groupBy(*group, "size", "b").agg(*(F.sum(F.col(c) * F.col("c").cast("decimal(10,0)")).alias(c) for c in columns))


def bootstrap_ci(values: DataFrame, n: int = RESAMPLES, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """dataset, metric, lo, hi of long metrics (dataset, metric, item_id, value), items in id order.

    The numbers are those of ``bootstrap_interval``, to six places: the draws are
    read from the generator's table and Spark sums them. One value is its own
    interval; a null value counts nothing; no values give no rows."""
    sums = _resampled(values, n, seed, ("value",))
    low, high = _bounds(n, alpha)
    nth = F.row_number().over(Window.partitionBy("dataset", "metric").orderBy("value", "b"))
    mean = F.col("value").cast("double") / (F.col("size") / F.lit(UNIT))
    at = lambda i: F.round(F.max(F.when(F.col("nth") == i + 1, mean)), 6)
    return sums.withColumn("nth", nth).groupBy("dataset", "metric").agg(at(low).alias("lo"), at(high).alias("hi"))


def paired_bootstrap(pairs: DataFrame, n: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """dataset, metric, p_better of (dataset, metric, item_id, base, cand): ``paired_win_rate`` of each metric."""
    sums = _resampled(pairs, n, seed, ("base", "cand"))
    return sums.groupBy("dataset", "metric").agg(F.round(F.avg((F.col("cand") > F.col("base")).cast("double")), 6).alias("p_better"))


def _drawn(values: DataFrame, n: int, seed: int, columns: tuple[str, ...]) -> DataFrame:
    """Each group's resamples: the value that stands at a hashed place. dataset, metric, b, slot, columns."""
    order = Window.partitionBy("dataset", "metric").orderBy("item_id")
    placed = values.withColumns({"place": F.row_number().over(order) - 1, "size": F.count("*").over(Window.partitionBy("dataset", "metric"))})
    slots = placed.select("dataset", "metric", "size", F.col("place").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    digest = F.sha2(F.concat_ws("-", F.lit(str(seed)), F.col("b").cast("string"), F.col("slot").cast("string")), 256)
    slots = slots.withColumn("place", F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("size")).cast("int"))
    return slots.join(placed.select("dataset", "metric", "place", *columns), ["dataset", "metric", "place"])


def bootstrap_ci_hash(values: DataFrame, n: int = 200, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """dataset, metric, lo, hi with indices from SHA-256 of seed, resample and slot: the same in any SQL engine."""
    means = _drawn(values, n, seed, ("value",)).groupBy("dataset", "metric", "b").agg(F.round(F.avg("value"), 6).alias("mean"))
    low, high = _bounds(n, alpha)
    nth = F.row_number().over(Window.partitionBy("dataset", "metric").orderBy("mean", "b"))
    return means.withColumn("nth", nth).groupBy("dataset", "metric").agg(F.max(F.when(F.col("nth") == low + 1, F.col("mean"))).alias("lo"), F.max(F.when(F.col("nth") == high + 1, F.col("mean"))).alias("hi"))


def paired_bootstrap_hash(pairs: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """dataset, metric, p_better of (dataset, metric, item_id, base, cand)."""
    sums = _drawn(pairs, n, seed, ("base", "cand")).groupBy("dataset", "metric", "b").agg(F.round(F.sum("base"), 6).alias("base"), F.round(F.sum("cand"), 6).alias("cand"))
    return sums.groupBy("dataset", "metric").agg(F.round(F.avg((F.col("cand") > F.col("base")).cast("double")), 6).alias("p_better"))
