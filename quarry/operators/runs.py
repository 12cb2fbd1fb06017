"""Runs as tables: leaderboard, comparison, regressions and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WARN_MARGIN = 0.02
HEADLINE = ("recall_at_5", "mrr", "ndcg_at_10")


def leaderboard(runs: DataFrame, metrics: DataFrame, dataset: str, names: tuple[str, ...] = HEADLINE) -> DataFrame:
    """One row for each run (run_id, name, created_at, generation_hash), newest first, with value and interval of each
    metric of the set (run_id, dataset, metric, value, lo, hi, n); a run without it has n 0."""
    of_set = metrics.where((F.col("dataset") == dataset) & F.col("metric").isin(*names))
    columns = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(m if c == "value" else f"{m}_{c}") for m in names for c in ("value", "lo", "hi")]
    wide = of_set.groupBy("run_id").agg(F.max("n").alias("n"), *columns)
    return runs.join(wide, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.desc("created_at"), "run_id")


def compare(runs: DataFrame, metrics: DataFrame, base: str, cand: str, dataset: str, names: tuple[str, ...] = HEADLINE) -> DataFrame:
    """metric, base, cand, delta, status: CONFOUNDED, and no numbers, where the generators differ."""
    one = lambda run, name: metrics.where((F.col("run_id") == run) & (F.col("dataset") == dataset) & F.col("metric").isin(*names)).select("metric", F.col("value").alias(name))
    both = one(base, "base").join(one(cand, "cand"), "metric", "full")
    hashes = runs.where(F.col("run_id").isin(base, cand)).agg(F.count_distinct("generation_hash").alias("generators"))
    out = both.join(hashes)
    same = F.col("generators") == 1
    number = lambda c: F.when(same, c)
    return out.select("metric", number(F.col("base")).alias("base"), number(F.col("cand")).alias("cand"), number(F.round(F.col("cand") - F.col("base"), 6)).alias("delta"), F.when(same, F.lit("OK")).otherwise(F.lit("CONFOUNDED")).alias("status"))


def gold_rank(retrieved: str, gold: str) -> F.Column:
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(F.col(gold), x), i + 1)), lambda p: p.isNotNull())
    return F.array_min(places)


def regressed_items(base: DataFrame, cand: DataFrame, metric: str) -> DataFrame:
    """Items that score lower in the candidate, worst first (item_id, question, retrieved, gold, and the metric)."""
    side = lambda df, name: df.select("item_id", F.col(metric).alias(f"{name}_value"), gold_rank("retrieved", "gold").alias(f"{name}_gold_rank"), *(["question"] if name == "base" else []))
    both = side(base, "base").join(side(cand, "cand"), "item_id").where(F.col("cand_value") < F.col("base_value"))
    out = both.withColumns({"metric": F.lit(metric), "delta": F.round(F.col("cand_value") - F.col("base_value"), 6)})
    return out.select("item_id", "question", "metric", "base_value", "cand_value", "delta", "base_gold_rank", "cand_gold_rank").orderBy("delta", "item_id")


def gate(thresholds: DataFrame, values: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """metric, verdict, value, floor, baseline, note of thresholds (metric, floor, tolerance) on values (metric, value).

    In this order: no value fails, below the floor fails, no baseline passes,
    below baseline less tolerance fails, above it by the margin warns."""
    joined = thresholds.join(values.select("metric", "value"), "metric", "left")
    if baseline is None:
        joined = joined.withColumn("baseline", F.lit(None).cast("double"))
    else:
        joined = joined.join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "left")
    v, b = F.col("value"), F.col("baseline")
    case = (
        F.when(v.isNull(), "missing")
        .when(v < F.col("floor"), "floor")
        .when(b.isNull(), "no baseline")
        .when(v < b - F.col("tolerance"), "regressed")
        .when(v > b + WARN_MARGIN, "improved")
        .otherwise("steady")
    )
    verdict = F.when(F.col("note").isin("missing", "floor", "regressed"), "FAIL").when(F.col("note") == "improved", "WARN").otherwise("PASS")
    return joined.withColumn("note", case).withColumn("verdict", verdict).select("metric", "verdict", "value", "floor", "baseline", "note")


def gate_verdict(results: DataFrame) -> DataFrame:
    """The worst verdict of all."""
    worst = F.max(F.when(F.col("verdict") == "FAIL", 2).when(F.col("verdict") == "WARN", 1).otherwise(0))
    return results.agg(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.coalesce(worst, F.lit(0)) + 1).alias("verdict"))


def gate_markdown(dataset: str, rows: list) -> str:
    number = lambda x: "-" if x is None else f"{x:.3f}"
    worst = next((v for v in ("FAIL", "WARN") if any(r["verdict"] == v for r in rows)), "PASS")
    table = [f"| {r['metric']} | {number(r['value'])} | {r['floor']:.3f} | {number(r['baseline'])} | {r['verdict']} | {r['note']} |" for r in rows]
    return "\n".join([f"## Eval gate: {worst} ({dataset})", "", "| metric | value | floor | baseline | verdict | note |", "|---|---|---|---|---|---|", *table])


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"))))
