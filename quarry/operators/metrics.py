"""Retrieval metrics of whole result sets, and their confidence intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5, 10)


def hit_places(retrieved: Column, gold: Column) -> Column:
    """Places, from 1, of gold in what was retrieved; a document that comes twice counts once."""
    place = lambda x, i: F.when(F.array_contains(gold, x) & (F.array_position(retrieved, x) == i + 1), i + 1)
    return F.filter(F.transform(retrieved, place), lambda p: p.isNotNull())


def _upto(hits: Column, k: int) -> Column:
    return F.filter(hits, lambda p: p <= k)


def recall_at(hits: Column, n_gold: Column, k: int) -> Column:
    return F.when(n_gold == 0, F.lit(0.0)).otherwise(F.size(_upto(hits, k)) / n_gold)


def precision_at(hits: Column, n_retrieved: Column, k: int) -> Column:
    """Over what was retrieved, which may be less than k."""
    return F.when(n_retrieved == 0, F.lit(0.0)).otherwise(F.size(_upto(hits, k)) / F.least(n_retrieved, F.lit(k)))


def hit_rate_at(hits: Column, k: int) -> Column:
    return F.coalesce((F.array_min(hits) <= k).cast("double"), F.lit(0.0))


def reciprocal_rank(hits: Column) -> Column:
    return F.coalesce(1 / F.array_min(hits).cast("double"), F.lit(0.0))


def ndcg_at(hits: Column, n_gold: Column, k: int) -> Column:
    dcg = F.aggregate(_upto(hits, k), F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1.0))
    ideal = [0.0]
    for r in range(1, k + 1):
        ideal.append(ideal[-1] + 1 / math.log2(r + 1))
    best = F.element_at(F.array(*map(F.lit, ideal)), F.least(F.lit(k), n_gold) + 1)
    return F.when(n_gold == 0, F.lit(0.0)).otherwise(dcg / best)


def score_items(items: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """``items`` (…, retrieved, gold) with mrr and recall_at_k, precision_at_k, hit_rate_at_k, ndcg_at_k, to six places.

    The places of gold are found once; all metrics are read from them."""
    sized = items.withColumns({"__hits": hit_places(F.col("retrieved"), F.col("gold")), "__gold": F.size("gold"), "__found": F.size(F.array_distinct("retrieved"))})
    h, g, n = F.col("__hits"), F.col("__gold"), F.col("__found")
    columns = {"mrr": reciprocal_rank(h)}
    for k in k_values:
        columns |= {f"recall_at_{k}": recall_at(h, g, k), f"precision_at_{k}": precision_at(h, n, k), f"hit_rate_at_{k}": hit_rate_at(h, k), f"ndcg_at_{k}": ndcg_at(h, g, k)}
    return sized.withColumns({name: F.round(c, 6) for name, c in columns.items()}).drop("__hits", "__gold", "__found")


def long_form(scored: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """dataset, item_id, metric, value of the items that have gold."""
    names = ["mrr", *(f"{m}_at_{k}" for k in k_values for m in ("recall", "precision", "hit_rate", "ndcg"))]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names)))
    return scored.where(F.size("gold") > 0).select("dataset", "item_id", rows.alias("m")).select("dataset", "item_id", "m.metric", "m.value")


def aggregate_metrics(scored: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """dataset, metric, n, value: means over items with gold."""
    return long_form(scored, k_values).groupBy("dataset", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("value"))
