"""From gold URLs to gold chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def gold_index(chunks: DataFrame) -> DataFrame:
    """url, page, chunk_id, distinct: a chunk answers for its url and for those merged into it (chunk_id, url, merged_urls)."""
    urls = F.array_union(F.array("url"), F.coalesce("merged_urls", F.array().cast("array<string>")))
    return chunks.select("chunk_id", F.explode(urls).alias("url")).where(F.coalesce("url", F.lit("")) != "").select("url", T.page_of(F.col("url")).alias("page"), "chunk_id").distinct()


def resolve_gold(items: DataFrame, index: DataFrame) -> DataFrame:
    """``items`` (item_id, gold_urls) with gold_chunk_ids (sorted), gold_granularity and n_unresolved.

    A URL that is not in the index falls back to its page; one such fallback
    makes the item's granularity page."""
    asked = items.select("item_id", F.explode(F.array_distinct("gold_urls")).alias("url"))
    by_url = index.groupBy("url").agg(F.collect_set("chunk_id").alias("exact"))
    by_page = index.groupBy("page").agg(F.collect_set("chunk_id").alias("near"))
    found = asked.join(by_url, "url", "left").withColumn("page", F.when(F.col("exact").isNull(), T.page_of(F.col("url")))).join(by_page, "page", "left")
    per = found.groupBy("item_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("exact", "near", F.array().cast("array<string>")))))).alias("gold_chunk_ids"),
        F.max((F.col("exact").isNull() & F.col("near").isNotNull()).cast("int")).alias("paged"),
        F.sum((F.col("exact").isNull() & F.col("near").isNull()).cast("int")).alias("n_unresolved"),
    )
    out = items.join(per, "item_id", "left")
    return out.withColumns(
        {
            "gold_chunk_ids": F.coalesce("gold_chunk_ids", F.array().cast("array<string>")),
            "gold_granularity": F.when(F.col("paged") == 1, F.lit("page")).otherwise(F.lit("anchor")),
            "n_unresolved": F.coalesce("n_unresolved", F.lit(0)),
        }
    ).drop("paged")
