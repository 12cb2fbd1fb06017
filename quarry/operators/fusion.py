"""Fusing rankings and what follows: caps, reranking, parent sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import scratch
from quarry.functions import text as T

RRF_K = 60


def reciprocal_rank_fusion(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """``rankings``: query_id, ranking_no, pos, source, doc_id, stage, score. One row for each query and document.

    Scores and ranks of the stages become maps; ties go to what was seen first,
    by ranking and place."""
    entries = lambda value: F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("stage", F.col(value).alias("v")))), lambda e: F.struct(e["stage"], e["v"])))
    # a stage that ranks a document twice (rewritten queries) keeps its last word
    last = rankings.groupBy("query_id", "source", "doc_id", "stage").agg(
        F.sum(1 / (k + F.col("pos"))).alias("rrf"), F.max(F.struct("ranking_no", "score", "pos")).alias("last"), F.min(F.struct("ranking_no", "pos")).alias("first")
    )
    last = last.select("query_id", "source", "doc_id", "stage", "rrf", F.col("last.score").alias("score"), F.col("last.pos").alias("pos"), "first")
    fused = last.groupBy("query_id", "source", "doc_id").agg(
        F.round(F.sum("rrf"), 9).alias("final_score"),
        F.min("first").alias("first"),
        entries("score").alias("scores"),
        entries("pos").alias("ranks"),
        F.transform(F.sort_array(F.collect_list(F.struct("first", "stage"))), lambda s: s["stage"]).alias("stages"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "first.ranking_no", "first.pos", "source", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).drop("first")


def per_source_caps(candidates: DataFrame, caps: dict[str, int]) -> DataFrame:
    """At most so many of a source, in rank order; a source without a cap keeps all. Ranks are closed up."""
    cap = F.create_map(*(x for s, n in caps.items() for x in (F.lit(s), F.lit(n))))[F.col("source")] if caps else F.lit(None).cast("int")
    nth = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))
    kept = candidates.withColumns({"__nth": nth, "__cap": cap}).where(F.col("__cap").isNull() | (F.col("__nth") <= F.col("__cap"))).drop("__nth", "__cap")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def overlap_score(query: Column, document: Column) -> Column:
    """Offline stand-in for a cross-encoder: share of the query's words that the document has."""
    words = F.array_distinct(T.bm25_tokens(query))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(words, T.bm25_tokens(document))) / F.size(words), 6))


def rerank(candidates: DataFrame, queries: DataFrame, texts: DataFrame, top_n: int = 5, scorer=overlap_score) -> DataFrame:
    """Orders candidates anew by ``scorer(query, text)`` and keeps top_n; equal scores keep their order."""
    both = candidates.join(queries.select("query_id", "query"), "query_id").join(texts.select("source", "doc_id", "text"), ["source", "doc_id"])
    scored = both.withColumn("rerank_score", scorer(F.col("query"), F.col("text"))).drop("query", "text")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    out = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return out.withColumn("final_score", F.col("rerank_score")).drop("rerank_score")


def expand_parents(candidates: DataFrame, chunks: DataFrame, max_tokens: int = 1200) -> DataFrame:
    """Adds content: the chunk, or the first chunks of its parent section that fit the budget, the first always.

    ``chunks``: source, doc_id, parent_id, chunk_index, text. Each parent's text is made once."""
    # k rows for each query, wanted twice: to find the sections and to take them
    candidates = scratch.written(candidates, "candidates")
    own = candidates.join(chunks.select("source", "doc_id", "parent_id", F.col("text").alias("own")), ["source", "doc_id"])
    wanted = own.where(F.coalesce("parent_id", F.lit("")) != "").select("source", "parent_id").distinct()
    order = Window.partitionBy("source", "parent_id").orderBy("chunk_index", "doc_id")
    family = chunks.join(wanted, ["source", "parent_id"], "left_semi").withColumn("sofar", F.sum(T.token_estimate(F.col("text"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    family = family.withColumn("nth", F.row_number().over(order)).where((F.col("sofar") <= max_tokens) | (F.col("nth") == 1))
    joined = family.groupBy("source", "parent_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda s: s["text"]), "\n\n").alias("section_text"))
    out = own.join(joined, ["source", "parent_id"], "left")
    grown = F.col("n") > 1
    return out.withColumns({"content": F.when(grown, F.col("section_text")).otherwise(F.col("own")), "expanded": F.coalesce(grown, F.lit(False))}).drop("own", "parent_id", "n", "section_text")
