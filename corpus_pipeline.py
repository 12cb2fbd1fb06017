"""A training-data pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's docs. All but the last
give the columns of ``documents``; a stage sees only what its predecessor kept.
Rows may have null or empty texts, null doc_ids and repeated rows at any stage;
an empty table goes through to an empty result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mixing, near_dedup, packing, quality_crf
from quarry.llm.common import Tables, free_name, written


def _rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, xx) of ``kept``; xx is the hash of the text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    wanted = written(kept.select(key.alias("__key"), F.col("xx").alias("__xx")).distinct(), "wanted")
    found = written(docs.withColumns({"__key": key, "__xx": F.xxhash64(F.col("text").cast("string"))}).join(wanted, ["__key", "__xx"], "left_semi"), "found")
    if found.count() > wanted.count():  # rows repeat; they are thinned out before they are dealt to tasks
        found = found.dropDuplicates(["__key", "__xx"])
    return found.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores at 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    name = free_name(docs, "__score")
    return quality_crf.score(docs, quality_crf.train(docs, labels), name).where(F.col(name) >= quality_crf.THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for A-Z in lower case, the largest doc_id."""
    return _rows(docs, exact_dedup.dedup(docs).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, 0.8), the smallest doc_id."""
    return _rows(docs, near_dedup.near_duplicates(docs, size=5, per_cent=80).where("kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at 5, 2, 1 and so on; a document comes as often as the mix takes it, twice at most."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: Neither the random field nor hash sketches nor the tokenizer can be put in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), f"stage{i}")
        tables.drop(docs)
    return docs
