"""Corpora and evaluation sets as files."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED_PAGES = ("release-notes.md", "_llm-test.md")
EVAL_ITEM = (
    "id string, dataset string, question string, ground_truth string, ground_truth_raw string, gold_urls array<string>, gold_chunk_ids array<string>, "
    "gold_granularity string, exclude_chunk_ids array<string>, provenance string, verified string, verified_at string"
)
DISCUSSION = "discussion_id string, title string, question_body string, answer_body string, url string, category string"
SNAPSHOT = f"fetched_at string, max_pages int, n_discussions int, discussions array<struct<{DISCUSSION.replace(' string', ': string')}>>"


def _tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path relative to root, text: whole files of a tree."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    name = F.col("_metadata.file_path")
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    return files.select(F.substring_index(name, base, -1).alias("path"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Markdown pages (path, text) but for excluded names; the first ``limit`` by path."""
    pages = _tree(spark, root, "*.md").where(~F.element_at(F.split("path", "/"), -1).isin(*EXCLUDED_PAGES))
    return pages.orderBy("path").limit(limit) if limit else pages


def read_snippets(spark: SparkSession, root: str) -> DataFrame:
    """path from the parent of ``root``, content."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    return _tree(spark, root, "*").select(F.concat(F.lit(f"{name}/"), "path").alias("path"), F.col("text").alias("content"))


def read_discussions(spark: SparkSession, path: str) -> DataFrame:
    """Answered discussions of a snapshot file."""
    return spark.read.schema(SNAPSHOT).json(path, multiLine=True).select(F.inline("discussions"))


def answered(nodes: DataFrame) -> DataFrame:
    """Rows of discussion nodes (id, title, bodyText, url, answer, category) that have an answer's text."""
    kept = nodes.where(F.coalesce("answer.bodyText", F.lit("")) != "")
    return kept.select(F.col("id").alias("discussion_id"), "title", F.col("bodyText").alias("question_body"), F.col("answer.bodyText").alias("answer_body"), "url", F.col("category.name").alias("category"))


def read_eval_set(spark: SparkSession, folder: str, name: str, limit: int | None = None) -> DataFrame:
    """A JSONL set; a missing file is an error, and so is a row that does not fit. ``limit`` takes the first rows of the file."""
    path = f"{folder.rstrip('/')}/{name}.jsonl"
    rows = spark.read.schema(EVAL_ITEM).json(path, mode="FAILFAST")
    if not limit:
        return rows
    # rows of a file in its order: by file, place of the block and place in the block
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.withColumn("__place", place).orderBy("__place").limit(limit).drop("__place")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def file_sha256(path: str | Path) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def corpus_sha(snapshot: str | Path, discussions: str | Path) -> str:
    """The documentation's commit and the discussions file, together."""
    own = json.loads(Path(snapshot).read_text(encoding="utf-8"))["sha"]
    return hashlib.sha256(f"{own}:{file_sha256(discussions)[:12]}".encode()).hexdigest()[:12]


def fingerprint(chunks: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over the sorted chunk ids, by 4096 groups of ids so that no task holds them all."""
    group = F.conv(F.substring(F.sha2("chunk_id", 256), 1, 3), 16, 10).cast("int")
    parts = chunks.groupBy(group.alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("chunk_id")), "\n"), 256).alias("h"))
    return parts.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "\n"), 256), 1, 16).alias("fingerprint"))
