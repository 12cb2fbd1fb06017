"""Readers of the given tables in the roles that the operators know."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stated(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Few rows that are written here, as a local table of the plan. From a list Spark makes an RDD, which Python workers of their own read on the executors."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds))


def corpus(spark: SparkSession, sf_dir: str, sourced: bool = False) -> DataFrame:
    """source, doc_id, text; one source for all unless ``sourced``."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return d.select((F.col("source") if sourced else F.lit("all")).alias("source"), "doc_id", "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: every row of ``benchmark``."""
    return table(spark, sf_dir, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, doc_id, embedding, label; even labels stand for docs, odd ones for discussions."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.when(F.col("label") % 2 == 0, "docs").otherwise("discussions").alias("source"), F.col("vec_id").alias("doc_id"), "embedding", "label")


def qas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions of ``conversations``: a user's turn and the assistant's that follows it."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question_body"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer_body"))
    both = user.join(answer, ["conv_id", "turn"])
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return both.select(name.alias("discussion_id"), F.substring("question_body", 1, 40).alias("title"), "question_body", "answer_body", F.concat(F.lit("https://example.org/d/"), name).alias("url"), F.lit(None).cast("string").alias("category"))


QAS_SQL = """qas AS (
  SELECT u.conv_id || '-' || u.turn AS discussion_id, substr(u.text, 1, 40) AS title, u.text AS question_body, a.text AS answer_body,
    'https://example.org/d/' || u.conv_id || '-' || u.turn AS url
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: documents set as Markdown. Whole lines stay; each one's length and place decide which line goes before it."""
    lines = F.split("text", "\n", -1)

    def mark(line, i):
        head = F.substring(line, 1, 24)
        n = F.char_length(line) % 6
        before = (
            F.when(i % 13 == 5, F.lit("```"))
            .when(n == 0, F.lit(""))
            .when(n == 1, F.concat(F.lit("## "), head, F.lit(" { #h"), i.cast("string"), F.lit(" }")))
            .when(n == 2, F.concat(F.lit("### "), head))
            .when(n == 3, F.concat(F.lit("#### "), head, F.lit(" { #d"), i.cast("string"), F.lit(" }")))
            .when(n == 4, F.concat(F.lit("/// tip | "), head))
        )
        return F.when(before.isNull(), F.array(line)).otherwise(F.array(before, line))

    return table(spark, sf_dir, "documents", "doc_id", "text").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.array_join(F.flatten(F.transform(lines, mark)), "\n").alias("text"))


#: ``marked`` (path, ln, line): the lines of ``marked_pages``.
MARKED_SQL = """marked AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY i, sub) - 1 AS ln, line FROM (
    SELECT path, i, 1 AS sub, x AS line FROM parted
    UNION ALL SELECT path, i, 0, CASE WHEN i % 13 = 5 THEN '```' WHEN length(x) % 6 = 0 THEN ''
      WHEN length(x) % 6 = 1 THEN '## ' || substr(x, 1, 24) || ' { #h' || i || ' }' WHEN length(x) % 6 = 2 THEN '### ' || substr(x, 1, 24)
      WHEN length(x) % 6 = 3 THEN '#### ' || substr(x, 1, 24) || ' { #d' || i || ' }' ELSE '/// tip | ' || substr(x, 1, 24) END FROM parted WHERE i % 13 = 5 OR length(x) % 6 <> 5))"""
MARKED_SQL = """parted AS (SELECT path, i - 1 AS i, parts[i] AS x FROM (SELECT doc_id || '.md' AS path, string_split(text, chr(10)) AS parts,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
""" + MARKED_SQL


def line_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, sizes: the documents' lines and their token estimates."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.lines(F.col("text")).alias("lines"))
    return d.select("doc_id", "lines", F.transform("lines", T.token_estimate).alias("sizes"))


LINES_SQL = """lines AS (
  SELECT doc_id, i, parts[i] AS line, greatest(1, CAST(ceil(length(parts[i]) / 4.0) AS INTEGER)) AS size
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS parts FROM documents)))"""
