"""Queries that write the given tables out, as stores, streams and files do, and read them back."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import config, experiment, scratch
from quarry.functions import text as T
from quarry.operators import metrics
from quarry.outcomes import Busy, Outcomes
from quarry.plans import tables
from quarry.plans.evaluation import _ITEM_METRICS, contained
from quarry.plans.tables import QAS_SQL, corpus, qas, table
from quarry.providers import Completion
from quarry.sources import archives, files
from quarry.sources.discussions import Discussions
from quarry.sources.store import ChunkStore
from quarry.streaming.upsert import upsert_stream


def _new(spark: SparkSession, name: str) -> str:
    return f"{scratch.folder(spark)}/quarry-core/{name}-{uuid.uuid4().hex}"


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, source) as chunks of one each."""
    made = docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("text").alias("document"), F.col("source").alias("parent_id"))
    return made.withColumn("content_hash", T.content_hash(F.col("document")))


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents stored, then all that are not first of three, every fourth one changed: what the store holds at last."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    store = ChunkStore(spark, _new(spark, "store"))
    store.upsert(_chunks(d.where("doc_id % 3 <> 2")), "docs", "first")
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text"))
    store.upsert(_chunks(d.where("doc_id % 3 <> 0").withColumn("text", changed)), "docs")
    return store.read("docs").select("chunk_id", "parent_id", "content_hash", F.round(F.get("embedding", F.lit(0)), 6).alias("first_number"))


def store_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents stored, then three upserts, a refresh of the identity alone and a compaction, after it one upsert that takes chunks away: what the store holds, with its identity."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    store = ChunkStore(spark, _new(spark, "store"))
    store.upsert(_chunks(d.where("doc_id % 2 = 0")), "docs", "first")
    for turn in (3, 5, 7):
        changed = d.where(F.col("doc_id") % turn == 1).withColumn("text", F.concat("text", F.lit(f" turn {turn}")))
        store.upsert(_chunks(changed), "docs")
    store.refresh("docs", "second")
    store.compact("docs")
    left = store.read("docs").where(F.length("document") % 4 != 0)
    store.upsert(left.drop("embedding"), "docs", keep_missing=False)
    sha = store.identity("docs")["corpus_sha"]
    return store.read("docs").select("chunk_id", "parent_id", "content_hash", F.round(F.get("embedding", F.lit(0)), 6).alias("first_number"), F.lit(sha).alias("corpus_sha"))


def store_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored chunks of one parent, counted."""
    store = ChunkStore(spark, _new(spark, "store"))
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    store.upsert(_chunks(d), "docs")
    return store.family("docs", d.agg(F.min("source").alias("least")).first().least).groupBy("parent_id").agg(F.count("*").alias("n"), F.countDistinct("content_hash").alias("n_texts"))


def store_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ChunkStore(spark, _new(spark, "store"))
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source").withColumn("source", F.when(F.col("doc_id") % 5 != 0, F.col("source")))
    store.upsert(_chunks(d), "docs")
    return store.profile("docs")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a stream of chunks into a store, twice: the second time nothing changes."""
    at, store = _new(spark, "stream"), ChunkStore(spark, _new(spark, "store"))
    _chunks(table(spark, sf_dir, "documents", "doc_id", "text", "source")).write.parquet(at)
    schema = spark.read.parquet(at).schema
    for turn in range(2):
        upsert_stream(spark.readStream.schema(schema).parquet(at), store, "docs", f"{_new(spark, 'progress')}-{turn}", order="content_hash").awaitTermination()
    return store.read("docs").select("chunk_id", "content_hash")


def jsonl_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items written as a set in lines of JSON and read back in its schema, every seventh rejected."""
    folder = _new(spark, "sets")
    q = tables.queries(spark, sf_dir)
    rows = q.select(F.col("query_id").cast("string").alias("id"), F.lit("benchmark").alias("dataset"), F.col("query").alias("question"), F.array(F.concat(F.lit("u"), F.col("query_id").cast("string"))).alias("gold_urls"), F.when(F.col("query_id") % 7 == 0, "no").alias("verified"))
    files.write_jsonl(rows, f"{folder}/benchmark.jsonl")
    return files.read_eval_set(spark, folder, "benchmark").select("id", F.sha2("question", 256).alias("question_sha"), F.array_join("gold_urls", "|").alias("gold_urls"), F.coalesce("verified", F.lit("-")).alias("verified"))


def answered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as discussion nodes, some without an answer and some with an empty one, by lengths."""
    q = qas(spark, sf_dir)
    answer = F.when(F.char_length("question_body") % 4 != 0, F.struct(F.when(F.char_length("answer_body") % 9 == 0, "").otherwise(F.col("answer_body")).alias("bodyText")))
    nodes = q.select(F.col("discussion_id").alias("id"), "title", F.col("question_body").alias("bodyText"), "url", answer.alias("answer"), F.struct(F.lit("general").alias("name")).alias("category"))
    return files.answered(nodes).select("discussion_id", "category", F.sha2("answer_body", 256).alias("answer_sha"))


def paged_discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations kept as pages of a service's feeds, every fifth question without an answer, read page by page by the data source; once in a batch, once as a stream."""
    folder = _new(spark, "pages")
    q = qas(spark, sf_dir)
    feeds = F.pmod(F.crc32(F.col("discussion_id").cast("binary")), F.lit(8)).cast("int")
    node = F.struct(F.col("discussion_id").alias("id"), "title", F.col("question_body").alias("bodyText"), "url", F.when(F.char_length("question_body") % 5 != 0, F.struct(F.col("answer_body").alias("bodyText"))).alias("answer"), F.struct(F.lit("general").alias("name")).alias("category"))
    placed = q.withColumn("feed", feeds).withColumn("page", F.floor((F.row_number().over(Window.partitionBy("feed").orderBy("discussion_id")) - 1) / 50).cast("int"))
    placed.select("feed", "page", F.to_json(node).alias("value")).repartition("feed", "page").write.partitionBy("feed", "page").text(folder)
    spark.dataSource.register(Discussions)
    batch = files.answered(spark.read.format("discussions").option("folder", folder).load())
    at = _new(spark, "streamed")
    stream = files.answered(spark.readStream.format("discussions").option("folder", folder).load())
    stream.writeStream.format("parquet").option("path", at).option("checkpointLocation", _new(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    both = batch.withColumn("way", F.lit("batch")).unionByName(spark.read.schema(batch.schema).parquet(at).withColumn("way", F.lit("stream")))
    return both.select("way", "discussion_id", "category", F.sha2("answer_body", 256).alias("answer_sha"))


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written into tar archives, half of them as pages and some outside of what a corpus takes, and read back from their places."""
    folder = _new(spark, "archives")
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    name = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("docs/d"), F.col("doc_id") % 7, F.lit("/"), name, F.lit(".md"))).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("docs/"), name, F.lit(".png"))).otherwise(F.concat(F.lit("docs_src/"), name, F.lit(".py")))
    archives.write(d.select(path.alias("path"), "text"), folder, 8).write.format("noop").mode("overwrite").save()
    members = scratch.written(archives.index(spark, folder), "members")
    return archives.texts(members).select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"), F.char_length("text").cast("long").alias("n_chars"))


def scripted(ill: bool) -> Callable:
    """A model that says the SHA-256 of what it is asked. Some texts find it busy the first time; where it is ill it fails at others."""

    class Model:
        name = model = "scripted"

        def __init__(self):
            self.seen = set()

        def complete(self, messages, *, temperature=0.0, max_tokens=1024):
            text = messages[-1]["content"]
            said = hashlib.sha256(text.encode()).hexdigest()
            kind = int(said[:4], 16)
            if ill and kind % 5 == 0:
                raise ValueError("ill")
            if kind % 3 == 0 and text not in self.seen:
                self.seen.add(text)
                raise Busy("0")
            return Completion(said, "scripted")

    return Model


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scripted model asked about every document, first while it fails at some, then again: what it says, how often each text was asked for and tried."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    root, wave = _new(spark, "outcomes"), max(1, d.count() // 3)
    for ill in (True, False):
        outcomes = Outcomes(spark, root, scripted(ill), "scripted", wave=wave)
        said = outcomes.complete(d, "text", "said")
    calls = outcomes.table().groupBy("call").agg(F.count("*").alias("n_calls"), F.sum("tries").alias("n_tries"), F.count("said").alias("n_said"))
    return said.withColumn("call", outcomes.key(F.col("text"))).join(calls, "call").select("doc_id", "said", "n_calls", "n_tries", "n_said")


def run_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation run over the benchmark: gold resolved from addresses, BM25 through the plan, means over items."""
    gold = contained(spark, sf_dir).groupBy("query_id").agg(F.collect_set(F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("gold_urls"))
    none = F.array().cast("array<string>")
    q = tables.queries(spark, sf_dir).join(gold, "query_id", "left")
    items = q.select(F.col("query_id").cast("string").alias("id"), F.lit("benchmark").alias("dataset"), F.col("query").alias("question"), F.coalesce("gold_urls", none).alias("gold_urls"), none.alias("exclude_chunk_ids"), F.lit(None).cast("string").alias("verified"))
    name = F.col("doc_id").cast("string")
    chunks = corpus(spark, sf_dir).select(F.lit("docs").alias("source"), "doc_id", "text", F.concat(F.lit("c"), name).alias("chunk_id"), F.concat(F.lit("u"), name).alias("url"), none.alias("merged_urls"))
    cfg = config.from_dict({"name": "benchmark", "retrieval": {"candidates_k": 30, "dense": {"enabled": False}, "bm25": {"enabled": True}, "per_source_caps": {"docs": 30, "discussions": 30}}, "eval": {"datasets": ["benchmark"]}})
    scored = scratch.written(experiment.evaluate(cfg, items, chunks), "scored")
    return metrics.aggregate_metrics(scored).select("metric", "n", "value")


QUERIES = {f.__name__: f for f in (store_upsert, store_deltas, store_family, store_profile, stream_upsert, jsonl_items, answered_nodes, paged_discussions, archive_pages, model_calls, run_experiment)}

_STORED = "SELECT doc_id, source, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN text || ' again' ELSE text END AS text FROM documents"

SQL = {
    "store_upsert": f"SELECT 'c' || doc_id AS chunk_id, source AS parent_id, substr(sha256(text), 1, 16) AS content_hash, round(CAST('0x' || substr(sha256(text), 1, 2) AS INTEGER) / 255.0::DOUBLE, 6) AS first_number FROM ({_STORED})",
    "store_deltas": """WITH t AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 1 THEN text || ' turn 7' WHEN doc_id % 5 = 1 THEN text || ' turn 5' WHEN doc_id % 3 = 1 THEN text || ' turn 3' WHEN doc_id % 2 = 0 THEN text END AS text FROM documents)
SELECT 'c' || doc_id AS chunk_id, source AS parent_id, substr(sha256(text), 1, 16) AS content_hash, round(CAST('0x' || substr(sha256(text), 1, 2) AS INTEGER) / 255.0::DOUBLE, 6) AS first_number, 'second' AS corpus_sha FROM t WHERE length(text) % 4 <> 0""",
    "store_family": "SELECT source AS parent_id, count(*) AS n, count(DISTINCT substr(sha256(text), 1, 16)) AS n_texts FROM documents WHERE source = (SELECT min(source) FROM documents) GROUP BY source",
    "store_profile": """SELECT x.c AS "column", x.k AS kind, CAST(CASE WHEN x.c = 'parent_id' THEN (SELECT count(*) FROM documents WHERE doc_id % 5 = 0 OR source IS NULL) ELSE 0 END AS BIGINT) AS n_null
FROM (VALUES ('chunk_id', 'string'), ('document', 'string'), ('parent_id', 'string'), ('content_hash', 'string'), ('embedding', 'array<double>')) x(c, k)""",
    "stream_upsert": "SELECT 'c' || doc_id AS chunk_id, substr(sha256(text), 1, 16) AS content_hash FROM documents",
    "jsonl_items": "SELECT CAST(item_id AS VARCHAR) AS id, sha256(text) AS question_sha, 'u' || item_id AS gold_urls, CASE WHEN item_id % 7 = 0 THEN 'no' ELSE '-' END AS verified FROM benchmark",
    "answered_nodes": f"WITH {QAS_SQL} SELECT discussion_id, 'general' AS category, sha256(answer_body) AS answer_sha FROM qas WHERE length(question_body) % 4 <> 0 AND length(answer_body) % 9 <> 0 AND answer_body <> ''",
    "paged_discussions": f"WITH {QAS_SQL} SELECT way, discussion_id, 'general' AS category, sha256(answer_body) AS answer_sha FROM qas, (VALUES ('batch'), ('stream')) w(way) WHERE length(question_body) % 5 <> 0 AND answer_body <> ''",
    "archive_pages": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'docs/d' || (doc_id % 7) || '/' || doc_id || '.md' ELSE 'docs_src/' || doc_id || '.py' END AS path, sha256(text) AS text_sha, length(text) AS n_chars FROM documents WHERE doc_id % 2 = 0 OR doc_id % 5 <> 0",
    "model_calls": """WITH t AS (SELECT doc_id, sha256(text) AS said, CAST('0x' || substr(sha256(text), 1, 4) AS INTEGER) AS kind FROM documents)
SELECT doc_id, said, CASE WHEN kind % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS n_calls, (CASE WHEN kind % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN kind % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS n_tries, 1::BIGINT AS n_said FROM t""",
    "run_experiment": _ITEM_METRICS + " SELECT metric, count(*) AS n, round(avg(value), 5) AS value FROM im GROUP BY metric",
}
