"""Queries of synthetic questions: filters, samples, reports, human verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import review, synth
from quarry.plans import tables
from quarry.plans.evaluation import contained
from quarry.plans.tables import table, vectors


def trigram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.trigram_df(table(spark, sf_dir, "documents", "doc_id", "text"))


ASKED_ABOUT = 10  # documents that an item is a question about


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question about ten documents and about those that hold it: a list that grows with the items."""
    q = tables.queries(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.col("query").alias("question"))
    docs = table(spark, sf_dir, "documents", "doc_id")
    places = F.sequence(F.lit(0), F.lit(ASKED_ABOUT - 1))
    n = docs.agg(F.count("*").alias("n"))
    some = q.join(n).select("question_id", F.explode(F.transform(places, lambda j: (F.col("question_id") * 31 + j * 17) % F.col("n"))).alias("doc_id"))
    held = contained(spark, sf_dir).select(F.col("query_id").alias("question_id"), "doc_id")
    return some.join(docs, "doc_id").select("question_id", "doc_id").unionByName(held).distinct().join(q, "question_id")


def lexical_overlap_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.lexical_overlap(_questions(spark, sf_dir), table(spark, sf_dir, "documents", "doc_id", "text"))


def closed_book_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by a scripted model that gives the head of the passage."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("question", F.concat(F.lit("q"), F.col("doc_id").cast("string")))
    return synth.closed_book(d, F.substring("text", 1, 40)).select("doc_id", "rejected")


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole similarity join: each vector and how many others are close to it."""
    return synth.near_duplicate_counts(vectors(spark, sf_dir), 0.3)


def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one set, filtered in order."""
    v = vectors(spark, sf_dir).select(F.lit("all").alias("set_id"), F.col("doc_id").alias("item_id"), "embedding")
    return synth.near_duplicate_greedy(v, 0.3).select("item_id", "accepted")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents, round-robin over the sources: a sampling operator."""
    d = table(spark, sf_dir, "documents", "doc_id", "source").withColumnRenamed("source", "section")
    return synth.stratified_sample(d, 100, "doc_id").select("doc_id", "section", "place")


def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    n = F.col("doc_id") % 7
    reason = F.when(n == 0, "generation_error").when(n == 1, "lexical").when(n == 2, "closed_book").when(n == 3, "duplicate")
    return synth.build_report(d.select(F.when(F.col("doc_id") % 14 != 0, F.col("text")).alias("question"), F.col("source").alias("section"), reason.alias("reject_reason")))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")


def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents from ``labels``: a good one is confirmed, a toxic one edited, a bad one rejected."""
    items = table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), F.lit(None).cast("string").alias("verified"), F.lit(None).cast("string").alias("verified_at"))
    letter = F.when(F.col("toxic") == 1, "e").when(F.col("quality") == 1, "y").otherwise("n")
    d = _decided(spark, sf_dir).select(F.col("doc_id").alias("item_id"), letter.alias("decision"), F.lit("edited").alias("edited_question"), F.lit("2024-05-01").alias("decided_at"))
    early = d.withColumns({"decision": F.lit("s"), "decided_at": F.lit("2024-04-01")})
    return review.apply_reviews(items, d.unionByName(early))


def label_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("item_id"), F.array().cast("array<string>").alias("gold_urls"), F.lit(None).cast("string").alias("verified"), F.lit(None).cast("string").alias("verified_at"))
    raw = F.when(F.col("quality") == 0, F.lit(" N ")).otherwise(F.concat(F.lit(" u"), F.col("doc_id").cast("string"), F.lit(", , v ")))
    out = review.apply_labels(items, _decided(spark, sf_dir).select(F.col("doc_id").alias("item_id"), raw.alias("raw"), F.lit("2024-05-01").alias("decided_at")))
    return out.withColumn("gold_urls", F.array_join("gold_urls", "|"))


QUERIES = {f.__name__: f for f in (trigram_df, lexical_overlap_reject, closed_book_reject, near_dup_pairs, near_dup_greedy, stratified_sample, build_report, review_apply, label_apply)}

_TRI = "list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
_STOP = "[" + ", ".join(f"'{w}'" for w in synth.STOP_WORDS) + "]"
_VEC = "list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha256({x}), 2 * i + 1, 2) AS INTEGER)::DOUBLE / 255)"
_TRIGRAMS = f"dt AS (SELECT doc_id, unnest({_TRI}) AS t FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents))"
#: near (a, b): vectors that are close, in both directions.
_NEAR_PAIRS = "near AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) >= 0.3)"

SQL = {
    "trigram_df": f"WITH {_TRIGRAMS} SELECT t AS trigram, count(*) AS df FROM dt GROUP BY t",
    "lexical_overlap_reject": f"""
WITH {_TRIGRAMS}, df AS (SELECT t, count(*) AS n FROM dt GROUP BY t),
qt AS (SELECT question_id, t FROM (SELECT item_id AS question_id, unnest({_TRI}) AS t FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark)) WHERE NOT list_has_any(string_split(t, ' '), {_STOP})),
p AS (SELECT item_id AS question_id, doc_id FROM (SELECT item_id, (item_id * 31 + unnest(range(0, 10)) * 17) % (SELECT count(*) FROM documents) AS doc_id FROM benchmark) JOIN (SELECT doc_id FROM documents) USING (doc_id)
  UNION SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT DISTINCT p.question_id, p.doc_id FROM p JOIN qt ON qt.question_id = p.question_id JOIN dt ON dt.doc_id = p.doc_id AND dt.t = qt.t JOIN df ON df.t = qt.t WHERE df.n <= 2)
SELECT p.question_id, p.doc_id, h.doc_id IS NOT NULL AS rejected FROM p LEFT JOIN h ON h.question_id = p.question_id AND h.doc_id = p.doc_id""",
    "closed_book_reject": f"SELECT doc_id, round(list_cosine_similarity({_VEC.format(x='substr(text, 1, 40)')}, {_VEC.format(x='text')}), 6) >= 0.85 AS rejected FROM documents",
    "near_dup_pairs": f"WITH {_NEAR_PAIRS} SELECT v.vec_id AS doc_id, count(b) AS n_links FROM embeddings v LEFT JOIN near ON a = v.vec_id GROUP BY v.vec_id",
    "near_dup_greedy": f"""
WITH RECURSIVE {_NEAR_PAIRS}, o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
e AS MATERIALIZED (SELECT o.i, o.vec_id, coalesce(list(b) FILTER (b < o.vec_id), []) AS before FROM o LEFT JOIN near ON a = o.vec_id GROUP BY o.i, o.vec_id),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS held
  UNION ALL SELECT e.i, CASE WHEN list_has_any(g.held, e.before) THEN g.held ELSE list_append(g.held, CAST(e.vec_id AS BIGINT)) END FROM g JOIN e ON e.i = g.i + 1)
SELECT vec_id AS item_id, list_contains((SELECT arg_max(held, i) FROM g), CAST(vec_id AS BIGINT)) AS accepted FROM embeddings""",
    "stratified_sample": "SELECT doc_id, source AS section, CAST(row_number() OVER (ORDER BY nth, source) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('0-' || doc_id)) AS nth FROM documents) QUALIFY place <= 100",
    "build_report": """
SELECT count(*) FILTER (doc_id % 14 <> 0 AND text IS NOT NULL) AS generated, count(*) FILTER (doc_id % 7 = 1) AS rejected_lexical, count(*) FILTER (doc_id % 7 = 2) AS rejected_closed_book,
  count(*) FILTER (doc_id % 7 = 3) AS rejected_duplicate, count(*) FILTER (doc_id % 7 = 0) AS rejected_generation_error, count(*) FILTER (doc_id % 7 > 3) AS retained,
  (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 7 > 3)) AS sections_covered FROM documents""",
    "review_apply": """
SELECT d.doc_id AS item_id, CASE WHEN toxic = 1 THEN 'edited' ELSE 'q' || d.doc_id END AS question, CASE WHEN toxic = 1 THEN 'edited' WHEN quality = 1 THEN 'yes' WHEN l.doc_id IS NOT NULL THEN 'no' END AS verified,
  CASE WHEN l.doc_id IS NOT NULL THEN '2024-05-01' END AS verified_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "label_apply": """
SELECT d.doc_id AS item_id, CASE WHEN quality = 1 THEN 'u' || d.doc_id || '|v' ELSE '' END AS gold_urls, CASE WHEN quality = 0 THEN 'no' WHEN l.doc_id IS NOT NULL THEN 'yes' END AS verified,
  CASE WHEN l.doc_id IS NOT NULL THEN '2024-05-01' END AS verified_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
}
