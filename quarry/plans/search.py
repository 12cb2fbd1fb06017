"""Queries of lexical and dense search and of what follows them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import generation, scratch
from quarry.functions import text as T
from quarry.operators import dense, fusion, lexical
from quarry.operators.retrieval import RetrievalPlan
from quarry.plans import tables
from quarry.plans.tables import corpus, vectors
from quarry.sources.cells import CellIndex
from quarry.sources.postings import PostingIndex

DEPTH = 30
CAPS = {"docs": 4, "discussions": 2}


def bm25_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequencies(lexical.term_frequencies(corpus(spark, sf_dir))).select("term", "df")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.bm25_topk(tables.queries(spark, sf_dir), corpus(spark, sf_dir), 10).select("query_id", "doc_id", "score", "rank")


def bm25_topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_topk(tables.queries(spark, sf_dir), corpus(spark, sf_dir, sourced=True), 10).select("query_id", "source", "doc_id", "score", "rank")


def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bm25_topk_per_source`` from a stored index: built over two thirds of the documents, some with other texts, then brought to all as they are."""
    docs = corpus(spark, sf_dir, sourced=True)
    index = PostingIndex(spark, f"{scratch.folder(spark)}/quarry-core/postings-{uuid.uuid4().hex}")
    index.build(docs.where("doc_id % 3 <> 1").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(" before"))).otherwise(F.col("text"))))
    index.refresh(docs)
    return index.search(tables.queries(spark, sf_dir), 10).select("query_id", "source", "doc_id", "score", "rank")


def _denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's three best documents: a list that grows with the items, and that changes every ranking."""
    return bm25_topk(spark, sf_dir).where("rank <= 3").select("query_id", "doc_id")


def bm25_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``bm25_topk`` without the three documents that are best otherwise."""
    return lexical.bm25_topk(tables.queries(spark, sf_dir), corpus(spark, sf_dir), 10, _denied(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 100."""
    return vectors(spark, sf_dir).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of each stated query."""
    rows = vectors(spark, sf_dir).withColumn("source", F.lit("all"))
    return dense.dense_topk(_asked(spark, sf_dir), rows, 10, self_deny=True).select("query_id", "doc_id", "score", "rank")


def dense_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_topk(_asked(spark, sf_dir), vectors(spark, sf_dir), 10).select("query_id", "source", "doc_id", "score", "rank")


def _two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as two sources and as sections of five: source, doc_id, text, parent_id, chunk_index."""
    d = corpus(spark, sf_dir)
    return d.select(
        F.when(F.col("doc_id") % 3 == 0, "discussions").otherwise("docs").alias("source"),
        "doc_id",
        "text",
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / 5).cast("string")).alias("parent_id"),
        (F.col("doc_id") % 5).cast("int").alias("chunk_index"),
    )


def dense_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic vectors of texts, benchmark against documents."""
    q = dense.with_fake_embeddings(tables.queries(spark, sf_dir), "query")
    return dense.dense_topk(q, dense.with_fake_embeddings(_two_sources(spark, sf_dir)), 10).select("query_id", "source", "doc_id", "score", "rank")


def _text_index(spark: SparkSession, sf_dir: str) -> CellIndex:
    """A stored index of the deterministic vectors of all documents."""
    index = CellIndex(spark, f"{scratch.folder(spark)}/quarry-core/cells-{uuid.uuid4().hex}")
    index.build(dense.with_fake_embeddings(_two_sources(spark, sf_dir)).select("source", "doc_id", "embedding"))
    return index


def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest documents of one source by their deterministic vectors, of those in the ten nearest cells of each benchmark item: approximate."""
    q = dense.with_fake_embeddings(tables.queries(spark, sf_dir), "query")
    return _text_index(spark, sf_dir).search(q, 10, 10, F.col("source") == "docs").select("query_id", "source", "doc_id", "score", "rank")


def ann_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ann_topk``, and exact: cells whose bound reaches the tenth score found are read too."""
    q = dense.with_fake_embeddings(tables.queries(spark, sf_dir), "query")
    return _text_index(spark, sf_dir).search_exact(q, 10, 4, F.col("source") == "docs").select("query_id", "source", "doc_id", "score", "rank")


def _plan(spark: SparkSession, sf_dir: str, k: int | None = None, **settings) -> DataFrame:
    return RetrievalPlan(candidates_k=DEPTH, dense=True, bm25=True, **settings).run(tables.queries(spark, sf_dir), _two_sources(spark, sf_dir), k=k)


def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and BM25 rankings of depth 30, fused."""
    out = _plan(spark, sf_dir, k=DEPTH)
    return out.select("query_id", "source", "doc_id", F.round("final_score", 6).alias("final_score"), "rank", F.array_join("stages", "+").alias("stages"), F.coalesce(F.col("ranks")["dense"], F.lit(0)).alias("dense_rank"), F.coalesce(F.col("ranks")["bm25"], F.lit(0)).alias("bm25_rank"))


def source_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, k=DEPTH, caps=CAPS).select("query_id", "source", "doc_id", "rank")


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, caps=CAPS, top_k=5).select("query_id", "source", "doc_id", F.round("final_score", 6).alias("final_score"), "rank")


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, k=DEPTH, rerank_top_n=5).select("query_id", "source", "doc_id", "final_score", "rank")


def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _plan(spark, sf_dir, top_k=5, expand_tokens=1200)
    return out.select("query_id", "source", "doc_id", "rank", "expanded", F.sha2("content", 256).alias("content_sha"))


def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages: fusion, caps, rerank and expansion."""
    out = _plan(spark, sf_dir, top_k=5, caps=CAPS, rerank_top_n=5, expand_tokens=1200)
    return out.select("query_id", "source", "doc_id", "final_score", "rank", "expanded", F.sha2("content", 256).alias("content_sha"))


def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each benchmark item from its five best documents by dense search."""
    q = dense.with_fake_embeddings(tables.queries(spark, sf_dir), "query")
    chunks = _two_sources(spark, sf_dir)
    top = dense.dense_topk(q, dense.with_fake_embeddings(chunks), 5).join(chunks.select("source", "doc_id", "text"), ["source", "doc_id"])
    context = top.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    prompt = generation.prompt(F.col("contexts"), F.col("query"))
    return tables.queries(spark, sf_dir).join(context, "query_id").select("query_id", F.sha2(prompt, 256).alias("prompt_sha"), T.token_estimate(prompt).alias("n_tokens"))


QUERIES = {
    f.__name__: f
    for f in (bm25_df, bm25_topk, bm25_topk_per_source, bm25_stored, bm25_deny, dense_topk, dense_multi_source, dense_text_topk, ann_topk, ann_exact_topk, rrf, source_caps, hybrid_topk, rerank_overlap, parent_expand, pipeline_full, answer_prompts)
}

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[._][a-z0-9]+)*')"


def bm25_cte(source: str = "'all'") -> str:
    """bm (query_id, source, doc_id, score)."""
    return f"""bq AS (SELECT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark),
bd AS (SELECT {source} AS source, doc_id, {_WORDS} AS w FROM documents),
bs AS (SELECT source, count(*) AS n, avg(len(w)) AS a FROM bd GROUP BY source),
bt AS (SELECT source, doc_id, dl, term, count(*)::DOUBLE AS f FROM (SELECT source, doc_id, len(w) AS dl, unnest(w) AS term FROM bd) WHERE term IN (SELECT term FROM bq) GROUP BY ALL),
bf AS (SELECT source, term, count(*) AS df FROM bt GROUP BY ALL),
bm AS (SELECT query_id, bt.source, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
  FROM bq JOIN bt USING (term) JOIN bf ON bf.source = bt.source AND bf.term = bt.term JOIN bs ON bs.source = bt.source GROUP BY query_id, bt.source, doc_id)"""


_TWO = "CASE WHEN doc_id % 3 = 0 THEN 'discussions' ELSE 'docs' END"
_VEC = "list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha256(text), 2 * i + 1, 2) AS INTEGER)::DOUBLE / 255)"
#: dn (query_id, source, doc_id, score): all pairs of benchmark and documents by their deterministic vectors.
_DENSE = f"""dn AS (SELECT query_id, source, doc_id, round(list_cosine_similarity(a, b), 6) AS score
  FROM (SELECT item_id AS query_id, {_VEC} AS a FROM benchmark) q, (SELECT {_TWO} AS source, doc_id, {_VEC} AS b FROM documents) d)"""


def _top(table: str, k: int, columns: str, where: str = "TRUE") -> str:
    return f"SELECT {columns}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, doc_id) AS INTEGER) AS rank FROM {table} WHERE {where} QUALIFY rank <= {k}"


#: fu (query_id, source, doc_id, s, rank, dense_rank, bm25_rank): both rankings fused.
_FUSED = f"""{bm25_cte(_TWO)}, {_DENSE},
r1 AS ({_top("dn", 30, "query_id, source, doc_id")}), r2 AS ({_top("bm", 30, "query_id, source, doc_id")}),
fj AS (SELECT coalesce(r1.query_id, r2.query_id) AS query_id, coalesce(r1.source, r2.source) AS source, coalesce(r1.doc_id, r2.doc_id) AS doc_id, r1.rank AS dense_rank, r2.rank AS bm25_rank,
  round(coalesce(1.0::DOUBLE / (60 + r1.rank), 0) + coalesce(1.0::DOUBLE / (60 + r2.rank), 0), 9) AS s
  FROM r1 FULL JOIN r2 ON r1.query_id = r2.query_id AND r1.source = r2.source AND r1.doc_id = r2.doc_id),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, CASE WHEN dense_rank IS NULL THEN 1 ELSE 0 END, coalesce(dense_rank, bm25_rank), source, doc_id) AS rank FROM fj)"""
_CAPPED = "cp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= CASE source WHEN 'docs' THEN 4 ELSE 2 END))"


def _reranked(table: str, place: str) -> str:
    return f"""rw AS (SELECT item_id AS query_id, list_distinct({_WORDS}) AS qw FROM benchmark), dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
rr AS (SELECT c.query_id, c.source, c.doc_id, CASE WHEN len(qw) = 0 THEN 0.0 ELSE round(len(list_intersect(qw, w))::DOUBLE / len(qw), 6) END AS final_score, c.{place} AS before
  FROM (SELECT * FROM {table} WHERE {place} <= 30) c JOIN rw USING (query_id) JOIN dw USING (doc_id)),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, before) AS INTEGER) AS rank FROM rr QUALIFY rank <= 5)"""


#: ex (source, parent, n, content): what each parent section expands to.
_EXPANDED = f"""ch AS (SELECT {_TWO} AS source, doc_id, text, doc_id // 5 AS parent, doc_id % 5 AS ci, greatest(1, ceil(length(text) / 4.0)) AS tok FROM documents),
cs AS (SELECT *, sum(tok) OVER w AS sofar, row_number() OVER w AS nth FROM ch WINDOW w AS (PARTITION BY source, parent ORDER BY ci, doc_id ROWS UNBOUNDED PRECEDING)),
ex AS (SELECT source, parent, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY nth) AS content FROM cs WHERE sofar <= 1200 OR nth = 1 GROUP BY ALL)"""


def _with_content(table: str, columns: str) -> str:
    return f"SELECT {columns}, n > 1 AS expanded, sha256(CASE WHEN n > 1 THEN content ELSE text END) AS content_sha FROM {table} t JOIN ch ON ch.source = t.source AND ch.doc_id = t.doc_id JOIN ex ON ex.source = ch.source AND ex.parent = ch.parent"


_NEAR = "SELECT q.vec_id AS query_id, {source} AS source, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"

SQL = {
    "bm25_df": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY term",
    "bm25_topk": f"WITH {bm25_cte()} " + _top("bm", 10, "query_id, doc_id, score"),
    "bm25_topk_per_source": f"WITH {bm25_cte('source')} " + _top("bm", 10, "query_id, source, doc_id, score"),
    "bm25_stored": f"WITH {bm25_cte('source')} " + _top("bm", 10, "query_id, source, doc_id, score"),
    "bm25_deny": f"WITH {bm25_cte()}, all13 AS ({_top('bm', 13, 'query_id, doc_id, score')}) SELECT query_id, doc_id, score, CAST(rank - 3 AS INTEGER) AS rank FROM all13 WHERE rank > 3",
    "dense_topk": f"WITH n AS ({_NEAR.format(source=repr('all'))} AND q.vec_id <> e.vec_id) " + _top("n", 10, "query_id, doc_id, score"),
    "dense_multi_source": "WITH n AS (" + _NEAR.format(source="CASE WHEN e.label % 2 = 0 THEN 'docs' ELSE 'discussions' END") + ") " + _top("n", 10, "query_id, source, doc_id, score"),
    "dense_text_topk": f"WITH {_DENSE} " + _top("dn", 10, "query_id, source, doc_id, score"),
    "ann_exact_topk": f"WITH {_DENSE} " + _top("dn", 10, "query_id, source, doc_id, score", "source = 'docs'"),
    "rrf": f"WITH {_FUSED} SELECT query_id, source, doc_id, round(s, 6) AS final_score, CAST(rank AS INTEGER) AS rank, CASE WHEN dense_rank IS NULL THEN 'bm25' WHEN bm25_rank IS NULL THEN 'dense' ELSE 'dense+bm25' END AS stages, coalesce(dense_rank, 0) AS dense_rank, coalesce(bm25_rank, 0) AS bm25_rank FROM fu WHERE rank <= 30",
    "source_caps": f"WITH {_FUSED}, {_CAPPED} SELECT query_id, source, doc_id, CAST(place AS INTEGER) AS rank FROM cp WHERE place <= 30",
    "hybrid_topk": f"WITH {_FUSED}, {_CAPPED} SELECT query_id, source, doc_id, round(s, 6) AS final_score, CAST(place AS INTEGER) AS rank FROM cp WHERE place <= 5",
    "rerank_overlap": f"WITH {_FUSED}, {_reranked('fu', 'rank')} SELECT query_id, source, doc_id, final_score, rank FROM rk",
    "parent_expand": f"WITH {_FUSED}, {_EXPANDED} " + _with_content("(SELECT * FROM fu WHERE rank <= 5)", "t.query_id, t.source, t.doc_id, CAST(t.rank AS INTEGER) AS rank"),
    "pipeline_full": f"WITH {_FUSED}, {_CAPPED}, {_reranked('cp', 'place')}, {_EXPANDED} " + _with_content("rk", "t.query_id, t.source, t.doc_id, t.final_score, t.rank"),
    "answer_prompts": f"""WITH {_DENSE}, t AS ({_top("dn", 5, "query_id, doc_id")}),
c AS (SELECT query_id, string_agg(d.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM t JOIN documents d USING (doc_id) GROUP BY query_id),
p AS (SELECT query_id, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || 'Answer:' AS prompt FROM c JOIN benchmark b ON b.item_id = c.query_id)
SELECT query_id, sha256(prompt) AS prompt_sha, greatest(1, CAST(ceil(length(prompt) / 4.0) AS INTEGER)) AS n_tokens FROM p""",
}
