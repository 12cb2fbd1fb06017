"""Queries of gold labels, metrics, intervals and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import containment, dense, gold, lexical, metrics, runs, stats
from quarry.plans import tables
from quarry.plans.generator import draws_cte
from quarry.plans.search import _asked, bm25_cte
from quarry.plans.tables import corpus, table, vectors

K_VALUES = (1, 3, 5, 10)


def _page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url")
    merged = F.when(F.col("page_id") % 4 == 0, F.array(F.concat(T.page_of(F.col("url")), F.lit("#merged")))).otherwise(F.array().cast("array<string>"))
    return p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("chunk_id"), "url", merged.alias("merged_urls"))


def gold_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.gold_index(_page_chunks(spark, sf_dir))


def gold_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page asks for its address, by a fragment that only some pages have, and every fifth for one that is nowhere."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    kind = F.col("page_id") % 5
    urls = F.when(kind == 0, F.array(F.lit("https://nowhere.example/"))).when(kind == 1, F.array(F.concat(T.page_of(F.col("url")), F.lit("#merged")))).when(kind == 2, F.array(F.col("url"), F.concat(T.page_of(F.col("url")), F.lit("#other")))).otherwise(F.array("url"))
    out = gold.resolve_gold(p.select(F.col("page_id").alias("item_id"), urls.alias("gold_urls")), gold.gold_index(_page_chunks(spark, sf_dir)))
    return out.select("item_id", F.array_join("gold_chunk_ids", "|").alias("gold_chunk_ids"), "gold_granularity", F.col("n_unresolved").cast("long"))


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id: documents that hold the whole text of a benchmark item."""
    return containment.holding(tables.queries(spark, sf_dir), corpus(spark, sf_dir).select("doc_id", "text"))


def gold_by_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark, sf_dir)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, item_id, retrieved, gold of BM25 at depth 30 against the documents that hold the item."""
    found = lexical.bm25_topk(tables.queries(spark, sf_dir), corpus(spark, sf_dir), 30)
    ordered = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved"))
    right = contained(spark, sf_dir).groupBy("query_id").agg(F.collect_set("doc_id").alias("gold"))
    none = F.array().cast("array<bigint>")
    both = tables.queries(spark, sf_dir).join(ordered, "query_id", "left").join(right, "query_id", "left")
    return both.select(F.lit("benchmark").alias("dataset"), F.col("query_id").alias("item_id"), F.coalesce("retrieved", none).alias("retrieved"), F.coalesce("gold", none).alias("gold"))


def per_item_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.long_form(metrics.score_items(_items(spark, sf_dir))).select("item_id", "metric", "value")


def aggregate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.aggregate_metrics(metrics.score_items(_items(spark, sf_dir))).select("metric", "n", "value")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, item_id, metric, value: nearest vectors against those of the same label."""
    v = vectors(spark, sf_dir)
    found = dense.dense_topk(_asked(spark, sf_dir), v.withColumn("source", F.lit("all")), 10, self_deny=True)
    own = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("label").alias("own"))
    hits = found.join(v.select("doc_id", "label"), "doc_id").join(own, "query_id").select("query_id", "rank", (F.col("label") == F.col("own")).cast("int").alias("hit"))
    per = hits.groupBy("query_id").agg(F.round(F.sum(F.when(F.col("rank") <= 5, F.col("hit"))) / 5, 6).alias("precision_at_5"), F.round(F.avg("hit"), 6).alias("precision_at_10"), F.round(F.coalesce(F.max(F.col("hit") / F.col("rank")), F.lit(0.0)), 6).alias("mrr"))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision_at_5", "precision_at_10", "mrr"))))
    return per.select(F.lit("labels").alias("dataset"), F.col("query_id").alias("item_id"), rows.alias("m")).select("dataset", "item_id", "m.metric", "m.value")


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("item_id", "metric", "value")


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_ci(_labelled(spark, sf_dir))


def bootstrap_ci_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_ci_hash(_labelled(spark, sf_dir))


def _precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The precision at 5 against that at 10 of the same queries."""
    rows = _labelled(spark, sf_dir).groupBy("dataset", "item_id").agg(F.max(F.when(F.col("metric") == "precision_at_5", F.col("value"))).alias("base"), F.max(F.when(F.col("metric") == "precision_at_10", F.col("value"))).alias("cand"))
    return rows.withColumn("metric", F.lit("precision"))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired_bootstrap_hash(_precisions(spark, sf_dir))


def paired_bootstrap_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired_bootstrap(_precisions(spark, sf_dir))


RUNS = [("r0", "dense", "2024-01-01T00:00:00", "g1"), ("r1", "capped", "2024-01-02T00:00:00", "g1"), ("r2", "other model", "2024-01-03T00:00:00", "g2"), ("r9", "no results", "2024-01-04T00:00:00", "g1")]
THRESHOLDS = [("mrr", 0.05, 0.02), ("recall_at_5", 0.1, 0.02), ("ndcg_at_10", 0.6, 0.02), ("recall_at_1", 0.3, 0.02)]
#: What the leaderboard shows in place of its usual metrics.
SHOWN = {"precision_at_5": "recall_at_5", "precision_at_10": "ndcg_at_10", "mrr": "mrr"}


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs, and their metrics: those of the nearest vectors, of the queries whose label leaves 0, 1 or 2 by three."""
    m = _labelled(spark, sf_dir).join(vectors(spark, sf_dir).select(F.col("doc_id").alias("item_id"), (F.col("label") % 3).alias("run")), "item_id")
    shown = F.create_map(*(F.lit(x) for pair in SHOWN.items() for x in pair))
    of = m.groupBy(F.concat(F.lit("r"), F.col("run").cast("string")).alias("run_id"), shown[F.col("metric")].alias("metric"))
    rows = of.agg(F.round(F.avg("value"), 6).alias("value"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").cast("int").alias("n"))
    return tables.stated(spark, RUNS, "run_id string, name string, created_at string, generation_hash string"), rows.withColumn("dataset", F.lit("a"))


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.newest_first(runs.leaderboard(*_runs(spark, sf_dir), "a"))


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = _runs(spark, sf_dir)
    return runs.compare(r, m, "r0", "r1", "a").withColumn("cand_run", F.lit("r1")).unionByName(runs.compare(r, m, "r0", "r2", "a").withColumn("cand_run", F.lit("r2")))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = _runs(spark, sf_dir)
    limits = tables.stated(spark, THRESHOLDS, "metric string, floor double, tolerance double")
    of = lambda run: m.where((F.col("run_id") == run) & (F.col("dataset") == "a")).select("metric", "value")
    return runs.gate(limits, of("r1"), of("r0"))


def regressed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 against BM25 that ignores document length."""
    q, d = tables.queries(spark, sf_dir), corpus(spark, sf_dir)
    right = contained(spark, sf_dir).groupBy("query_id").agg(F.collect_set("doc_id").alias("gold"))

    def rows(b: float) -> DataFrame:
        found = lexical.bm25_topk(q, d, 10, b=b).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved"))
        both = q.join(right, "query_id").join(found, "query_id").withColumn("item_id", F.col("query_id"))
        return both.withColumn("mrr", F.round(metrics.reciprocal_rank(metrics.hit_places(F.col("retrieved"), F.col("gold"))), 6)).withColumnRenamed("query", "question")

    out = runs.regressed_items(rows(0.75), rows(0.0), "mrr")
    return out.select("item_id", "base_value", "cand_value", "delta", "base_gold_rank", "cand_gold_rank")


QUERIES = {
    f.__name__: f
    for f in (gold_index, gold_resolve, gold_by_containment, per_item_metrics, aggregate_metrics, label_metrics, bootstrap_ci, bootstrap_ci_hash, paired_bootstrap, paired_bootstrap_seeded, leaderboard, compare_runs, gate, regressed_items)
}

_PAGE_CHUNKS = """pc AS (SELECT 'p' || page_id AS chunk_id, unnest(CASE WHEN page_id % 4 = 0 THEN [url, split_part(url, '#', 1) || '#merged'] ELSE [url] END) AS url FROM pages),
gi AS (SELECT DISTINCT url, split_part(url, '#', 1) AS page, chunk_id FROM pc WHERE url <> '')"""

_CONTAINED = "ct AS (SELECT item_id AS query_id, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"
_IDEAL = "list_sum(list_transform(range(1, least({k}, ng) + 1), lambda r: 1 / log2(r + 1)))"
#: im (item_id, metric, value): metrics of BM25 at depth 30.
_ITEM_METRICS = (
    f"WITH {bm25_cte()}, {_CONTAINED}, "
    + """rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, doc_id) AS rank FROM bm QUALIFY rank <= 30),
gd AS (SELECT query_id, count(*) AS ng FROM ct GROUP BY query_id),
nr AS (SELECT query_id, count(*) AS found FROM rk GROUP BY query_id),
ht AS (SELECT rk.query_id, rk.rank FROM rk JOIN ct ON ct.query_id = rk.query_id AND ct.doc_id = rk.doc_id),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
pk AS (SELECT gd.query_id, k, ng, coalesce(found, 0) AS found, count(ht.rank) AS hits, coalesce(sum(1 / log2(ht.rank + 1)), 0) AS dcg
  FROM gd CROSS JOIN ks LEFT JOIN nr ON nr.query_id = gd.query_id LEFT JOIN ht ON ht.query_id = gd.query_id AND ht.rank <= k GROUP BY ALL),
im AS (
  SELECT query_id AS item_id, 'recall_at_' || k AS metric, round(hits / ng, 6) AS value FROM pk
  UNION ALL SELECT query_id, 'precision_at_' || k, CASE WHEN found = 0 THEN 0 ELSE round(hits / least(k, found), 6) END FROM pk
  UNION ALL SELECT query_id, 'hit_rate_at_' || k, CAST(hits > 0 AS INTEGER)::DOUBLE FROM pk
  UNION ALL SELECT query_id, 'ndcg_at_' || k, round(dcg / list_sum(list_transform(range(1, least(k, ng) + 1), lambda r: 1 / log2(r + 1))), 6) FROM pk
  UNION ALL SELECT gd.query_id, 'mrr', round(coalesce(1 / min(rank), 0), 6) FROM gd LEFT JOIN ht ON ht.query_id = gd.query_id GROUP BY gd.query_id)"""
)

#: lm (item_id, metric, value): metrics of nearest vectors by label.
_LABELLED = """
WITH n AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, e.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id QUALIFY rank <= 10),
p AS (SELECT query_id AS item_id, round(sum(CASE WHEN rank <= 5 THEN CAST(hit AS INTEGER) END) / 5, 6) AS p5, round(avg(CAST(hit AS INTEGER)), 6) AS p10, round(max(CAST(hit AS INTEGER) / rank), 6) AS mrr FROM n GROUP BY query_id),
lm AS (SELECT item_id, 'precision_at_5' AS metric, p5 AS value FROM p UNION ALL SELECT item_id, 'precision_at_10', p10 FROM p UNION ALL SELECT item_id, 'mrr', mrr FROM p)"""

_DRAWN = """
, pl AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY item_id) - 1 AS place, count(*) OVER (PARTITION BY metric) AS size FROM {table}),
sl AS (SELECT metric, size, place AS slot, unnest(range(0, 200)) AS b FROM pl),
dr AS (SELECT s.metric, s.b, p.* EXCLUDE (metric) FROM (SELECT *, CAST('0x' || substr(sha256('0-' || b || '-' || slot), 1, 12) AS BIGINT) % size AS pick FROM sl) s JOIN pl p ON p.metric = s.metric AND p.place = s.pick)"""


def _seeded(table: str, sums: str) -> str:
    """ds: ``sums`` of the values of ``table``, in units of 1e-12, over each of a thousand seeded resamples."""
    return f""", {draws_cte("SELECT count(*) AS size FROM p", stats.RESAMPLES)},
pl AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY item_id) - 1 AS place, count(*) OVER (PARTITION BY metric) AS size FROM {table}),
ds AS (SELECT metric, b, gd.size, {sums} FROM gd JOIN pl ON pl.size = gd.size AND pl.place = gd.place GROUP BY ALL)"""


_LABELLED_SEEDED = _LABELLED.replace("WITH", "WITH RECURSIVE", 1)


def _values(rows: list[tuple], name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(repr(x) if isinstance(x, str) else f'{x}::DOUBLE' if isinstance(x, float) else str(x) for x in r) + ')' for r in rows)})"


_RUNS_SQL = (
    _LABELLED
    + ", "
    + _values(RUNS, "r", "run_id, name, created_at, generation_hash")
    + """, m AS (SELECT 'r' || (e.label % 3) AS run_id, 'a' AS dataset, CASE metric WHEN 'precision_at_5' THEN 'recall_at_5' WHEN 'precision_at_10' THEN 'ndcg_at_10' ELSE metric END AS metric,
  round(avg(value), 6) AS value, min(value) AS lo, max(value) AS hi, CAST(count(*) AS INTEGER) AS n FROM lm JOIN embeddings e ON e.vec_id = lm.item_id GROUP BY ALL)"""
)
_WIDE = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {c} END) AS {m if c == 'value' else f'{m}_{c}'}" for m in runs.HEADLINE for c in ("value", "lo", "hi"))

#: bm25_flat: as bm25_cte without regard to length, on the tables that it has made.
_FLAT = """bz AS (SELECT query_id, bt.source, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2)), 6) AS score
  FROM bq JOIN bt USING (term) JOIN bf ON bf.source = bt.source AND bf.term = bt.term JOIN bs ON bs.source = bt.source GROUP BY query_id, bt.source, doc_id)"""


def _gold_ranks(scores: str, name: str) -> str:
    """name (query_id, r): the rank of the first document that holds the item among the ten best, of items with a best one."""
    return f"""{name} AS (SELECT t.query_id, min(CASE WHEN ct.doc_id IS NOT NULL THEN rank END) AS r FROM (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, doc_id) AS rank FROM {scores} QUALIFY rank <= 10) t
  LEFT JOIN ct ON ct.query_id = t.query_id AND ct.doc_id = t.doc_id WHERE t.query_id IN (SELECT query_id FROM ct) GROUP BY t.query_id)"""


SQL = {
    "regressed_items": f"""WITH {bm25_cte()}, {_FLAT}, {_CONTAINED}, {_gold_ranks("bm", "gb")}, {_gold_ranks("bz", "gc")},
v AS (SELECT gb.query_id AS item_id, round(coalesce(1 / gb.r, 0), 6) AS base_value, round(coalesce(1 / gc.r, 0), 6) AS cand_value, CAST(gb.r AS INTEGER) AS base_gold_rank, CAST(gc.r AS INTEGER) AS cand_gold_rank
  FROM gb JOIN gc ON gc.query_id = gb.query_id)
SELECT item_id, base_value, cand_value, round(cand_value - base_value, 6) AS delta, base_gold_rank, cand_gold_rank FROM v WHERE cand_value < base_value""",
    "gold_index": f"WITH {_PAGE_CHUNKS} SELECT url, page, chunk_id FROM gi",
    "gold_resolve": f"""
WITH {_PAGE_CHUNKS},
a AS (SELECT page_id AS item_id, unnest(list_distinct(CASE page_id % 5 WHEN 0 THEN ['https://nowhere.example/'] WHEN 1 THEN [split_part(url, '#', 1) || '#merged']
    WHEN 2 THEN [url, split_part(url, '#', 1) || '#other'] ELSE [url] END)) AS url FROM pages),
x AS (SELECT a.*, EXISTS (SELECT 1 FROM gi WHERE gi.url = a.url) AS exact, EXISTS (SELECT 1 FROM gi WHERE gi.page = split_part(a.url, '#', 1)) AS near FROM a),
c AS (SELECT DISTINCT x.item_id, gi.chunk_id FROM x JOIN gi ON (x.exact AND gi.url = x.url) OR (NOT x.exact AND gi.page = split_part(x.url, '#', 1)))
SELECT x.item_id, coalesce((SELECT string_agg(chunk_id, '|' ORDER BY chunk_id) FROM c WHERE c.item_id = x.item_id), '') AS gold_chunk_ids,
  CASE WHEN bool_or(NOT exact AND near) THEN 'page' ELSE 'anchor' END AS gold_granularity, CAST(count(*) FILTER (NOT exact AND NOT near) AS BIGINT) AS n_unresolved FROM x GROUP BY x.item_id""",
    "gold_by_containment": f"WITH {_CONTAINED} SELECT query_id, doc_id FROM ct",
    "per_item_metrics": _ITEM_METRICS + " SELECT item_id, metric, value FROM im",
    "aggregate_metrics": _ITEM_METRICS + " SELECT metric, count(*) AS n, round(avg(value), 5) AS value FROM im GROUP BY metric",
    "label_metrics": _LABELLED + " SELECT item_id, metric, value FROM lm",
    "bootstrap_ci": _LABELLED_SEEDED
    + _seeded("lm", "sum(CAST(round(value / 1e-12) AS HUGEINT)) AS total")
    + """, nt AS (SELECT metric, CAST(total AS DOUBLE) / (size / 1e-12) AS mean, row_number() OVER (PARTITION BY metric ORDER BY total, b) AS nth FROM ds)
SELECT 'labels' AS dataset, metric, round(max(CASE WHEN nth = 26 THEN mean END), 6) AS lo, round(max(CASE WHEN nth = 975 THEN mean END), 6) AS hi FROM nt GROUP BY metric""",
    "paired_bootstrap_seeded": _LABELLED_SEEDED
    + ", pr AS (SELECT 'precision' AS metric, item_id, p5 AS base, p10 AS cand FROM p)"
    + _seeded("pr", "sum(CAST(round(base / 1e-12) AS HUGEINT)) AS base, sum(CAST(round(cand / 1e-12) AS HUGEINT)) AS cand")
    + " SELECT 'labels' AS dataset, metric, round(avg(CAST(cand > base AS INTEGER)), 6) AS p_better FROM ds GROUP BY metric",
    "bootstrap_ci_hash": _LABELLED
    + _DRAWN.format(table="lm")
    + """, mn AS (SELECT metric, b, round(avg(value), 6) AS mean FROM dr GROUP BY ALL), nt AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean, b) AS nth FROM mn)
SELECT 'labels' AS dataset, metric, max(CASE WHEN nth = 6 THEN mean END) AS lo, max(CASE WHEN nth = 195 THEN mean END) AS hi FROM nt GROUP BY metric""",
    "paired_bootstrap": _LABELLED
    + ", pr AS (SELECT 'precision' AS metric, item_id, p5 AS base, p10 AS cand FROM p)"
    + _DRAWN.format(table="pr")
    + ", sm AS (SELECT metric, b, round(sum(base), 6) AS base, round(sum(cand), 6) AS cand FROM dr GROUP BY ALL) SELECT 'labels' AS dataset, metric, round(avg(CAST(cand > base AS INTEGER)), 6) AS p_better FROM sm GROUP BY metric",
    "leaderboard": _RUNS_SQL + f", w AS (SELECT run_id, max(n) AS n, {_WIDE} FROM m WHERE dataset = 'a' GROUP BY run_id) SELECT r.*, coalesce(w.n, 0) AS n, w.* EXCLUDE (run_id, n), CAST(row_number() OVER (ORDER BY created_at DESC) AS INTEGER) AS place FROM r LEFT JOIN w USING (run_id)",
    "compare_runs": _RUNS_SQL
    + """, b AS (SELECT metric, value FROM m WHERE run_id = 'r0' AND dataset = 'a'), c AS (SELECT run_id, metric, value FROM m WHERE run_id IN ('r1', 'r2') AND dataset = 'a'),
k AS (SELECT 'r1' AS cand_run UNION ALL SELECT 'r2'), j AS (SELECT k.cand_run, b.metric, b.value AS base, c.value AS cand FROM k CROSS JOIN b LEFT JOIN c ON c.run_id = k.cand_run AND c.metric = b.metric),
s AS (SELECT j.*, (SELECT generation_hash FROM r WHERE run_id = 'r0') = (SELECT generation_hash FROM r WHERE run_id = j.cand_run) AS same FROM j)
SELECT cand_run, metric, CASE WHEN same THEN base END AS base, CASE WHEN same THEN cand END AS cand, CASE WHEN same THEN round(cand - base, 6) END AS delta, CASE WHEN same THEN 'OK' ELSE 'CONFOUNDED' END AS status FROM s""",
    "gate": _RUNS_SQL
    + ", "
    + _values(THRESHOLDS, "t", "metric, floor, tolerance")
    + """, j AS (SELECT t.*, v.value, b.value AS baseline FROM t LEFT JOIN m v ON v.metric = t.metric AND v.run_id = 'r1' AND v.dataset = 'a' LEFT JOIN m b ON b.metric = t.metric AND b.run_id = 'r0' AND b.dataset = 'a'),
nt AS (SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN value < floor THEN 'floor' WHEN baseline IS NULL THEN 'no baseline' WHEN value < baseline - tolerance THEN 'regressed' WHEN value > baseline + 0.02 THEN 'improved' ELSE 'steady' END AS note FROM j)
SELECT metric, CASE WHEN note IN ('missing', 'floor', 'regressed') THEN 'FAIL' WHEN note = 'improved' THEN 'WARN' ELSE 'PASS' END AS verdict, value, floor, baseline, note FROM nt""",
}
