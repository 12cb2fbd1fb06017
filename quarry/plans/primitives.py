"""Queries of the text primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import markdown
from quarry.plans.tables import MARKED_SQL, marked_pages, table


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def bm25_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.bm25_tokens(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("tokens_sha"))


def trigram_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.trigram_tokens(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(T.trigrams(tokens)).cast("long").alias("n_trigrams"))


def page_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.page_of(F.col("url")).alias("page"), T.url_section(F.col("url")).alias("section"))


def doc_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    kind = F.col("doc_id") % 3
    path = F.when(kind == 0, F.lit("index.md")).when(kind == 1, F.concat("source", F.lit("/index.md"))).otherwise(F.concat("source", F.lit("/page-"), F.col("doc_id").cast("string"), F.lit(".md")))
    return d.select("doc_id", T.doc_url(path, F.when(F.col("lang") == "en", F.lit("top")), "https://docs.example.org/").alias("url"), T.path_section(path).alias("section"))


def fake_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.fake_embedding(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(v).alias("place", "value")).select("doc_id", "place", F.round("value", 9).alias("value"))


def model_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["BAAI/bge-small-en-v1.5", "nomic-embed-text"]
    return spark.createDataFrame([(n, T.model_slug(n), f"{s}__{T.model_slug(n)}") for n in names for s in ("docs", "discussions")], "model string, slug string, collection string")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked_pages(spark, sf_dir).select("path", F.posexplode(markdown.heading_anchors(F.col("text"))).alias("nth", "a"))
    return rows.select("path", "nth", F.col("a.level").alias("level"), F.col("a.title").alias("title"), F.col("a.anchor").alias("anchor"))


def clean_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_pages(spark, sf_dir).select("path", F.sha2(markdown.clean_headings(F.col("text")), 256).alias("text_sha"))


def admonitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents; a line that opens a block goes before every third line and one that closes it before every seventh, strays included."""
    lines = F.split("text", "\n", -1)
    mark = lambda line, i: F.when(i % 7 == 6, F.array(F.lit("///"), line)).when(i % 3 == 1, F.array(F.concat(F.lit("/// noTE | part "), i.cast("string")), line)).otherwise(F.array(line))
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(F.flatten(F.transform(lines, mark)), "\n").alias("text"))
    return d.select("doc_id", F.sha2(markdown.convert_admonitions(F.col("text")), 256).alias("text_sha"))


def code_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document with macros of whole and partial snippets; documents are the snippets as well."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    snippets = d.select(F.concat(F.lit("src/s"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))
    me = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Before\n{* ../../src/s"), me, F.lit(".py ln[1:2,4] hl[2] *}\nbetween\n{* ../../src/none"), me, F.lit(".py *}\nafter"))
    return markdown.resolve_code_macros(d.select(me.alias("path"), text.alias("text")), snippets).select("path", F.sha2("text", 256).alias("text_sha"))


def termy_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, escaped, in a terminal block; other tags stand around it."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    text = F.concat(F.lit("<b>kept</b>\n<div class=\"termy\">\n\n<font color=\"red\">"), escaped, F.lit("</font> &lt;x&gt; &amp; &eacute;\n\n</div>\nend"))
    return markdown.strip_termy(d.select(F.col("doc_id").cast("string").alias("path"), text.alias("text"))).select("path", F.sha2("text", 256).alias("text_sha"))


QUERIES = {f.__name__: f for f in (token_estimate, content_hash, bm25_tokenize, trigram_tokenize, page_of, doc_url, fake_embed, model_slugs, headings, clean_headings, admonitions, code_macros, termy_strip)}

_BM25 = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[._][a-z0-9]+)*')"

SQL = {
    "token_estimate": "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS INTEGER)) AS n_tokens FROM documents",
    "content_hash": "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents",
    "bm25_tokenize": f"SELECT doc_id, CAST(len({_BM25}) AS BIGINT) AS n_tokens, sha256(array_to_string({_BM25}, ' ')) AS tokens_sha FROM documents",
    "trigram_tokenize": """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens,
  CAST(len(list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS BIGINT) AS n_trigrams FROM t""",
    "page_of": """
SELECT page_id, split_part(url, '#', 1) AS page,
  coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)', 1), ''), '_root') AS section FROM pages""",
    "doc_url": """
WITH p AS (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN 'index.md' WHEN 1 THEN source || '/index.md' ELSE source || '/page-' || doc_id || '.md' END AS path FROM documents)
SELECT doc_id, 'https://docs.example.org/' || CASE WHEN path = 'index.md' THEN '' WHEN path LIKE '%/index.md' THEN left(path, length(path) - 8) ELSE left(path, length(path) - 3) || '/' END
  || CASE WHEN lang = 'en' THEN '#top' ELSE '' END AS url, split_part(path, '/', 1) AS section FROM p""",
    "fake_embed": """
SELECT doc_id, CAST(i AS INTEGER) AS place, round(CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) / 255.0::DOUBLE, 9) AS value
FROM (SELECT doc_id, text, unnest(range(0, 8)) AS i FROM documents)""",
    "model_slugs": """
SELECT model, lower(replace(regexp_replace(model, '^.*/', ''), '.', '')) AS slug, s || '__' || lower(replace(regexp_replace(model, '^.*/', ''), '.', '')) AS collection
FROM (VALUES ('BAAI/bge-small-en-v1.5'), ('nomic-embed-text')) m(model), (VALUES ('docs'), ('discussions')) t(s)""",
    "headings": f"""
WITH {MARKED_SQL}, h AS (SELECT path, ln, regexp_extract(line, '^(#{{1,6}})\\s+(.*?)\\s*\\{{\\s*#([\\w-]+)\\s*\\}}\\s*$', ['a', 'b', 'c']) AS g FROM marked
  WHERE regexp_matches(line, '^#{{1,6}}\\s+.*?\\s*\\{{\\s*#[\\w-]+\\s*\\}}\\s*$'))
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY ln) - 1 AS INTEGER) AS nth, CAST(length(g.a) AS INTEGER) AS level, g.b AS title, g.c AS anchor FROM h""",
    "clean_headings": f"""
WITH {MARKED_SQL}
SELECT path, sha256(coalesce(string_agg(regexp_replace(line, '^(#{{1,6}})\\s+(.*?)\\s*\\{{\\s*#([\\w-]+)\\s*\\}}\\s*$', '\\1 \\2'), chr(10) ORDER BY ln) FILTER (NOT (ln = last AND line = '')), '')) AS text_sha
FROM (SELECT *, max(ln) OVER (PARTITION BY path) AS last FROM marked) GROUP BY path""",
    "admonitions": """
WITH RECURSIVE r AS (SELECT doc_id, i - 1 AS i, p[i] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, sub) - 1 AS ln, line, count(*) OVER (PARTITION BY doc_id) AS n FROM (
    SELECT doc_id, i, 1 AS sub, x AS line FROM r
    UNION ALL SELECT doc_id, i, 0, CASE WHEN i % 7 = 6 THEN '///' ELSE '/// noTE | part ' || i END FROM r WHERE i % 7 = 6 OR i % 3 = 1)),
k AS (SELECT *, regexp_matches(trim(line), '^/{3,}\\s*$') AS closes, regexp_matches(trim(line), '^/{3,}\\s*[A-Za-z][\\w-]*\\s*(?:\\|\\s*(.*?)\\s*)?$') AS opens FROM l),
f AS (
  SELECT doc_id, ln, CAST(opens AS INTEGER) AS depth, false AS dropped FROM k WHERE ln = 0
  UNION ALL
  SELECT k.doc_id, k.ln, CASE WHEN f.depth > 0 AND k.closes THEN f.depth - 1 WHEN k.opens THEN f.depth + 1 ELSE f.depth END, f.depth > 0 AND k.closes
  FROM f JOIN k ON k.doc_id = f.doc_id AND k.ln = f.ln + 1),
o AS (SELECT k.doc_id, k.ln, k.n, f.dropped, CASE WHEN k.opens THEN '*Note' || CASE WHEN trim(regexp_extract(trim(k.line), '\\|\\s*(.*?)\\s*$', 1)) <> '' THEN ': ' || regexp_extract(trim(k.line), '\\|\\s*(.*?)\\s*$', 1) ELSE '' END || '*' ELSE k.line END AS line
  FROM k JOIN f ON k.doc_id = f.doc_id AND k.ln = f.ln)
SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT dropped AND NOT (ln = n - 1 AND line = '')), '')) AS text_sha FROM o GROUP BY doc_id""",
    "code_macros": """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS p, text FROM documents),
c AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN p[:-2] ELSE p END AS p FROM s)
SELECT CAST(doc_id AS VARCHAR) AS path, sha256('Before' || chr(10) || '```python' || chr(10) || array_to_string(p[1:2] || p[4:4], chr(10)) || chr(10) || '```' || chr(10) || 'between' || chr(10)
  || '```python' || chr(10) || '# snippet not found: ../../src/none' || doc_id || '.py' || chr(10) || '```' || chr(10) || 'after') AS text_sha FROM c""",
    "termy_strip": """
SELECT CAST(doc_id AS VARCHAR) AS path, sha256('<b>kept</b>' || chr(10) || ltrim(text || ' <x> & é', chr(10)) || chr(10) || 'end') AS text_sha FROM documents""",
}
