"""Queries of sectioning, packing and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, markdown
from quarry.plans.tables import LINES_SQL, MARKED_SQL, QAS_SQL, line_sizes, marked_pages, qas, table

BASE = "https://docs.example.org"


def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.sections(marked_pages(spark, sf_dir)).groupBy("path", "sec_no").agg(F.first("breadcrumb").alias("breadcrumb"), F.count("*").alias("n_lines"), F.min("ln").alias("first_line"))
    return rows.select("path", F.col("sec_no").cast("long"), "breadcrumb", "n_lines", F.col("first_line").cast("long"))


def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.blocks(chunking.sections(marked_pages(spark, sf_dir)))
    return rows.groupBy("path").agg(F.count("*").alias("n_blocks"), F.sum(F.col("is_code").cast("int")).cast("long").alias("n_code"), F.sum(F.char_length("block")).cast("long").alias("n_chars"))


def split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_sizes(spark, sf_dir).select("doc_id", F.explode(F.arrays_zip(chunking.split_groups(F.col("sizes")).alias("part"), F.col("sizes").alias("size"))).alias("x"))
    return rows.groupBy("doc_id", F.col("x.part").alias("part")).agg(F.count("*").alias("n_lines"), F.sum("x.size").cast("long").alias("n_tokens"))


def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_sizes(spark, sf_dir).select("doc_id", F.posexplode(chunking.packed(F.col("lines"))).alias("chunk", "text"))
    return rows.select("doc_id", "chunk", T.content_hash(F.col("text")).alias("content_hash"))


def merge_undersized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks, five to a top section."""
    made = lambda line, i: F.struct(line.alias("document"), F.concat(F.lit("s"), F.floor(i / 5).cast("string"), F.lit(" > t"), i.cast("string")).alias("section"), F.concat(F.lit("u"), i.cast("string")).alias("url"))
    d = line_sizes(spark, sf_dir).select("doc_id", F.posexplode(chunking.merge_undersized(F.transform("lines", made))).alias("nth", "c"))
    return d.select("doc_id", "nth", F.char_length("c.document").cast("long").alias("n_chars"), F.array_join("c.merged_urls", "|").alias("merged_urls"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages to chunks: each with a snippet of three lines of its document at the end; normalised, cut into sections, packed, merged, hashed."""
    name = F.regexp_replace("path", r"\.md$", "")
    pages = marked_pages(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n{* ../../src/s"), name, F.lit(".py ln[1:3] *}")))
    snippets = table(spark, sf_dir, "documents", "doc_id", "text").select(F.concat(F.lit("src/s"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))
    chunks = chunking.doc_chunks(markdown.normalize(pages, snippets), BASE)
    return chunks.select("chunk_id", "path", "section", "url", F.array_join("merged_urls", "|").alias("merged_urls"), "chunk_index", "parent_id", "content_hash", "n_tokens")


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qas(spark, sf_dir).select("discussion_id", "title", F.char_length("answer_body").cast("long").alias("n_answer"))


def qa_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.qa_chunks(qas(spark, sf_dir)).select("chunk_id", "title", "url", "category", "chunk_index", "parent_id", "content_hash", "n_tokens")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as long answers: cut by line and packed, the heavy part of a corpus build."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    q = d.select(F.col("doc_id").cast("string").alias("discussion_id"), F.lit("").alias("title"), F.lit("").alias("question_body"), F.col("text").alias("answer_body"), F.lit("").alias("url"), F.lit(None).cast("string").alias("category"))
    return chunking.qa_chunks(q).select("chunk_id", "chunk_index", "content_hash", "n_tokens")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_sizes(spark, sf_dir).select(F.explode(chunking.packed(F.col("lines"))).alias("document"))
    return chunking.chunk_stats(rows)


def eval_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring("question_body", 1, 500)
    question = F.when(head == "", F.col("title")).otherwise(F.concat_ws("\n\n", "title", head))
    return qas(spark, sf_dir).select("discussion_id", F.sha2(question, 256).alias("question_sha"), F.sha2("answer_body", 256).alias("ground_truth_sha"), "url")


def answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples whose answer has 200 characters, each under two set names, with the chunks that give it away."""
    q = qas(spark, sf_dir)
    kept = q.where(F.char_length(F.trim("answer_body")) >= 200)
    own = chunking.qa_chunks(q).groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), "|").alias("exclude"))
    items = kept.join(own, "url").select(F.element_at(F.split("url", "/"), -1).alias("item_id"), "exclude")
    return items.select(F.explode(F.array(F.lit("retrieval"), F.lit("generation"))).alias("dataset"), "item_id", "exclude")


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts, styles and tags, white space closed up."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.sha2(text, 256).alias("text_sha"), F.char_length(text).cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (section_split, section_blocks, split_oversized, pack_blocks, merge_undersized, doc_chunks, qa_pairs, qa_chunks, document_chunks, chunk_stats, eval_examples, answerable, html_strip)}

def _sectioned(lines: str, source: str) -> str:
    """s: the lines (path, ln, line) of ``source`` with their sections and fences."""
    return f"""
WITH RECURSIVE {lines},
trimmed AS (SELECT * FROM (SELECT *, max(ln) OVER (PARTITION BY path) AS last FROM {source}) WHERE NOT (ln = last AND line = '')),
a AS (SELECT *, starts_with(trim(line), '```') AS is_fence FROM trimmed),
b AS (SELECT *, sum(CAST(is_fence AS INTEGER)) OVER w AS fence_no FROM a WINDOW w AS (PARTITION BY path ORDER BY ln ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CASE WHEN NOT is_fence AND fence_no % 2 = 0 AND regexp_matches(trim(line), '^#{{2,3}}\\s') THEN length(regexp_extract(trim(line), '^(#{{2,3}})\\s', 1)) END AS level FROM b),
d AS (SELECT *, CASE WHEN level IS NOT NULL THEN trim(regexp_replace(trim(line), '^#{{2,3}}\\s+', '')) END AS title FROM c),
e AS (SELECT *, count(level) OVER w AS sec_no, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS h2,
    last_value(title IGNORE NULLS) OVER w AS heading, last_value(level IGNORE NULLS) OVER w AS hlevel
  FROM d WINDOW w AS (PARTITION BY path ORDER BY ln ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN sec_no = 0 THEN '' WHEN hlevel = 3 AND h2 IS NOT NULL THEN h2 || ' > ' || heading ELSE heading END AS breadcrumb FROM e
  QUALIFY max(CAST(trim(line) <> '' AS INTEGER)) OVER (PARTITION BY path, sec_no) = 1)"""


_SECTIONED = _sectioned(MARKED_SQL, "marked")
#: j: the lines of sections with their blocks.
_BLOCKED = """,
g AS (SELECT *, is_fence OR fence_no % 2 = 1 AS code FROM s),
h AS (SELECT *, NOT code AND trim(line) = '' AS blank FROM g),
i AS (SELECT *, lag(blank OR code) OVER (PARTITION BY path, sec_no ORDER BY ln) AS cut FROM h),
j AS (SELECT *, sum(CAST((is_fence AND fence_no % 2 = 1) OR (NOT code AND NOT blank AND coalesce(cut, true)) AS INTEGER)) OVER (PARTITION BY path, sec_no ORDER BY ln ROWS UNBOUNDED PRECEDING) AS block_no FROM i),
k AS (SELECT path, sec_no, block_no, trim(string_agg(line, chr(10) ORDER BY ln), chr(10)) AS block, max(CAST(is_fence AND fence_no % 2 = 0 AS INTEGER)) AS is_code FROM j WHERE NOT blank GROUP BY ALL)
"""

#: parts: each line's part, by a fold over the lines' sizes.
_PACK = """
WITH RECURSIVE {lines},
f AS (SELECT doc_id, i, size AS total, 0 AS part FROM lines WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN {closes} THEN l.size ELSE f.total + l.size END, CASE WHEN {closes} THEN f.part + 1 ELSE f.part END
  FROM f JOIN lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1)"""
_SPLIT = _PACK.format(lines=LINES_SQL, closes="f.total + l.size > 600")
_FILL = _PACK.format(lines=LINES_SQL, closes="f.total >= 400 AND f.total + l.size > 600")
_PACKED = _FILL + ", t AS (SELECT l.doc_id, f.part, string_agg(l.line, chr(10) || chr(10) ORDER BY l.i) AS text FROM lines l JOIN f ON l.doc_id = f.doc_id AND l.i = f.i GROUP BY l.doc_id, f.part)"


#: A fold over rows in order: what closes a part, by the sum so far (y.total) and the size at hand (x.size).
_FOLD = """{name} AS (SELECT {keys}, {at}, size AS total, 0 AS part FROM {rows} WHERE {at} = 1
  UNION ALL SELECT {of_x}, x.{at}, CASE WHEN {closes} THEN x.size ELSE y.total + x.size END, CASE WHEN {closes} THEN y.part + 1 ELSE y.part END
  FROM {name} y JOIN {rows} x ON {same} AND x.{at} = y.{at} + 1)"""
_SIZE = "greatest(1, CAST(ceil(length({x}) / 4.0) AS INTEGER))"


def _answer_chunks(source: str) -> str:
    """ac (id, idx, n, document): texts (id, body) of ``source`` cut and packed as answers are."""
    size, fold = _SIZE, _FOLD
    split = fold.format(name="sp", keys="id, block_no", at="j", rows="ol", of_x="x.id, x.block_no", same="x.id = y.id AND x.block_no = y.block_no", closes="y.total + x.size > 600")
    fill = fold.format(name="pk", keys="id", at="u", rows="uo", of_x="x.id", same="x.id = y.id", closes="y.total >= 400 AND y.total + x.size > 600")
    return f"""src AS ({source}),
pl AS (SELECT id, CASE WHEN body LIKE '%' || chr(10) THEN string_split(body, chr(10))[:-2] ELSE string_split(body, chr(10)) END AS p FROM src WHERE {size.format(x="body")} > 600),
la AS (SELECT id, i, p[i] AS line, starts_with(trim(p[i]), '```') AS is_fence FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM pl)),
lb AS (SELECT *, sum(CAST(is_fence AS INTEGER)) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS fence_no FROM la),
lc AS (SELECT *, is_fence OR fence_no % 2 = 1 AS code FROM lb),
ld AS (SELECT *, NOT code AND trim(line) = '' AS blank FROM lc),
le AS (SELECT *, lag(blank OR code) OVER (PARTITION BY id ORDER BY i) AS cut FROM ld),
lf AS (SELECT *, sum(CAST((is_fence AND fence_no % 2 = 1) OR (NOT code AND NOT blank AND coalesce(cut, true)) AS INTEGER)) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block_no FROM le),
bl AS (SELECT id, block_no, trim(string_agg(line, chr(10) ORDER BY i), chr(10)) AS block, max(CAST(is_fence AND fence_no % 2 = 0 AS INTEGER)) = 0 AND {size.format(x="trim(string_agg(line, chr(10) ORDER BY i), chr(10))")} > 600 AS splits FROM lf WHERE NOT blank GROUP BY ALL),
ol AS (SELECT id, block_no, j, line, {size.format(x="line")} AS size FROM (SELECT id, block_no, unnest(range(1, len(p) + 1)) AS j, unnest(p) AS line FROM (SELECT *, string_split(block, chr(10)) AS p FROM bl WHERE splits))),
{split},
un AS (SELECT id, block_no, 0 AS part, block AS text FROM bl WHERE NOT splits
  UNION ALL SELECT ol.id, ol.block_no, sp.part, string_agg(ol.line, chr(10) ORDER BY ol.j) FROM ol JOIN sp ON sp.id = ol.id AND sp.block_no = ol.block_no AND sp.j = ol.j GROUP BY ALL),
uo AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY block_no, part) AS u, text, {size.format(x="text")} AS size FROM un),
{fill},
long AS (SELECT uo.id, pk.part AS idx, string_agg(uo.text, chr(10) || chr(10) ORDER BY uo.u) AS document FROM uo JOIN pk ON pk.id = uo.id AND pk.u = uo.u GROUP BY uo.id, pk.part),
ac AS (SELECT id, 0 AS idx, 1 AS n, body AS document FROM src WHERE {size.format(x="body")} <= 600 UNION ALL SELECT id, idx, count(*) OVER (PARTITION BY id), document FROM long),
ck AS (SELECT *, CASE WHEN n = 1 THEN id ELSE id || '::' || idx END AS chunk_id, substr(sha256(document), 1, 16) AS content_hash, {size.format(x="document")} AS n_tokens FROM ac)"""


def _page_chunks() -> str:
    """The chunks of marked pages with their snippets: lines normalised, sections, blocks, splits, packs, and the fold that merges them."""
    heading, opening = r"^(#{1,6})\s+(.*?)\s*\{\s*#([\w-]+)\s*\}\s*$", r"^/{3,}\s*([A-Za-z][\w-]*)\s*(?:\|\s*(.*?)\s*)?$"
    kind, title = (f"regexp_extract(trim(line), '{opening}', {n})" for n in (1, 2))
    lines = f"""{MARKED_SQL},
snip AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END[1:3] AS p FROM documents),
nr AS (SELECT path, ln, line FROM marked UNION ALL
  SELECT doc_id || '.md', 1000000000 + unnest(range(len(p) + 2)), unnest(['```python'] || p || ['```']) FROM (SELECT doc_id, CASE WHEN len(p) = 0 THEN [''] ELSE p END AS p FROM snip)),
na AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY ln) - 1 AS ln, CASE WHEN regexp_matches(trim(line), '{opening}')
  THEN '*' || upper(substr({kind}, 1, 1)) || lower(substr({kind}, 2)) || CASE WHEN {title} <> '' THEN ': ' || {title} ELSE '' END || '*' ELSE line END AS line FROM nr),
an AS (SELECT path, list(anchor ORDER BY ln) AS anchors FROM (SELECT path, ln, regexp_extract(line, '{heading}', 3) AS anchor FROM na WHERE regexp_matches(line, '{heading}') AND length(regexp_extract(line, '{heading}', 1)) IN (2, 3)) GROUP BY path),
nl AS (SELECT path, ln, regexp_replace(line, '{heading}', '\\1 \\2') AS line FROM na)"""
    split = _FOLD.format(name="sp", keys="path, sec_no, block_no", at="j", rows="ol", of_x="x.path, x.sec_no, x.block_no", same="x.path = y.path AND x.sec_no = y.sec_no AND x.block_no = y.block_no", closes="y.total + x.size > 600")
    fill = _FOLD.format(name="pk", keys="path, sec_no", at="u", rows="uo", of_x="x.path, x.sec_no", same="x.path = y.path AND x.sec_no = y.sec_no", closes="y.total >= 400 AND y.total + x.size > 600")
    top = lambda x: f"split_part({x}, ' > ', 1)"
    return f"""{_sectioned(lines, "nl")}{_BLOCKED},
bl AS (SELECT *, is_code = 0 AND {_SIZE.format(x="block")} > 600 AS splits FROM k),
ol AS (SELECT path, sec_no, block_no, j, line, {_SIZE.format(x="line")} AS size FROM (SELECT path, sec_no, block_no, unnest(range(1, len(p) + 1)) AS j, unnest(p) AS line FROM (SELECT *, string_split(block, chr(10)) AS p FROM bl WHERE splits))),
{split},
un AS (SELECT path, sec_no, block_no, 0 AS part, block AS text FROM bl WHERE NOT splits
  UNION ALL SELECT ol.path, ol.sec_no, ol.block_no, sp.part, string_agg(ol.line, chr(10) ORDER BY ol.j) FROM ol JOIN sp ON sp.path = ol.path AND sp.sec_no = ol.sec_no AND sp.block_no = ol.block_no AND sp.j = ol.j GROUP BY ALL),
uo AS (SELECT path, sec_no, row_number() OVER (PARTITION BY path, sec_no ORDER BY block_no, part) AS u, text, {_SIZE.format(x="text")} AS size FROM un),
{fill},
made AS (SELECT uo.path, uo.sec_no, pk.part, string_agg(uo.text, chr(10) || chr(10) ORDER BY uo.u) AS document FROM uo JOIN pk ON pk.path = uo.path AND pk.sec_no = uo.sec_no AND pk.u = uo.u GROUP BY ALL),
named AS (SELECT m.path, row_number() OVER (PARTITION BY m.path ORDER BY m.sec_no, m.part) AS o, m.document, b.breadcrumb AS section,
    '{BASE}/' || regexp_replace(m.path, '[.]md$', '') || '/' || CASE WHEN m.sec_no > 0 AND m.sec_no <= coalesce(len(an.anchors), 0) THEN '#' || an.anchors[m.sec_no] ELSE '' END AS url
  FROM made m JOIN (SELECT path, sec_no, max(breadcrumb) AS breadcrumb FROM s GROUP BY ALL) b ON b.path = m.path AND b.sec_no = m.sec_no LEFT JOIN an ON an.path = m.path),
mg AS (SELECT path, o, document, section, url, CAST([] AS VARCHAR[]) AS urls, 0 AS nth FROM named WHERE o = 1
  UNION ALL SELECT x.path, x.o, CASE WHEN y.joins THEN y.document || chr(10) || chr(10) || x.document ELSE x.document END, CASE WHEN y.joins THEN y.section ELSE x.section END, CASE WHEN y.joins THEN y.url ELSE x.url END,
    CASE WHEN NOT y.joins THEN CAST([] AS VARCHAR[]) WHEN x.url <> y.url AND NOT list_contains(y.urls, x.url) THEN list_append(y.urls, x.url) ELSE y.urls END, CASE WHEN y.joins THEN y.nth ELSE y.nth + 1 END
  FROM (SELECT mg.*, {_SIZE.format(x="mg.document")} < 150 AND {top("mg.section")} = {top("z.section")} AS joins FROM mg JOIN named z ON z.path = mg.path AND z.o = mg.o + 1) y JOIN named x ON x.path = y.path AND x.o = y.o + 1),
last AS (SELECT * FROM mg QUALIFY row_number() OVER (PARTITION BY path, nth ORDER BY o DESC) = 1),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY nth) - 1 AS INTEGER) AS chunk_index FROM last WHERE {_SIZE.format(x="document")} >= 25)
SELECT substr(sha256(path || '::' || section || '::' || chunk_index), 1, 16) AS chunk_id, path, section, url, array_to_string(urls, '|') AS merged_urls, chunk_index,
  substr(sha256(path || '::' || {top("section")}), 1, 16) AS parent_id, substr(sha256(document), 1, 16) AS content_hash, {_SIZE.format(x="document")} AS n_tokens FROM kept"""


_QA_CHUNKS = f"WITH RECURSIVE {QAS_SQL}, " + _answer_chunks("SELECT discussion_id AS id, answer_body AS body FROM qas")

SQL = {
    "qa_chunks": _QA_CHUNKS + " SELECT chunk_id, title, url, '' AS category, CAST(idx AS INTEGER) AS chunk_index, substr(sha256(id), 1, 16) AS parent_id, content_hash, n_tokens FROM ck JOIN qas ON qas.discussion_id = ck.id",
    "document_chunks": "WITH RECURSIVE " + _answer_chunks("SELECT CAST(doc_id AS VARCHAR) AS id, text AS body FROM documents") + " SELECT chunk_id, CAST(idx AS INTEGER) AS chunk_index, content_hash, n_tokens FROM ck",
    "answerable": _QA_CHUNKS
    + """, ow AS (SELECT url, string_agg(DISTINCT chunk_id, '|' ORDER BY chunk_id) AS exclude FROM ck JOIN qas ON qas.discussion_id = ck.id GROUP BY url)
SELECT unnest(['retrieval', 'generation']) AS dataset, discussion_id AS item_id, exclude FROM qas JOIN ow ON ow.url = qas.url WHERE length(trim(answer_body)) >= 200""",
    "section_split": _SECTIONED + " SELECT path, CAST(sec_no AS BIGINT) AS sec_no, max(breadcrumb) AS breadcrumb, CAST(count(*) AS BIGINT) AS n_lines, CAST(min(ln) AS BIGINT) AS first_line FROM s GROUP BY path, sec_no",
    "section_blocks": _SECTIONED
    + _BLOCKED
    + """
SELECT path, CAST(count(*) AS BIGINT) AS n_blocks, CAST(sum(is_code) AS BIGINT) AS n_code, CAST(sum(length(block)) AS BIGINT) AS n_chars FROM k GROUP BY path""",
    "split_oversized": _SPLIT + " SELECT f.doc_id, f.part, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(l.size) AS BIGINT) AS n_tokens FROM f JOIN lines l ON l.doc_id = f.doc_id AND l.i = f.i GROUP BY f.doc_id, f.part",
    "pack_blocks": _PACKED + " SELECT doc_id, part AS chunk, substr(sha256(text), 1, 16) AS content_hash FROM t",
    "chunk_stats": _PACKED + ", n AS (SELECT greatest(1, CAST(ceil(length(text) / 4.0) AS INTEGER)) AS n FROM t) SELECT count(*) AS n_chunks, min(n) AS min_tokens, round(avg(n), 6) AS avg_tokens, max(n) AS max_tokens FROM n",
    "merge_undersized": f"""
WITH RECURSIVE {LINES_SQL},
f AS (SELECT doc_id, i, length(line) AS n, 0 AS nth, (i - 1) // 5 AS s, '' AS urls FROM lines WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN x THEN f.n + 2 + length(l.line) ELSE length(l.line) END, CASE WHEN x THEN f.nth ELSE f.nth + 1 END, CASE WHEN x THEN f.s ELSE (l.i - 1) // 5 END,
    CASE WHEN NOT x THEN '' WHEN f.urls = '' THEN 'u' || (l.i - 1) ELSE f.urls || '|u' || (l.i - 1) END
  FROM f JOIN (SELECT * FROM lines) l ON l.doc_id = f.doc_id AND l.i = f.i + 1, LATERAL (SELECT greatest(1, ceil(f.n / 4.0)) < 150 AND f.s = (l.i - 1) // 5 AS x)),
m AS (SELECT doc_id, nth, arg_max(n, i) AS n, arg_max(urls, i) AS urls FROM f GROUP BY doc_id, nth)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS INTEGER) AS nth, CAST(n AS BIGINT) AS n_chars, urls AS merged_urls FROM m WHERE greatest(1, ceil(n / 4.0)) >= 25""",
    "doc_chunks": _page_chunks(),
    "qa_pairs": f"WITH {QAS_SQL} SELECT discussion_id, title, CAST(length(answer_body) AS BIGINT) AS n_answer FROM qas",
    "eval_examples": f"""WITH {QAS_SQL} SELECT discussion_id, sha256(CASE WHEN question_body = '' THEN title ELSE title || chr(10) || chr(10) || substr(question_body, 1, 500) END) AS question_sha,
  sha256(answer_body) AS ground_truth_sha, url FROM qas""",
    "html_strip": r"""
WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS x FROM pages)
SELECT page_id, sha256(x) AS text_sha, CAST(length(x) AS BIGINT) AS n_chars FROM t""",
}
