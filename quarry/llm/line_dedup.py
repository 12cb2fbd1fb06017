"""Line dedup in DataFrame functions only.

Lines are exploded with their positions and keyed by two independent 64-bit
hashes of the normalised line. Counting the documents of a key combines on the
map side. Keys over the threshold are joined back to the positions, which are
gathered for each text; lines themselves never move. Each text is then split
anew and reassembled from the positions that stay, which a hash set finds in
one pass, however many go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

LEAST_LENGTH = 20  # code points of a key
LEAST_DOCUMENTS = 3
KEY = ["h1", "h2"]


def _keys(text: F.Column) -> F.Column:
    """Position and key of each line of the text that is long enough to have one."""
    key = lambda line: F.btrim(line, F.lit(common.ASCII_SPACE))
    keyed = F.transform(F.transform(F.split(common.ascii_lower(text), "\n", -1), key), lambda k, i: F.struct(i.alias("position"), k.alias("k")))
    hashed = lambda x: F.struct(x["position"].alias("position"), F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit("second"), x["k"]).alias("h2"))
    return F.transform(F.filter(keyed, lambda x: F.char_length(x["k"]) >= LEAST_LENGTH), hashed)


def _id() -> F.Column:
    """Null joins null and comes before any other."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def _lost(docs: DataFrame, least_documents: int) -> DataFrame:
    """__id, __xx (hash of the text) and __lost, the positions of the lines that go."""
    # the hash of a text is computed before its lines are exploded: behind that it would be computed for each
    hashed = docs.select(_id().alias("__id"), F.xxhash64("text").alias("__xx"), "text")
    keyed = hashed.select("__id", "__xx", F.explode(_keys(F.col("text"))).alias("k"))
    lines = common.written(keyed.select("__id", "__xx", "k.*"), "lines")
    counted = lines.select("__id", *KEY).distinct().groupBy(*KEY).agg(F.count("*").alias("n"), F.max("__id").alias("last"))
    frequent = common.written(counted.where(F.col("n") >= least_documents).drop("n"), "frequent_lines")
    # both sides of this join are tables, so a line that is in a third of all documents can be split
    return lines.join(frequent, KEY).where("__id <> last").groupBy("__id", "__xx").agg(F.collect_set("position").alias("__lost"))


def dedup(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, result: str = "line_dedup") -> DataFrame:
    """All columns of ``docs`` with ``text`` less the dropped lines, and a struct n_lines, n_dropped.

    The struct is named ``result``, with underscores behind it where ``docs``
    has such a column already. Null or empty text is one empty line. Rows of one
    doc_id count as one document, and so do rows whose doc_id is null (which
    comes before any other). A key that repeats within the document that keeps
    it keeps all its lines; repeated rows lose the same lines. An empty table
    gives no rows."""
    result, columns = common.free_name(docs, result), docs.columns
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    both = docs.withColumns({"__id": _id(), "__xx": F.xxhash64("text")}).join(_lost(docs, least_documents), ["__id", "__xx"], "left")
    # the arrays are computed in these projections once, then only read
    both = both.withColumn("__lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__lost")
    both = both.withColumn("__stay", F.when(F.col("__lost").isNotNull(), stay))
    kept = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n"))
    n = F.size("__lines").cast("long")
    counts = F.struct(n.alias("n_lines"), (n - F.coalesce(F.size("__stay"), F.size("__lines"))).alias("n_dropped"))
    return both.withColumn("text", kept).select(*columns, counts.alias(result))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the line dedup of whole ``documents``; see ``dedup`` for the defined cases."""
    return dedup(common.documents(spark, sf_dir)).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
    trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
f AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.line, f.k IS NOT NULL AND l.doc_id <> f.keeper AS dropped FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
