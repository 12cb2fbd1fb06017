"""Markdown normalisation: snippet macros, terminal blocks, admonitions, heading anchors.

Every step maps a text to a text within its row. Only the macros meet another
table, the snippets, by an equi-join on their path."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import text as T

#: Fixed patterns: the syntax of the pages.
MACRO = r"\{\*\s*(\S+)([^*]*)\*\}"
TERMY = r"""(?s)<div\s+class=["']termy["']\s*>\s*\n.*?\n</div>"""
TERMY_BODY = r"""(?s)^<div\s+class=["']termy["']\s*>\s*\n(.*?)\n</div>$"""
INLINE_TAG = r"</?(?:font|span|u|b|i|div)\b[^>]*>"
OPENING = r"^/{3,}\s*([A-Za-z][\w-]*)\s*(?:\|\s*(.*?)\s*)?$"
CLOSING = r"^/{3,}\s*$"
HEADING = r"^(#{1,6})\s+(.*?)\s*\{\s*#([\w-]+)\s*\}\s*$"


def snippet_path(raw: Column) -> Column:
    """The macro's path without ``.`` and ``..`` segments."""
    return F.array_join(F.filter(F.split(raw, "/"), lambda p: ~p.isin("", ".", "..")), "/")


def line_ranges(attrs: Column) -> Column:
    """``ln[1:9,12]`` as structs first, last; null without it."""
    inner = F.regexp_extract(attrs, r"ln\[([\d,:]+)\]", 1)
    bounds = lambda part: F.struct(F.split_part(part, F.lit(":"), F.lit(1)).cast("int").alias("first"), F.element_at(F.split(part, ":"), -1).cast("int").alias("last"))
    return F.when(inner != "", F.transform(F.split(inner, ","), bounds))


def _block(path: Column, raw: Column, attrs: Column, content: Column) -> Column:
    """The fenced block that stands for a macro; a snippet that is missing leaves a note."""
    ranges = line_ranges(attrs)
    pick = lambda rows: F.flatten(F.transform(ranges, lambda r: F.slice(rows, r["first"], F.greatest(r["last"] - r["first"] + 1, F.lit(0)))))
    code = F.array_join(T.let(T.lines(content), lambda rows: F.when(ranges.isNull(), rows).otherwise(pick(rows))), "\n")
    suffix = F.regexp_extract(path, r"\.([^./]+)$", 1)
    language = F.when(suffix == "py", F.lit("python")).otherwise(suffix)
    missing = F.concat(F.lit("```python\n# snippet not found: "), raw, F.lit("\n```"))
    return F.when(content.isNull(), missing).otherwise(F.concat(F.lit("```"), language, F.lit("\n"), code, F.lit("\n```")))


def resolve_code_macros(docs: DataFrame, snippets: DataFrame) -> DataFrame:
    """``docs`` (path, text) with each macro replaced by its snippet (path, content).

    Texts without a macro pass by the join."""
    found = F.regexp_extract_all("text", F.lit(MACRO), F.lit(0))
    parts = docs.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(MACRO), F.lit(0))).alias("pos", "macro"))
    parts = parts.select("path", "pos", F.regexp_extract("macro", MACRO, 1).alias("raw"), F.regexp_extract("macro", MACRO, 2).alias("attrs"))
    parts = parts.withColumn("snippet", snippet_path(F.col("raw")))
    joined = parts.join(snippets.select(F.col("path").alias("snippet"), "content"), "snippet", "left")
    blocks = joined.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", _block(F.col("snippet"), F.col("raw"), F.col("attrs"), F.col("content")).alias("block")))).alias("__blocks"))
    gaps = F.split("text", MACRO, -1)
    woven = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("__blocks"), i)["block"], F.lit("")))), "")
    return docs.join(blocks, "path", "left").withColumn("text", F.when(F.size(found) > 0, woven).otherwise(F.col("text"))).drop("__blocks")


@F.pandas_udf(StringType())
def unescape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Named and numeric HTML entities; Spark has no built-in for all of them."""
    for s in texts:
        yield s.map(html.unescape, na_action="ignore")


def strip_termy(docs: DataFrame) -> DataFrame:
    """Terminal blocks lose their wrapper, inline tags and entities; other HTML stays.

    One pass: of texts without such a block the entity decoder gets a null."""
    mark = "\x00"
    held = F.col("text").rlike(TERMY)
    body = lambda b: F.regexp_replace(F.regexp_extract(b, TERMY_BODY, 1), INLINE_TAG, "")
    bodies = F.when(held, F.array_join(F.transform(F.regexp_extract_all("text", F.lit(TERMY), F.lit(0)), body), mark))
    rows = docs.withColumn("__bodies", unescape(bodies)).withColumns({"__bodies": F.split("__bodies", mark, -1), "__gaps": F.when(F.col("__bodies").isNotNull(), F.split("text", TERMY, -1))})
    trimmed = lambda i: F.btrim(F.coalesce(F.get(F.col("__bodies"), i), F.lit("")), F.lit("\n"))
    woven = F.array_join(F.transform("__gaps", lambda g, i: F.concat(g, F.when(i < F.size("__gaps") - 1, trimmed(i)).otherwise(F.lit("")))), "")
    return rows.withColumn("text", F.when(F.col("__gaps").isNotNull(), woven).otherwise(F.col("text"))).drop("__bodies", "__gaps")


def convert_admonitions(text: Column) -> Column:
    """Openings become a marker line, closings go while a block is open; a stray one stays.

    The depth is a fold over the lines, clamped at zero."""
    label = lambda s: F.concat(F.upper(F.substring(F.regexp_extract(s, OPENING, 1), 1, 1)), F.lower(F.substring(F.regexp_extract(s, OPENING, 1), 2, 1 << 30)))
    title = lambda s: F.regexp_extract(s, OPENING, 2)
    marker = lambda s: F.concat(F.lit("*"), label(s), F.when(title(s) != "", F.concat(F.lit(": "), title(s))).otherwise(F.lit("")), F.lit("*"))

    def step(acc: Column, line: Column) -> Column:
        s = F.trim(line)
        closes, opens = (acc["depth"] > 0) & s.rlike(CLOSING), s.rlike(OPENING)
        depth = F.when(closes, acc["depth"] - 1).when(opens, acc["depth"] + 1).otherwise(acc["depth"])
        out = F.when(closes, acc["out"]).when(opens, F.array_append(acc["out"], marker(s))).otherwise(F.array_append(acc["out"], line))
        return F.struct(depth.alias("depth"), out.alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(T.lines(text), start, step, lambda acc: acc["out"]), "\n")


def heading_anchors(text: Column) -> Column:
    """Structs level, title, anchor of all headings with an explicit id, in order."""
    hits = F.filter(T.lines(text), lambda x: x.rlike(HEADING))
    return F.transform(hits, lambda x: F.struct(F.char_length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("title"), F.regexp_extract(x, HEADING, 3).alias("anchor")))


def clean_headings(text: Column) -> Column:
    """Headings without their ``{ #id }``."""
    clean = lambda x: F.when(x.rlike(HEADING), F.concat(F.regexp_extract(x, HEADING, 1), F.lit(" "), F.regexp_extract(x, HEADING, 2))).otherwise(x)
    return F.array_join(F.transform(T.lines(text), clean), "\n")


def normalize(docs: DataFrame, snippets: DataFrame) -> DataFrame:
    """``docs`` (path, text) in the fixed order of steps; adds anchors."""
    out = strip_termy(resolve_code_macros(docs, snippets))
    out = out.withColumn("text", convert_admonitions(F.col("text")))
    return out.withColumns({"anchors": heading_anchors(F.col("text")), "text": clean_headings(F.col("text"))})
