"""Sections, blocks and token-bounded chunks.

Lines are dealt out by document once; windows, groups and folds that follow
keep that dealing, so there is one shuffle from text to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import scratch
from quarry.functions import text as T

FLOOR, CEILING = 400, 600
MERGE_BELOW, DROP_BELOW = 150, 25
SECTION = r"^(#{2,3})\s+(.*?)\s*$"


def sections(docs: DataFrame, key: str = "path") -> DataFrame:
    """Rows of key, sec_no, heading_title, breadcrumb, ln, line, is_fence, fence_no of sections with a line that is not blank.

    A heading of level two or three opens a section unless it stands in a fence."""
    ordered = Window.partitionBy(key).orderBy("ln")
    sofar = ordered.rowsBetween(Window.unboundedPreceding, 0)
    rows = docs.select(key, F.posexplode(T.lines(F.col("text"))).alias("ln", "line"))
    rows = rows.withColumn("is_fence", F.trim("line").startswith("```"))
    rows = rows.withColumn("fence_no", F.sum(F.col("is_fence").cast("int")).over(sofar))
    trimmed = F.trim("line")
    opens = ~F.col("is_fence") & (F.col("fence_no") % 2 == 0) & trimmed.rlike(SECTION)
    rows = rows.withColumn("level", F.when(opens, F.char_length(F.regexp_extract(trimmed, SECTION, 1)))).withColumn("title", F.when(opens, F.regexp_extract(trimmed, SECTION, 2)))
    rows = rows.withColumns(
        {
            "sec_no": F.count("level").over(sofar),
            "h2": F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(sofar),
            "heading_title": F.last("title", ignorenulls=True).over(sofar),
            "heading_level": F.last("level", ignorenulls=True).over(sofar),
        }
    )
    breadcrumb = F.when(F.col("sec_no") == 0, F.lit("")).when((F.col("heading_level") == 3) & F.col("h2").isNotNull(), F.concat_ws(" > ", "h2", "heading_title")).otherwise(F.col("heading_title"))
    whole = Window.partitionBy(key, "sec_no")
    rows = rows.withColumn("filled", F.max((trimmed != "").cast("int")).over(whole)).where("filled = 1")
    return rows.select(key, "sec_no", "heading_title", breadcrumb.alias("breadcrumb"), "ln", "line", "is_fence", "fence_no")


def blocks(lines: DataFrame, key: str = "path") -> DataFrame:
    """Blocks of each section: fenced code whole, prose between blank lines. key, sec_no, block_no, block, is_code."""
    ordered = Window.partitionBy(key, "sec_no").orderBy("ln")
    code = F.col("is_fence") | (F.col("fence_no") % 2 == 1)
    blank = ~code & (F.trim("line") == "")
    opening = F.col("is_fence") & (F.col("fence_no") % 2 == 1)
    rows = lines.withColumns({"blank": blank, "code": code, "opening": opening})
    rows = rows.withColumn("before", F.lag(F.struct("blank", "code", "fence_no")).over(ordered))
    first = F.col("opening") | (~F.col("code") & ~F.col("blank") & (F.col("before").isNull() | F.col("before.blank") | F.col("before.code")))
    rows = rows.withColumn("block_no", F.sum(first.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where("not blank")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
    closed = F.max((F.col("is_fence") & (F.col("fence_no") % 2 == 0)).cast("int")) == 1
    keep = [F.first(c).alias(c) for c in ("heading_title", "breadcrumb")]
    return rows.groupBy(key, "sec_no", "block_no").agg(F.btrim(joined, F.lit("\n")).alias("block"), closed.alias("is_code"), *keep)


def _grouped(sizes: Column, closes) -> Column:
    """For each size the number of its group, from 0: a fold that closes a group where ``closes(sum, size)``."""

    def step(acc: Column, n: Column) -> Column:
        new = (acc["sum"] > 0) & closes(acc["sum"], n)
        group = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(F.when(new, n).otherwise(acc["sum"] + n).alias("sum"), group.alias("g"), F.array_append(acc["out"], group).alias("out"))

    start = F.struct(F.lit(0).cast("int").alias("sum"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.transform(sizes, lambda n: n.cast("int")), start, step, lambda acc: acc["out"])


def split_groups(sizes: Column) -> Column:
    """Parts of an oversized block by the estimates of its lines: never above the ceiling, but for single lines."""
    return _grouped(sizes, lambda total, n: total + n > CEILING)


def pack_groups(sizes: Column) -> Column:
    """Chunks of blocks: closed at the floor once the next block would pass the ceiling."""
    return _grouped(sizes, lambda total, n: (total >= FLOOR) & (total + n > CEILING))


def _joined_by(parts: Column, groups: Column, glue: str) -> Column:
    """Array of texts, the parts of each group joined."""
    def texts(pairs: Column) -> Column:
        last = F.coalesce(F.element_at(pairs, -1)["g"], F.lit(-1))
        of = lambda g: F.array_join(F.transform(F.filter(pairs, lambda p: p["g"] == g), lambda p: p["part"]), glue)
        return F.when(F.size(pairs) > 0, F.transform(F.sequence(F.lit(0), last), of)).otherwise(F.array().cast("array<string>"))

    return T.let(F.arrays_zip(parts.alias("part"), groups.alias("g")), texts)


def atomic(block: Column, is_code: Column) -> Column:
    """What cannot be split: code and blocks up to the ceiling as they are, longer prose in parts by line."""
    parts = T.let(T.lines(block), lambda rows: _joined_by(rows, split_groups(F.transform(rows, T.token_estimate)), "\n"))
    return F.when(~is_code & (T.token_estimate(block) > CEILING), parts).otherwise(F.array(block))


def packed(units: Column) -> Column:
    return T.let(units, lambda u: _joined_by(u, pack_groups(F.transform(u, T.token_estimate)), "\n\n"))


def top_section(breadcrumb: Column) -> Column:
    return F.split_part(breadcrumb, F.lit(" > "), F.lit(1))


def merge_undersized(chunks: Column) -> Column:
    """Fold over a page's chunks (document, section, url, ...): a chunk below 150 tokens takes in the next one of its
    top section; those below 25 go at the end. Adds merged_urls, the other addresses taken in."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (T.token_estimate(last["document"]) < MERGE_BELOW) & (top_section(last["section"]) == top_section(x["section"]))
        other = (F.coalesce(x["url"], F.lit("")) != "") & ~x["url"].eqNullSafe(last["url"])
        urls = F.when(other, F.array_union(last["merged_urls"], F.array(x["url"]))).otherwise(last["merged_urls"])
        taken = last.withField("document", F.concat_ws("\n\n", last["document"], x["document"])).withField("merged_urls", urls)
        return F.when(joins, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), taken)).otherwise(F.array_append(acc, x))

    fresh = F.transform(chunks, lambda c: c.withField("merged_urls", F.array().cast("array<string>")))
    merged = F.aggregate(fresh, F.slice(fresh, 1, 0), step)
    return F.filter(merged, lambda c: T.token_estimate(c["document"]) >= DROP_BELOW)


def doc_chunks(docs: DataFrame, base_url: str) -> DataFrame:
    """Chunks of normalised pages (path, text, anchors) in the shape of the chunk table.

    A section's anchor is the one of its number among the anchors of levels two
    and three, so a heading without id shifts those after it."""
    docs = scratch.written(docs.select("path", "text", "anchors"), "pages")  # read twice, normalised once
    rows = blocks(sections(docs.select("path", "text")))
    units = rows.groupBy("path", "sec_no").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block_no", atomic(F.col("block"), F.col("is_code")).alias("units")))), lambda b: b["units"])).alias("units"),
        F.first("breadcrumb").alias("section"),
        F.first("heading_title").alias("heading_title"),
    )
    nth = F.count("heading_title").over(Window.partitionBy("path").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, 0))
    pages = docs.select("path", F.filter("anchors", lambda a: a["level"].isin(2, 3)).alias("deep"), F.coalesce(F.get(F.filter("anchors", lambda a: a["level"] == 1), F.lit(0))["title"], F.lit("")).alias("title"))
    sectioned = units.withColumn("nth", nth).join(pages, "path")
    anchor = F.when(F.col("heading_title").isNotNull(), F.get(F.col("deep"), F.col("nth").cast("int") - 1)["anchor"])
    sectioned = sectioned.withColumn("url", T.doc_url(F.col("path"), anchor, base_url))
    made = F.transform(packed(F.col("units")), lambda t: F.struct(t.alias("document"), F.col("section").alias("section"), F.col("url").alias("url")))
    page = sectioned.groupBy("path").agg(F.first("title").alias("title"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("sec_no", made.alias("made")))), lambda s: s["made"])).alias("made"))
    out = page.select("path", "title", F.posexplode(merge_undersized(F.col("made"))).alias("chunk_index", "c"))
    hashed = lambda *parts: T.content_hash(F.concat_ws("::", *parts))
    return out.select(
        hashed(F.col("path"), F.col("c.section"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.lit("docs").alias("source"),
        F.lit("docs").alias("source_type"),
        F.col("c.document").alias("document"),
        "title",
        F.col("c.section").alias("section"),
        "path",
        F.lit(None).cast("string").alias("question"),
        F.lit(None).cast("string").alias("category"),
        F.col("c.url").alias("url"),
        F.col("c.merged_urls").alias("merged_urls"),
        "chunk_index",
        hashed(F.col("path"), top_section(F.col("c.section"))).alias("parent_id"),
        T.content_hash(F.col("c.document")).alias("content_hash"),
        T.token_estimate(F.col("c.document")).alias("n_tokens"),
    )


def qa_chunks(qas: DataFrame) -> DataFrame:
    """Chunks of answered questions (discussion_id, title, question_body, answer_body, url, category).

    A short answer stays one chunk as it is; a long one is cut into blocks and packed."""
    short = T.token_estimate(F.col("answer_body")) <= CEILING
    keep = ["discussion_id", "title", "question_body", "url", "category"]
    small = qas.where(short).select(*keep, F.lit(0).alias("chunk_index"), F.lit(1).alias("n"), F.col("answer_body").alias("document"))
    # an answer has no sections: a key of its own for every line's document, one section
    long = qas.where(~short)
    rows = long.select(F.col("discussion_id").alias("path"), F.posexplode(T.lines(F.col("answer_body"))).alias("ln", "line")).withColumn("is_fence", F.trim("line").startswith("```"))
    sofar = Window.partitionBy("path").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"fence_no": F.sum(F.col("is_fence").cast("int")).over(sofar), "sec_no": F.lit(0), "heading_title": F.lit(""), "breadcrumb": F.lit("")})
    units = blocks(rows).groupBy("path").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block_no", atomic(F.col("block"), F.col("is_code")).alias("units")))), lambda b: b["units"])).alias("units"))
    cut = units.select(F.col("path").alias("discussion_id"), packed(F.col("units")).alias("docs")).select("discussion_id", F.size("docs").alias("n"), F.posexplode("docs").alias("chunk_index", "document"))
    both = small.unionByName(long.select(*keep).join(cut, "discussion_id").select(*keep, "chunk_index", "n", "document"))
    chunk_id = F.when(F.col("n") == 1, F.col("discussion_id")).otherwise(F.concat_ws("::", "discussion_id", F.col("chunk_index").cast("string")))
    return both.select(
        chunk_id.alias("chunk_id"),
        F.lit("discussions").alias("source"),
        F.lit("discussion").alias("source_type"),
        "document",
        "title",
        F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("string").alias("path"),
        F.substring("question_body", 1, 500).alias("question"),
        F.coalesce("category", F.lit("")).alias("category"),
        "url",
        F.array().cast("array<string>").alias("merged_urls"),
        "chunk_index",
        T.content_hash(F.col("discussion_id")).alias("parent_id"),
        T.content_hash(F.col("document")).alias("content_hash"),
        T.token_estimate(F.col("document")).alias("n_tokens"),
    )


def chunk_stats(chunks: DataFrame, text: str = "document") -> DataFrame:
    n = T.token_estimate(F.col(text))
    return chunks.agg(F.count("*").alias("n_chunks"), F.min(n).alias("min_tokens"), F.round(F.avg(n), 6).alias("avg_tokens"), F.max(n).alias("max_tokens"))
