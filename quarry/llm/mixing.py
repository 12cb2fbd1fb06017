"""Mixing sources to target weights by hash thresholds.

A document's hash decides whether it is in the mix: those below its source's
threshold are taken once more than those above. Thresholds come from histograms:
words summed by source and leading bits of the hash; the running sum finds the
bucket where the budget ends, and only that bucket is summed again by its next
bits. When it holds few documents, they are tried one by one. A document that is
larger than what is left is passed over, and the search goes on behind that
bucket among the documents that are not, with a new threshold, until none is left:
the mix is what taking documents in order of their hash would give. Nothing is
sorted and, but for repeated rows, no document is moved; a larger budget takes all
that a smaller one does below its first threshold.

Rows that repeat a doc_id, text and source are numbered, so that each has a hash
of its own and a budget may end among them. They alone are written for that."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # times a source's words
BITS = 10  # of the hash at each level
DEPTH = 6  # levels
SENT = 50_000  # rows, of some 100 bytes, of a table that is sent to all tasks
FEW = 64  # documents of a bucket that are tried one by one; larger buckets are summed by more bits first
ALL = 2**63 - 1  # the last hash; a size that no row exceeds

#: Words of a text.
SIZE = r"CAST(coalesce(regexp_count(CAST(text AS STRING), '[^\\x20\\x09-\\x0D]+'), 0) AS LONG)"
#: 63 bits of a row's doc_id, text and, where it repeats others, number among them.
OWN = "xxhash64('mix', CAST(doc_id AS LONG), CAST(text AS STRING))"
HASH = "IF(__tie = 0, __own, xxhash64('tie', __own, __tie)) & 9223372036854775807"


@dataclass
class Source:
    name: str | None
    size: int
    target: float = 0.0
    times: int = 0  # how often every document is taken
    left: int = 0  # words still to be taken
    first: int = 0  # the first hash that is not decided
    largest: int = ALL  # rows above this size do not fit
    threshold: int = 0  # the bucket where the budget ends, by its leading bits
    level: int = 0
    done: bool = False
    taken: list[tuple[int, int, int]] = field(default_factory=list)  # first hash, last hash and largest size of rows taken
    chosen: list[tuple[int, int]] = field(default_factory=list)  # hashes taken one by one, and the largest size


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Sources by code point, null last, share by weight; what stops at its limit leaves its excess to the others."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > most * sizes[n]]
        if not over:
            return out | {n: left * weight[n] / total for n in open_}
        out |= {n: float(most * sizes[n]) for n in over}
        open_ = [n for n in open_ if n not in out]
        left -= sum(out[n] for n in over)
    return out


def _small(table: DataFrame, rows: int) -> DataFrame:
    """Sent to all tasks while it has ``SENT`` rows at most; beyond, a join that can split a large source."""
    return F.broadcast(table) if rows <= SENT else table


def _table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """One row for each source."""
    rows = [(s.name is None, s.name or "", s.size, s.target, s.times, s.taken) for s in sources]
    return _small(spark.createDataFrame(rows, "no_source boolean, source_key string, source_size long, target double, times int, taken array<struct<first:long,last:long,largest:long>>"), len(rows))


def _within(sizes: DataFrame, ranges: list[tuple[Source, int, int]]) -> DataFrame:
    """Rows of each source's range of hashes that are not too large for it; adds left and level."""
    rows = [(s.name is None, s.name or "", first, last, s.largest, s.left, s.level) for s, first, last in ranges]
    table = sizes.sparkSession.createDataFrame(rows, "no_source boolean, source_key string, first long, last long, largest long, left long, level int")
    return sizes.join(_small(table, len(rows)), KEY).where("h between first and last and size <= largest")


KEY = ["no_source", "source_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the source as __no_source and __source_key, __size and __own."""
    source = F.col("source").cast("string")
    return docs.withColumns({"__no_source": source.isNull(), "__source_key": F.coalesce(source, F.lit("")), "__size": F.expr(SIZE), "__own": F.expr(OWN)})


def _numbered(tables: common.Tables, docs: DataFrame) -> DataFrame:
    """Adds __tie: 0, 1, 2 and so on among rows of one source, doc_id and text.

    Only rows that repeat are moved. They are numbered within the parts of a
    table, and the parts within a repeated row, so none is a task of its own."""
    same = ["__no_source", "__source_key", "__own"]
    repeated = tables.write(docs.groupBy(*same).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"), "repeated")
    n = repeated.count()
    alone = docs.withColumn("__tie", F.lit(0).cast("long"))
    if not n:
        return alone
    few = _small(repeated, n)
    rows = tables.write(docs.join(few, same).withColumn("__row", F.monotonically_increasing_id()), "repeated_rows").withColumn("__part", F.shiftright("__row", 33))
    parts = rows.groupBy(*same, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*same).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = tables.write(parts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n"), "repeated_parts")
    nth = F.row_number().over(Window.partitionBy(*same, "__part").orderBy("__row")) - 1
    tied = rows.select(*same, "__part", "__row").withColumn("__nth", nth).join(parts, [*same, "__part"])
    tied = tables.write(tied.select("__row", (F.col("__before") + F.col("__nth")).alias("__tie")), "ties")
    numbered = rows.join(tied, "__row").select(*alone.columns)
    return alone.join(few, same, "left_anti").select(*alone.columns).unionByName(numbered)


def _bits(level: F.Column | int) -> F.Column:
    """The leading bits of the hash down to a level."""
    return F.expr(f"shiftright(h, 63 - {BITS} * ({level}))")


def _bucket(s: Source) -> tuple[int, int]:
    """First and last hash of the bucket that a source is at, as far as they are not decided."""
    shift = 63 - BITS * s.level
    return max(s.first, s.threshold << shift), ((s.threshold + 1) << shift) - 1


def thresholds(sizes: DataFrame) -> list[Source]:
    """``sizes``: no_source, source_key, size, h. What reaches the driver is a row for each source, and few documents."""
    totals = {None if r.no_source else r.source_key: r.size for r in sizes.groupBy(*KEY).agg(F.sum("size").alias("size")).collect()}
    goal = targets(totals)
    sources = []
    for name, size in totals.items():
        times = int(goal[name] // size) if size else 0
        s = Source(name, size, goal[name], times, int(goal[name] - times * size))
        s.done = s.left < 1
        sources.append(s)
    by_name = {s.name: s for s in sources}
    while not_done := [s for s in sources if not s.done]:
        # rows of each source's last bucket, summed by their next bits
        part = _within(sizes, [(s, *_bucket(s)) for s in not_done])
        buckets = part.groupBy(*KEY, "left", _bits("level + 1").alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        before = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = buckets.withColumn("upto", F.sum("size").over(before))
        # the first bucket that the budget does not cover whole
        ends = running.groupBy(*KEY).agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "upto", "size", "n"))).alias("b"), F.sum("n").alias("n"))
        found = {None if r.no_source else r.source_key: r for r in ends.collect()}
        tried, room = [], SENT
        for s in sorted(not_done, key=lambda s: found[s.name].n if s.name in found else 0):
            n, b = (found[s.name].n, found[s.name].b) if s.name in found else (0, None)
            if b is None:  # all that is left fits
                s.taken.append((s.first, ALL, s.largest))
                s.done = True
            elif s.first and not s.level and n <= room:  # so little is left behind a threshold that all can be tried
                room -= n
                tried.append((s, s.first, ALL))
            else:
                s.level, s.threshold, s.left = s.level + 1, b.bucket, s.left - (b.upto - b.size)
                if b.n <= FEW or s.level == DEPTH:
                    first, last = _bucket(s)
                    if first > s.first:
                        s.taken.append((s.first, first - 1, s.largest))
                    tried.append((s, first, last))
        if tried:
            rows = _within(sizes, tried).groupBy(*KEY, "h").agg(F.sum("size").alias("size"))
            for r in sorted(rows.collect(), key=lambda r: r.h):
                s = by_name[None if r.no_source else r.source_key]
                if r.size <= s.left:
                    s.left -= r.size
                    s.chosen.append((r.h, s.largest))
        for s, _, last in tried:
            s.done = s.left < 1 or last == ALL
            s.first, s.largest, s.threshold, s.level = last + 1, s.left, 0, 0
    return sources


def mix(docs: DataFrame, result: str = "mix") -> DataFrame:
    """All columns of ``docs`` (doc_id, text, source) and a struct size, source_size, target, copies.

    The struct is named ``result``, with underscores behind it where ``docs``
    has such a column already. Null text has no words. A source without words
    has target 0 and its documents are in the mix no times. Of repeated rows as
    many are taken as the budget holds. Empty tables give no rows.

    The driver holds a few hundred bytes for each source."""
    spark, columns, result = docs.sparkSession, docs.columns, common.free_name(docs, result)
    tables = common.Tables(spark)
    hashed = _numbered(tables, _keyed(docs)).withColumn("__h", F.expr(HASH))
    place = {"__no_source": "no_source", "__source_key": "source_key", "__size": "size", "__h": "h"}
    sources = thresholds(tables.write(hashed.select(*(F.col(k).alias(v) for k, v in place.items())), "sizes"))
    decided = _table(spark, sources).select(F.col("no_source").alias("__no_source"), F.col("source_key").alias("__source_key"), F.struct("source_size", "target", "times", "taken").alias("__s"))
    extra = [(s.name is None, s.name or "", h, largest) for s in sources for h, largest in s.chosen]
    chosen = _small(spark.createDataFrame(extra, "__no_source boolean, __source_key string, __h long, __most long"), len(extra))
    own = ["__no_source", "__source_key"]
    out = hashed.join(_small(decided, len(sources)), own, "left").join(chosen, [*own, "__h"], "left")
    once_more = F.expr("exists(__s.taken, x -> __h between x.first and x.last and __size <= x.largest) or __size <= __most")
    copies = F.coalesce(F.col("__s.times") + F.coalesce(once_more, F.lit(False)).cast("int"), F.lit(0))
    return out.select(*columns, F.struct(F.col("__size").alias("size"), "__s.source_size", "__s.target", copies.alias("copies")).alias(result))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    columns = docs.columns
    return mix(docs, "__mix").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix.copies")))).select(*columns)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken for every row of ``documents``; see ``mix`` for the defined cases."""
    mixed = mix(common.documents(spark, sf_dir, "doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))
