"""Mergeable quantile summaries from Manku-Rajagopalan-Lindsay buffers, and what they answer held against the rows.

A summary is a sorted list of weighted points. Points come into buffers; when
several buffers of a level are full they collapse into one of the next level:
the points stand in order, each as often as its weight, and every W-th of them
stays with weight W, from the middle; for an even W the lower and the upper
middle take turns. Points that weigh W or more by themselves stay as they are,
so a collapse keeps as many different points as it has room for. Each collapse
can shift a rank by half of W, and the summary carries the sum of these shifts.
Buffers that fit into the budget are never collapsed. Collapses depend on the
points and their order alone; rows come sorted, so reruns agree.

Rows are counted by value first. No task takes a whole batch of a group: rows
are summarised for every stretch of ``STRETCH`` values apart, these summaries
are merged batch by batch (over wider stretches before, where values are so far
apart that a batch has more than ``FAN`` of them), and the batches' summaries
into the whole. The whole never sees a row.

Answers are then checked by a range join: every counted value finds, among the
answers of its batch and of the whole, those that it lies below. What falls
between two answers is known with its number, least and largest value; a target
that falls there too is found by cutting that range, in turns, into ``CELLS``
cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

WHOLE = -1
BUDGET = 1000  # points of a summary; the contract of op11 allows 2000
FAN_IN = 8  # buffers that collapse together
STRETCH = 4096
FAN = 16384  # stretches that are merged at once
CELLS = 1024
QUANTILES = 20
LARGEST = 9e16  # of 100 * money, so that it fits a long


def merged(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points in order, equal ones as one."""
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order]
    at = np.flatnonzero(np.diff(x, prepend=x[:1] - 1))
    return x[at], np.add.reduceat(w, at) if len(at) else w


def collapse(x: np.ndarray, w: np.ndarray, budget: int, upper: bool) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Different sorted points as ``budget`` points at most; how far a rank can shift; whether W was even."""
    if len(x) <= budget:
        return x, w, 0, False
    heavy, total, room = np.zeros(len(x), bool), int(w.sum()), budget
    while room > 1 and (more := ~heavy & (w * room >= total)).any():  # more than their share
        heavy |= more
        total, room = int(w[~heavy].sum()), budget - int(heavy.sum())
    light = np.flatnonzero(~heavy)
    step = -(-total // max(1, room))
    even = step % 2 == 0
    first = step // 2 + (1 if upper or not even else 0)  # from 1
    before = np.cumsum(w[light])
    n = -(-total // step)
    places = np.minimum(first + step * np.arange(n, dtype=np.int64), total)
    kept = light[np.searchsorted(before, places)]
    weight = np.full(n, step, np.int64)
    weight[-1] = total - step * (n - 1)
    x, w = merged(np.concatenate([x[heavy], x[kept]]), np.concatenate([w[heavy], weight]))
    return x, w, max(first - 1, step - first), even


class Sketch:
    """Buffers of one group while its points come in."""

    def __init__(self, budget: int):
        self.budget, self.error, self.upper = budget, 0, False
        self.levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[]]
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, x: np.ndarray, w: np.ndarray, error: int = 0) -> None:
        self.error += error
        self.rest.append((x, w))
        self.waiting += len(x)
        if self.waiting < self.budget:
            return
        x, w = (np.concatenate([p[k] for p in self.rest]) for k in (0, 1))
        whole = len(x) - len(x) % self.budget
        for at in range(0, whole, self.budget):
            self._full(0, *merged(x[at : at + self.budget], w[at : at + self.budget]))
        self.rest, self.waiting = [(x[whole:], w[whole:])], len(x) - whole

    def _full(self, level: int, x: np.ndarray, w: np.ndarray) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append((x, w))
        if len(self.levels[level]) == FAN_IN:
            taken, self.levels[level] = self.levels[level], []
            self._full(level + 1, *self._collapsed(taken))

    def _collapsed(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        x, w = merged(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        x, w, error, even = collapse(x, w, self.budget, self.upper)
        self.error += error
        self.upper ^= even
        return x, w

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """All buffers as one, pruned to the budget."""
        return self._collapsed([p for level in self.levels for p in level] + self.rest)


SUMMARY = "stream string, grp string, batch int, part long, n long, points long, error long, xs array<long>, ws array<long>, answers array<long>"


def _asked(x: np.ndarray, w: np.ndarray, end: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of summaries that stand one behind the other and end at ``end``: rows of each, which have q rows, and their answers, q - 1 each."""
    total = np.concatenate([[0], np.cumsum(w)])
    begin = np.concatenate([[0], end[:-1]])
    n = total[end] - total[begin]
    has = np.flatnonzero(n >= q)
    i = np.arange(1, q, dtype=np.int64)
    targets = -(-(i[None, :] * n[has, None]) // q) + total[begin[has], None]
    return n, has, x[np.searchsorted(total[1:], targets)]


def _summaries(budget: int, q: int):
    """Rows stream, grp, batch, part, error, xs, ws, those of a summary one behind the other, as ``SUMMARY``."""

    def rows(keys: list[pa.Array], error: np.ndarray, x: np.ndarray, w: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        n, has, answers = _asked(x, w, end, q)
        offsets = pa.array(np.concatenate([[0], end]), pa.int32())
        size = np.zeros(len(end), np.int64)
        size[has] = q - 1
        asked = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(answers.ravel(), pa.int64()))
        counts = np.diff(end, prepend=0)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (x, w)]
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(v, pa.int64()) for v in (n, counts, error)), *lists, asked], names=[c.split()[0] for c in SUMMARY.split(", ")])

    def alone(key: tuple, sketch: Sketch) -> pa.RecordBatch:
        x, w = sketch.points()
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return rows([pa.array([k], t) for k, t in zip(key, kinds, strict=True)], np.array([sketch.error]), x, w, np.array([len(x)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        open_: tuple[tuple, Sketch] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            changed = np.zeros(b.num_rows, bool)
            for k in range(4):
                changed[1:] |= pc.not_equal(b.column(k)[1:], b.column(k)[:-1]).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(changed)])
            error = b.column(4).to_numpy()
            ends = b.column(5).offsets.to_numpy()
            x, w = (b.column(k).flatten().to_numpy() for k in (5, 6))
            ends = ends - ends[0]
            key = lambda i: tuple(b.column(k)[i].as_py() for k in range(4))  # noqa: E731, B023
            at = np.concatenate([ends[first], [len(x)]])
            done = 0  # groups of this batch that are finished
            if open_ is not None:
                if key(0) == open_[0]:
                    stop = int(first[1]) if len(first) > 1 else b.num_rows
                    open_[1].add(x[: at[1]], w[: at[1]], int(error[:stop].sum()))
                    done = 1
                if not done or len(first) > 1:
                    yield alone(*open_)
                    open_ = None
            last = len(first) - 1
            if last > done:
                lo, hi = at[done], at[last]
                group = np.repeat(np.arange(last - done), np.diff(at[done : last + 1]))
                order = np.lexsort((x[lo:hi], group))
                gx, gw, group = x[lo:hi][order], w[lo:hi][order], group[order]
                new = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(gx, prepend=0) != 0))
                gx, gw, group = gx[new], np.add.reduceat(gw, new), group[new]
                shift = np.add.reduceat(error[first[done] : first[last]], first[done:last] - first[done])
                size = np.bincount(group, minlength=last - done)
                large = np.flatnonzero(size > budget)
                if len(large):
                    end = np.cumsum(size)
                    keep = np.ones(len(gx), bool)
                    pieces = []
                    for g in large.tolist():
                        s = slice(end[g] - size[g], end[g])
                        sketch = Sketch(budget)
                        sketch.add(gx[s], gw[s], int(shift[g]))
                        px, pw = sketch.points()
                        shift[g], size[g], keep[s] = sketch.error, len(px), False
                        pieces.append((np.full(len(px), g), px, pw))
                    group, gx, gw = (np.concatenate([v[keep], *(p[k] for p in pieces)]) for k, v in enumerate((group, gx, gw)))
                    order = np.lexsort((gx, group))
                    gx, gw = gx[order], gw[order]
                yield rows([b.column(k).take(pa.array(first[done:last])) for k in range(4)], shift, gx, gw, np.cumsum(size))
            if last >= done:
                sketch = Sketch(budget)
                sketch.add(x[at[last] :], w[at[last] :], int(error[first[last] :].sum()))
                open_ = key(int(first[last])), sketch
        if open_ is not None:
            yield alone(*open_)

    return run


def _step(points: DataFrame, keys: list[str], budget: int, q: int) -> DataFrame:
    """``points``: stream, grp, batch, part, error, xs, ws, and an order ``nth`` within ``keys``."""
    dealt = points.repartition(*keys).sortWithinPartitions(*keys, "nth")
    return dealt.select("stream", "grp", "batch", "part", "error", "xs", "ws").mapInArrow(_summaries(budget, q), SUMMARY)


def counted(rows: DataFrame) -> DataFrame:
    """``rows``: stream, grp, batch, x, c. One row for each value of a batch, with how many rows have it."""
    return rows.groupBy("stream", "grp", "batch", "x").agg(F.sum("c").alias("c"))


def batch_summaries(counts: DataFrame, budget: int = BUDGET, q: int = QUANTILES) -> DataFrame:
    """``SUMMARY`` of every batch of every group of ``counts`` (a written table)."""
    span = counts.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    width = STRETCH
    floor = lambda v: F.expr(f"(x - pmod(x, {v})) div {v}")
    points = counts.select("stream", "grp", "batch", floor(width).alias("part"), F.lit(0).cast("long").alias("error"), F.array("x").alias("xs"), F.array("c").alias("ws"), F.col("x").alias("nth"))
    while True:
        points = _step(points, ["stream", "grp", "batch", "part"], budget, q)
        if span.a is None or (span.b - span.a) // width <= FAN:
            break
        width *= FAN
        points = points.withColumn("nth", F.col("part")).withColumn("part", F.expr(f"(part - pmod(part, {FAN})) div {FAN}"))
    return _step(points.withColumn("nth", F.col("part")).withColumn("part", F.lit(0).cast("long")), ["stream", "grp", "batch"], budget, q)


def whole_summaries(batches: DataFrame, budget: int = BUDGET, q: int = QUANTILES) -> DataFrame:
    """The summaries of the batches, and no row, as one of each group: batch is -1."""
    return _step(batches.withColumn("nth", F.col("batch")).withColumn("batch", F.lit(WHOLE)), ["stream", "grp"], budget, q)


def _met(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """Every counted value with each row of ``asked`` (stream, grp, ask_batch, ...) that asks for its batch or for the whole.

    The group leaves as ``key``: what is summed up by it is dealt anew, so Spark may split a group that has very many rows."""
    both = counts.join(asked, ["stream", "grp"]).where((F.col("ask_batch") == WHOLE) | (F.col("ask_batch") == F.col("batch")))
    return both.withColumn("key", F.struct("stream", "grp", F.col("ask_batch").alias("batch")))


def verified(tables: common.Tables, counts: DataFrame, summaries: DataFrame, q: int = QUANTILES) -> DataFrame:
    """stream, grp, batch, i, n, target, exact_x, points, answer, n_below, n_upto, rank_error, within, error of summaries of q rows and more."""
    asks = tables.write(summaries.where(F.col("n") >= q).select("stream", "grp", "batch", "n", "points", "error", "answers"), "asks")
    # a row for each group, with the answers of its batches and of the whole; written, so that Spark can split a group that has very many values
    per_group = tables.write(asks.groupBy("stream", "grp").agg(F.collect_list(F.struct("batch", "answers")).alias("asked")), "asked")
    met = counts.join(per_group, ["stream", "grp"])
    met = met.select("stream", "grp", "batch", "x", "c", F.explode(F.filter("asked", lambda a: (a.batch == WHOLE) | (a.batch == F.col("batch")))).alias("a"))
    place = lambda less: sum((F.when(less(F.get("a.answers", F.lit(k))), 1).otherwise(0) for k in range(q - 1)), F.lit(0))
    met = met.select(F.struct("stream", "grp", F.col("a.batch").alias("batch")).alias("key"), "x", "c", place(lambda a: a < F.col("x")).alias("p"), place(lambda a: a <= F.col("x")).alias("u"))
    # between two answers p = u; values that are answers p + 1 to u have bins of their own: 2 q at most for a key
    bins = met.groupBy("key", "p", "u").agg(F.sum("c").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).select("key.*", "p", "u", "s", "lo", "hi")
    summed = bins.withColumn("upto", F.sum("s").over(Window.partitionBy("stream", "grp", "batch").orderBy(F.col("p") + F.col("u"))))
    summed = summed.join(asks.drop("answers"), ["stream", "grp", "batch"]).withColumn("below", F.col("upto") - F.col("s"))
    none = F.lit(None).cast("long")
    keys, names = ["stream", "grp", "batch", "n", "points", "error", "i"], ("answer", "n_below", "n_upto", "base", "lo", "hi")
    run = lambda first, last: F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    row = lambda i, *values: F.struct(i.alias("i"), *(v.alias(c) for v, c in zip(values, names, strict=True)))
    # a bin answers i from p + 1 to u, and holds the targets i with below < ceil(i * n / q) <= upto
    answered = F.transform(run(F.col("p") + 1, F.col("u")), lambda i: row(i, F.col("lo"), F.col("below"), F.col("upto"), none, none, none))
    aimed = F.transform(run(F.expr(f"{q} * below div n + 1"), F.expr(f"least({q} * upto div n, {q - 1})")), lambda i: row(i, none, none, none, F.col("below"), F.col("lo"), F.col("hi")))
    told = summed.select("stream", "grp", "batch", "n", "points", "error", F.inline(F.concat(answered, aimed)))
    told = told.groupBy(*keys).agg(*(F.max(c).alias(c) for c in names))
    told = tables.write(told.withColumn("target", F.expr(f"(i * n + {q - 1}) div {q}")), "told")
    exact = _narrowed(tables, counts, told)
    out = told.join(exact, ["stream", "grp", "batch", "i"], "left").withColumn("exact_x", F.coalesce("found", "lo"))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return out.withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= 10 * F.col("n")).select("stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within", "error")


def _narrowed(tables: common.Tables, counts: DataFrame, told: DataFrame) -> DataFrame:
    """stream, grp, batch, i, found: the value of each target that is only known to lie between ``lo`` and ``hi``."""
    names = ["stream", "grp", "batch", "i"]
    found = None
    open_ = told.where("lo < hi").select(*names, "target", "base", "lo", "hi")
    while True:
        asked = open_.withColumn("width", F.expr(f"(hi - lo) div {CELLS} + 1")).withColumnRenamed("batch", "ask_batch")
        met = _met(counts, asked).where("x between lo and hi")
        cells = met.groupBy("key", "i", F.expr("(x - lo) div width").alias("cell")).agg(F.sum("c").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("target").alias("target"), F.first("base").alias("base"))
        before = F.sum("s").over(Window.partitionBy("key", "i").orderBy("cell")) - F.col("s")  # CELLS rows at most
        new = cells.withColumn("base", F.col("base") + before).where((F.col("base") < F.col("target")) & (F.col("target") <= F.col("base") + F.col("s")))
        open_ = tables.write(new.select("key.*", "i", "target", "base", "lo", "hi"), "narrowed")
        sure = open_.where("lo = hi").select(*names, F.col("lo").alias("found"))
        found = sure if found is None else found.unionByName(sure)
        open_ = open_.where("lo < hi")
        if not open_.take(1):
            return tables.write(found, "exact")


def summarised(rows: DataFrame, budget: int = BUDGET, q: int = QUANTILES) -> DataFrame:
    """Quantiles of every batch of every group of ``rows`` (stream, grp, batch, x, c), and of every group, with their exact counts.

    ``c`` is how many rows a row stands for. Summaries of fewer than ``q`` rows
    are merged but not asked. Empty tables give no rows."""
    tables = common.Tables(rows.sparkSession)
    counts = tables.write(counted(rows), "counts")
    batches = tables.write(batch_summaries(counts, budget, q), "batch_summaries")
    out = tables.write(verified(tables, counts, batches.unionByName(whole_summaries(batches, budget, q)), q), "quantiles")
    tables.drop(out)
    return out


def batch_of(id_: Column) -> Column:
    """crc32 of the decimal id, mod 16; a missing id counts as empty text."""
    return (F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 16).cast("int")


def value_of(money: Column, batch: Column) -> Column:
    """floor(100 * money + 0.5) + 1000 * batch; null where money is null, no number, or too large for a long."""
    cents = F.floor(100 * money.cast("double") + 0.5)
    return F.when(F.abs(100 * money.cast("double")) < LARGEST, cents + 1000 * batch)  # NaN is larger than any number


def shop_streams(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """stream, grp, batch, x, c: clicks by client, prices of sold items by brand.

    Rows of one click_id are one click: where they differ, the smallest client
    and value count, and what one lacks another may have; clicks without an id
    are one together. Items of one item_id likewise. Rows without client, brand
    or a usable number, and lines whose item is missing, go."""
    once = clicks.groupBy("click_id").agg(F.min("client_id").alias("client_id"), F.min("value").alias("money"))
    value = once.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), batch_of(F.col("click_id")).alias("batch"), "money", F.lit(1).cast("long").alias("c"))
    sold = sale_lines.where("item_id is not null").groupBy("item_id", batch_of(F.col("vendor_id")).alias("batch")).agg(F.count("*").alias("c"))
    priced = items.groupBy("item_id").agg(F.min("brand").alias("grp"), F.min("price").alias("money"))
    price = sold.join(priced, "item_id").select(F.lit("price").alias("stream"), "grp", "batch", "money", "c")
    both = value.unionByName(price).select("stream", "grp", "batch", value_of(F.col("money"), F.col("batch")).alias("x"), "c")
    return both.where("grp is not null and x is not null")


def op11_quantile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of clicks by client and of sold prices by brand; see ``shop_streams`` for what rows count and ``summarised`` for the rest."""
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    return summarised(shop_streams(read("clicks", "click_id", "client_id", "value"), read("sale_lines", "item_id", "vendor_id"), read("items", "item_id", "brand", "price")))

