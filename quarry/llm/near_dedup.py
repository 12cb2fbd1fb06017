"""Near-duplicate documents by HyperMinHash.

A document is the set of its word shingles, as 64-bit hashes. Documents with the
same set form one class. A class's sketch has 256 buckets, chosen by the hash's
first bits; each register holds, of its bucket's smallest remaining hash, the
number of leading zeros and the ten bits behind the first one. Bands of six
registers, empty ones lent by a bucket that is chosen alike for all sets, bring
classes together. The Jaccard coefficient is estimated from the registers,
corrected for those that agree by chance, and pairs that lie five standard
deviations below the threshold go. What remains is confirmed on the full sets.

No group is paired off. In each bucket of a band the first class is held against
the others; what that links is one component already. Buckets whose other
members are still of several components form clusters. A cluster gets a centre,
the shingles that most of a few of its members have, and each member is written
as its difference D from the centre. With per_cent = t a pair is linked exactly
where W(a) + W(b) <= 2 (100 + t) |D(a) & D(b)|, W = (100 + t) |D| - (100 - t) n.
So the member with the least W, say m, is linked to all with W <= -W(m), and
members of this core need no further look: one pass over the cluster. Only the
others can have a link that is not known yet, and such a link needs shared
differences. They are held against all members in blocks of bounded size, on
inverted lists of differences, exactly and whatever the centre; what a task
gives is a spanning set of the links it finds.

Hashes: a word of up to 256 bytes is a sum over its letters with a random odd
multiplier for each place, mixed, so two given words agree with a chance of
2**-56 at most, whatever their letters; a longer word is its BLAKE2 digest.
Classes are told apart by two sums over all hashes, mixed differently, and the
count."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.common import mix64
from quarry.llm.components import components

BUCKETS = 256
MANTISSA = 10
BANDS, ROWS = 42, 6  # a pair at 0.8 shares no band with a chance of 3 in a million
DEVIATIONS = 5
TOGETHER = 100  # texts that one copy of a pivot's text, or of a centre, serves
CENTRE_OF, CENTRE_SHINGLES = 31, 500_000  # members that a centre is drawn from, and their shingles (one member at least)
BLOCK, BLOCK_SHINGLES = 1000, 250_000  # members of a block, and differences in it, about; one member at least
SLICE = 1 << 20  # bytes of text that are hashed together
WORD = 256  # bytes of a word that is hashed letter by letter

_rng = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = _rng.integers(1, 2**63, WORD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _lenders() -> np.ndarray:
    """For each empty bucket an order of all buckets; the first filled one lends."""
    return np.random.default_rng(7).random((BUCKETS, BUCKETS))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _long_word(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a lower-cased text that ends with white space begins, and its hash."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return first, np.zeros(0, np.uint64)
    lengths = end - first
    letters = np.flatnonzero(~space)
    place = np.minimum(letters - np.repeat(first, lengths), WORD - 1)
    begin = np.cumsum(lengths) - lengths
    words = mix64(np.add.reduceat((data[letters].astype(np.uint64) + np.uint64(1)) * _LETTER[place], begin) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > WORD).tolist():
        words[i] = _long_word(text[first[i] : end[i]])
    return first, words


def _slices(raw: memoryview | bytes) -> Iterator[bytes]:
    """A text, lower-cased, in slices that end behind white space; a slice above twice ``SLICE`` is one word."""
    at, rest, spaces = 0, b"", common.ASCII_SPACE.encode()
    while at < len(raw):
        chunk = common.lowered(raw[at : at + SLICE])
        at += SLICE
        if len(rest) >= SLICE:  # no white space so far
            end = min((i for i in map(chunk.find, (bytes([c]) for c in spaces)) if i >= 0), default=None)
            if end is None:
                rest += chunk
                continue
            yield rest + chunk[: end + 1]
            rest, chunk = b"", chunk[end + 1 :]
        rest += chunk
        cut = max(rest.rfind(c) for c in spaces) + 1
        if cut:
            yield rest[:cut]
            rest = rest[cut:]
    if rest:
        yield rest + b" "


def _joined(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles of a run of words of at least ``size``."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : n + k] * _SHINGLE[k]
    return mix64(out)


def _few(words: np.ndarray) -> np.ndarray:
    """Fewer words than a shingle has are one shingle together."""
    return mix64(np.array([(words * _SHINGLE[: len(words)]).sum() + np.uint64(len(words))], np.uint64)) if len(words) else np.zeros(0, np.uint64)


def shingle_sets(raws: list, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (its bytes as they are)."""
    if len(raws) == 1 and len(raws[0]) > SLICE:
        # a slice of one long word is not taken apart
        words = np.concatenate([_words(s)[1] if len(s) <= 2 * SLICE else np.array([_long_word(s.strip(common.ASCII_SPACE.encode()))] if s.strip() else [], np.uint64) for s in _slices(raws[0])])
        return [np.unique(_joined(words, size)) if len(words) >= size else _few(words)]
    first, words = _words(common.lowered(b" ".join(raws) + b" "))
    joined = _joined(words, size)
    of = np.searchsorted(first, np.cumsum([0] + [len(t) + 1 for t in raws])).tolist()
    return [np.unique(joined[i : j - size + 1]) if j - i >= size else _few(words[i:j]) for i, j in zip(of, of[1:], strict=False)]


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each bucket's smallest hash; 0 is an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (shingles >> np.uint64(56)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = ((shingles[at] << np.uint64(8)) >> np.uint64(11)).astype(np.float64)  # 53 bits
    m, e = np.frexp(rest)
    zeros = np.where(rest > 0, 53 - e, 53)
    mantissa = np.where(rest > 0, (m * 2 * (1 << MANTISSA)).astype(np.int64) - (1 << MANTISSA), 0)
    out[bucket[at]] = ((zeros + 1) << MANTISSA) + mantissa
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """Keys of the bands of each sketch (rows of registers, none empty as a whole)."""
    lent = np.arange(BUCKETS)[None, :].repeat(len(sketches), 0)
    for i in np.flatnonzero((sketches == 0).any(1)).tolist():
        filled, empty = np.flatnonzero(sketches[i]), np.flatnonzero(sketches[i] == 0)
        lent[i, empty] = filled[_lenders()[empty][:, filled].argmin(1)]
    value = np.take_along_axis(sketches.astype(np.int64), lent, 1) * BUCKETS + lent
    value = mix64(value[:, : BANDS * ROWS].astype(np.uint64)).reshape(len(sketches), BANDS, ROWS)
    return mix64((value * _BAND).sum(2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _batches(texts: list) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > SLICE:
            yield first, i
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


SKETCH = "doc_id long, xx long, n long, d1 long, d2 long, regs binary, keys array<long>"


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for b in batches:
            texts = [common.raw_bytes(t) for t in b.column(2)]
            n, d1, d2, regs, keys = [], [], [], [], []
            for i, j in _batches(texts):
                sets = shingle_sets(texts[i:j], size)
                n += [len(s) for s in sets]
                d1 += [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                d2 += [int(mix64(s ^ _BASE).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                own = np.stack([registers(s) for s in sets])
                regs += [r.tobytes() for r in own]
                full = own.any(1)
                made = iter(bands(own[full]) if full.any() else [])
                keys += [next(made) if f else np.zeros(0, np.int64) for f in full.tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(k) for k in keys]), pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), pa.array(regs, pa.binary()), lists], names=["doc_id", "xx", "n", "d1", "d2", "regs", "keys"])

    return run


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How likely the registers of a bucket agree although their hashes differ."""
    i = np.arange(54)[:, None]
    share = lambda n: (1 - 2.0 ** -(i + 1)) ** (n / BUCKETS) - np.where(i > 0, (1 - 2.0**-i), 0) ** (n / BUCKETS)
    return (share(n_a) * share(n_b)).sum(0) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corrected Jaccard coefficient and its standard deviation at 0.8."""
    used = ((a != 0) | (b != 0)).sum(1)
    agree = ((a == b) & (a != 0)).sum(1) / np.maximum(used, 1)
    c = chance(n_a, n_b)
    return (agree - c) / (1 - c), np.sqrt(0.16 / np.maximum(used, 1))


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5)]
            j, sd = estimate(*regs, *(b.column(k).to_numpy().astype(float) for k in (2, 3)))
            keep = pa.array(j >= threshold - DEVIATIONS * sd)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["p", "q"])

    return run


def _confirmed(size: int, per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, np.zeros(0, np.uint64)
        for b in batches:
            links = []
            p, salt, q = (b.column(k).to_pylist() for k in (0, 1, 2))
            texts = [common.raw_bytes(t) for t in b.column(3)]
            for i, j in _batches(texts):
                for k, s in enumerate(shingle_sets(texts[i:j], size), i):
                    if q[k] is None:
                        group, own = (p[k], salt[k]), s
                        continue
                    assert group == (p[k], salt[k]), "a pair without its pivot"
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= per_cent * (len(own) + len(s) - both):
                        links.append((p[k], q[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _links(tables: common.Tables, pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Those of the pairs (p, q) that the estimate lets through and the full sets confirm."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    sized = pairs.join(side("p"), "p").join(side("q"), "q").where(100 * F.least("n_p", "n_q") >= per_cent * F.greatest("n_p", "n_q"))
    likely = tables.write(sized.select("p", "q", "n_p", "n_q", "regs_p", "regs_q").mapInArrow(_likely(per_cent / 100), "p long, q long"), "likely")
    count = tables.write(likely.groupBy("p").agg(F.expr(f"int((count(*) - 1) div {TOGETHER} + 1)").alias("salts")), "pivots")
    pivots = count.select(F.col("p").alias("node"), "p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("q"))
    others = likely.join(count, "p").select(F.col("q").alias("node"), "p", F.pmod(F.xxhash64("q"), "salts").cast("int").alias("salt"), "q")
    dealt = tables.write(pivots.unionByName(others), "dealt").join(texts, "node").select("p", "salt", "q", "text")
    return dealt.repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("q").asc_nulls_first()).mapInArrow(_confirmed(size, per_cent), "u long, v long")


def _centred(size: int):
    def run(table: pa.Table) -> pa.Table:
        sets = [s for t in table.column("text").combine_chunks() for s in shingle_sets([common.raw_bytes(t)], size)]
        values, count = np.unique(np.concatenate(sets), return_counts=True)
        return pa.table({"cluster": table.column("cluster")[:1], "centre": pa.array([values[2 * count > len(sets)].tobytes()], pa.binary())})

    return run


def _differences(size: int):
    """Batches cluster, salt, node, label, centre, text: a centre (node is null) comes before the texts it serves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, np.zeros(0, np.uint64)
        for b in batches:
            cluster, salt, node, label = (b.column(k).to_pylist() for k in range(4))
            texts, rows = [common.raw_bytes(t) for t in b.column(5)], []
            for i, j in _batches(texts):
                for k, own in enumerate(shingle_sets(texts[i:j], size), i):
                    if node[k] is None:
                        group, centre = (cluster[k], salt[k]), np.frombuffer(b.column(4)[k].as_py(), np.uint64)
                        continue
                    assert group == (cluster[k], salt[k]), "a text without its centre"
                    d = np.setxor1d(own, centre, assume_unique=True)
                    rows.append((cluster[k], node[k], label[k], len(own), len(d), d.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 5 + [pa.binary()])], names=["cluster", "node", "label", "n", "size", "diff"])

    return run


def _spanning(per_cent: int):
    """Outer members of one block against the members of another: the links that join components, as few as tell the same."""

    def run(table: pa.Table) -> pa.Table:
        outer = table.column("outer").to_numpy().astype(bool)
        node, label, weight = (table.column(k).to_numpy() for k in ("node", "label", "weight"))
        diff = [np.frombuffer(d, np.uint64) for d in table.column("diff").to_pylist()]
        ours, theirs = np.flatnonzero(outer), np.flatnonzero(~outer)
        values = np.concatenate([diff[i] for i in theirs] or [np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(theirs)), [len(diff[i]) for i in theirs])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        u, v = [], []
        for i in ours.tolist():
            a, b = np.searchsorted(values, diff[i]), np.searchsorted(values, diff[i], side="right")
            length = b - a
            at = np.repeat(a - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
            shared = np.bincount(owner[at], minlength=len(theirs))
            linked = weight[i] + weight[theirs] <= 2 * (100 + per_cent) * shared
            for k in theirs[linked].tolist():
                x, y = find(int(label[i])), find(int(label[k]))
                if x != y:
                    parent[x] = y
                    u.append(node[i])
                    v.append(node[k])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _inner_links(tables: common.Tables, members: DataFrame, label: DataFrame, texts: DataFrame, size: int, per_cent: int) -> DataFrame | None:
    """Links between members of a bucket other than its first one, where these are of several components."""
    others = members.where("node <> p").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = tables.write(others.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("node").alias("star")).where("a < b").select("key", "star"), "mixed")
    if not mixed.take(1):
        return None
    open_ = tables.write(others.join(mixed, "key").select("node", "label", "star").distinct(), "open")
    clusters = components(open_.select(F.col("star").alias("u"), F.col("node").alias("v")), tables)
    nodes = tables.write(open_.select("node", "label").distinct().join(clusters.select("node", F.col("label").alias("cluster")), "node").join(texts, "node"), "open_nodes")
    # a few members of each cluster, and of those as many as have few shingles together
    drawn = Window.partitionBy("cluster").orderBy(F.xxhash64("node"), "node")
    few = nodes.select("cluster", "node", F.octet_length("text").alias("bytes")).withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= CENTRE_OF)
    before = F.sum("bytes").over(Window.partitionBy("cluster").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    few = tables.write(few.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 4 * CENTRE_SHINGLES).select("cluster", "node"), "drawn")
    centres = tables.write(few.join(nodes.select("node", "text"), "node").select("cluster", "text").groupBy("cluster").applyInArrow(_centred(size), "cluster long, centre binary"), "centres")
    salted = tables.write(nodes.groupBy("cluster").agg(F.expr(f"int((count(*) - 1) div {TOGETHER} + 1)").alias("salts")), "salts")
    first = centres.join(salted, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("label"), "centre", F.lit(None).cast("string").alias("text"))
    then = nodes.join(salted, "cluster").select("cluster", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), "node", "label", F.lit(None).cast("binary").alias("centre"), "text")
    dealt = first.unionByName(then).repartition("cluster", "salt").sortWithinPartitions("cluster", "salt", F.col("node").asc_nulls_first())
    diffs = dealt.mapInArrow(_differences(size), "cluster long, node long, label long, n long, size long, diff binary")
    diffs = tables.write(diffs.withColumn("weight", (100 + per_cent) * F.col("size") - (100 - per_cent) * F.col("n")), "diffs")
    least = F.min(F.struct("weight", "node")).alias("m")
    core = tables.write(diffs.groupBy("cluster").agg(least).select("cluster", F.col("m.node").alias("m"), (-F.col("m.weight")).alias("most")), "cores")
    told = diffs.select("cluster", "node", "weight", "size").join(core, "cluster").withColumn("outer", F.col("weight") > F.col("most"))
    sure = told.where("not outer and node <> m").select(F.col("m").alias("u"), F.col("node").alias("v"))
    # blocks of the outer members, i, and of all, j
    count = lambda c: F.greatest(F.ceil(F.sum(F.when(c, F.col("size"))) / BLOCK_SHINGLES), F.ceil(F.sum(c.cast("int")) / BLOCK)).cast("int")
    blocks = tables.write(told.groupBy("cluster").agg(count(F.col("outer")).alias("ni"), F.greatest(count(F.lit(True)), F.lit(1)).alias("nj")).where("ni > 0"), "blocks")
    placed = diffs.select("cluster", "node", "label", "weight", "diff").join(core, "cluster").join(blocks, "cluster")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), n).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cluster", "node", "label", "weight", "diff"]
    ours = placed.where(F.col("weight") > F.col("most")).select(*columns, F.lit(True).alias("outer"), own("ni").alias("i"), all_("nj").alias("j"))
    theirs = placed.select(*columns, F.lit(False).alias("outer"), own("nj").alias("j"), all_("ni").alias("i"))
    return sure.unionByName(ours.unionByName(theirs).groupBy("cluster", "i", "j").applyInArrow(_spanning(per_cent), "u long, v long"))


def near_duplicates(docs: DataFrame, size: int = 5, per_cent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, xx (hash of the text), n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= per_cent * union. Null and
    wordless texts have no shingles and no links. Repeated rows are of one
    class; where all doc_ids of a component are null its id is null, else nulls
    do not count. Empty tables give no rows; other columns are ignored."""
    tables = common.Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("xx"), F.col("text").cast("string").alias("text"))
    sketches = tables.write(docs.mapInArrow(_sketched(size), SKETCH).withColumn("row", F.monotonically_increasing_id()), "sketches")
    sets = ["d1", "d2", "n"]
    classes = tables.write(sketches.where("n > 0").groupBy(*sets).agg(F.min(F.struct("row", "doc_id", "xx")).alias("first"), F.min("doc_id").alias("least")), "classes")
    nodes = classes.select(F.col("first.row").alias("node"))
    own = sketches.withColumnRenamed("row", "node").join(nodes, "node")
    members = own.select("node", F.explode("keys").alias("key"))
    shared = tables.write(members.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("p")).where("m > 1"), "shared")
    members = tables.write(members.join(shared.select("key", "p"), "key"), "members")
    active = tables.write(members.select("node").distinct(), "active")
    sketched = tables.write(sketches.select(F.col("row").alias("node"), "n", "regs").join(active, "node"), "active_sketches")
    keyed = classes.select(F.col("first.row").alias("node"), F.coalesce("first.doc_id", F.lit(-(2**63))).alias("__key"), F.col("first.xx").alias("xx")).join(active, "node")
    # repeated rows bring the same text more than once
    texts = tables.write(docs.withColumn("__key", F.coalesce("doc_id", F.lit(-(2**63)))).join(keyed, ["__key", "xx"]).select("node", "text").dropDuplicates(["node"]), "active_texts")

    pairs = members.where("node <> p").select("p", F.col("node").alias("q")).distinct()
    links = tables.write(_links(tables, pairs, sketched, texts, size, per_cent), "links")
    label = components(links, tables)
    more = _inner_links(tables, members, label, texts, size, per_cent)
    if more is not None:
        label = components(links.unionByName(tables.write(more, "inner_links")), tables)
    least = tables.write(classes.select(F.col("first.row").alias("node"), *sets, "least").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    ids = tables.write(least.groupBy("label").agg(F.min("least").alias("component")), "component_ids")
    found = tables.write(least.join(ids, "label").select(*sets, "component"), "found")
    out = sketches.select("doc_id", "xx", *sets).join(found, sets, "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    tables.drop(sketches, found)
    return out.select("doc_id", "xx", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates of ``documents`` at 4-word shingles and 80 per cent; see ``near_duplicates`` for the defined cases."""
    return near_duplicates(common.documents(spark, sf_dir), size=4, per_cent=80).drop("xx")
