"""Exact dedup by composable polynomial fingerprints.

H(ab) = H(a) * B**len(b) + H(b) modulo a prime, so chunks are hashed apart and
their hashes put together by arithmetic shifted by length. Small texts are
hashed chunk by chunk where they stand; a huge text is cut in one pass into parts
that go to many tasks. Texts with equal fingerprints (two primes and the length)
are then compared with the one of their group that stays: huge texts are cut where
they are read, a part meets the same part of the other text, and no row that is
shuffled or written is longer than a part. Texts
that differ in spite of equal fingerprints form groups of their own in a next turn.

Equal means identical after A-Z is lower-cased and nothing else."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

PRIMES = (2_147_483_647, 2_147_483_629)  # the two largest below 2**31
BASES = (911_382_323, 972_663_749)
CHUNK = 1 << 16  # bytes hashed at a time
HUGE = 4 << 20  # bytes from which a text is dealt out
PART = 1 << 20  # bytes of each part of a huge text
BATCH_BYTES = 2 << 20  # bytes of small texts that are hashed together
TOGETHER = 100  # rows of a group that one task compares with a copy of the one that stays
CLASS = ["fp1", "fp2", "n_bytes", "turn"]


def _powers(prime: int, base: int) -> np.ndarray:
    out, x = np.empty(CHUNK, np.uint64), 1
    for i in range(CHUNK):
        out[i] = x
        x = x * base % prime
    return out


_tables: list[np.ndarray] = []


def fingerprints(texts: list[bytes]) -> list[list[int]]:
    """For each prime the polynomial hash of every text."""
    if not _tables:
        _tables.extend(_powers(p, b) for p, b in zip(PRIMES, BASES, strict=True))
    sizes = [len(t) for t in texts]
    starts, owner = [], []
    at = 0
    for i, n in enumerate(sizes):
        starts += range(at, at + n, CHUNK)
        owner += [i] * -(-n // CHUNK)
        at += n
    if not at:
        return [[0] * len(texts) for _ in PRIMES]
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    begin = np.array(starts)
    lengths = np.diff(np.append(begin, at))
    place = np.repeat(begin + lengths - 1, lengths) - np.arange(at)
    out = []
    for prime, base, table in zip(PRIMES, BASES, _tables, strict=True):
        hashes = (np.add.reduceat(data * table[place], begin) % np.uint64(prime)).tolist()
        whole = [0] * len(texts)
        for i, h, n in zip(owner, hashes, lengths.tolist(), strict=True):
            whole[i] = (whole[i] * pow(base, n, prime) + h) % prime
        out.append(whole)
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, xx, text to doc_id, xx, fp1, fp2, n_bytes, sha, for texts that are hashed where they stand."""
    common.release()
    for b in batches:
        raws = [common.raw_bytes(t) for t in b.column(2)]
        first, fps, shas = 0, [[], []], []
        while first < len(raws):  # a few MB at a time
            then, size = first, 0
            while then < len(raws) and (then == first or size + len(raws[then]) <= BATCH_BYTES):
                size += len(raws[then])
                then += 1
            texts = [common.lowered(r) for r in raws[first:then]]
            shas += [hashlib.sha256(t).hexdigest() for t in texts]
            for out, x in zip(fps, fingerprints(texts), strict=True):
                out += x
            first = then
        columns = [*b.columns[:2], *(pa.array(x, pa.int64()) for x in (*fps, [len(r) for r in raws])), pa.array(shas, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "xx", "fp1", "fp2", "n_bytes", "sha"])


def _parts(keys: int, size: int):
    """Leading key columns and a text to the keys, part, and the part's lower-cased bytes; the last part has the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(keys)):
                raw, sha = common.raw_bytes(t), hashlib.sha256()
                n = -(-len(raw) // size)
                for part in range(n):
                    piece = common.lowered(raw[part * size : (part + 1) * size])
                    sha.update(piece)
                    columns = [c.slice(i, 1) for c in b.columns[:keys]] + [pa.array([part], pa.int32()), pa.array([piece], pa.binary()), pa.array([sha.hexdigest() if part == n - 1 else None], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:keys], "part", "piece", "sha"])

    return run


def _part_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, xx, row, part, piece, sha to the part's hashes, the powers that shift what stands before it, and its length."""
    for b in batches:
        raws = [common.raw_bytes(t) for t in b.column(4)]
        fps = [[x[0] for x in column] for column in zip(*(fingerprints([bytes(r)]) for r in raws), strict=True)] or [[], []]
        powers = [[pow(base, len(r), prime) for r in raws] for prime, base in zip(PRIMES, BASES, strict=True)]
        columns = [*b.columns[:4], *(pa.array(x, pa.int64()) for x in (*fps, *powers, [len(r) for r in raws])), b.column(5)]
        yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:4], "fp1", "fp2", "pw1", "pw2", "n_bytes", "sha"])


def _prints(docs: DataFrame, huge: int, chunk: int, weak: int | None) -> DataFrame:
    """doc_id, xx (hash of the raw text, to find the row again), fp1, fp2, n_bytes, sha."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("xx"), "text")
    is_huge = F.coalesce(F.octet_length("text") >= huge, F.lit(False))
    small = docs.where(~is_huge).mapInArrow(_hashed, "doc_id long, xx long, fp1 long, fp2 long, n_bytes long, sha string")
    # one row for each part of a huge text, cut in one pass; each part is hashed by some task
    whole = docs.where(is_huge).select("doc_id", "xx", F.monotonically_increasing_id().alias("row"), "text")
    parts = whole.mapInArrow(_parts(3, chunk), "doc_id long, xx long, row long, part int, piece binary, sha string").repartition("row", "part")
    hashed = parts.mapInArrow(_part_hashes, "doc_id long, xx long, row long, part int, fp1 long, fp2 long, pw1 long, pw2 long, n_bytes long, sha string")
    fold = "aggregate(array_sort(collect_list(struct(part, fp{0}, pw{0}))), 0L, (h, x) -> (h * x.pw{0} + x.fp{0}) % {1}L)"
    joined = hashed.groupBy("doc_id", "xx", "row").agg(*(F.expr(fold.format(k, PRIMES[k - 1])).alias(f"fp{k}") for k in (1, 2)), F.sum("n_bytes").alias("n_bytes"), F.max("sha").alias("sha"))
    keep = ["doc_id", "xx", "fp1", "fp2", "n_bytes", "sha"]
    out = small.select(*keep).unionByName(joined.select(*keep))
    return out if weak is None else out.withColumns({f"fp{k}": F.col(f"fp{k}") % weak for k in (1, 2)})


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, salt, part, is_top, doc_id, xx, piece, the part of the text that stays first: doc_id and xx of what differs from it."""
    group, kept = None, b""
    for b in batches:
        wrong: list[tuple] = []
        rows = zip(*(b.column(i).to_pylist() for i in range(9)), b.column(9), strict=True)
        for fp1, fp2, n, turn, salt, part, is_top, doc_id, xx, piece in rows:
            if is_top:
                group, kept = (fp1, fp2, n, turn, salt, part), common.lowered(common.raw_bytes(piece))
                continue
            assert group == (fp1, fp2, n, turn, salt, part), "a row without the text that stays"
            own = common.raw_bytes(piece)
            if len(own) != len(kept) or any(common.lowered(own[i : i + CHUNK]) != kept[i : i + CHUNK] for i in range(0, len(kept), CHUNK)):
                wrong.append((doc_id, xx))
        yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in wrong], pa.int64()) for i in (0, 1)], names=["doc_id", "xx"])


def _key(column: str) -> F.Column:
    """Null joins null."""
    return F.coalesce(F.col(column), F.lit(-(2**63)))


def _compared(tables: common.Tables, docs: DataFrame, members: DataFrame, huge: int, chunk: int) -> DataFrame:
    """doc_id, xx of the members (class, size, top, doc_id, xx) whose text is not that of their class's top.

    Each part of a text meets the same part of the top; a copy of it serves
    ``TOGETHER`` rows, so a large class, repeated rows too, is many tasks."""
    texts = docs.select("doc_id", _key("doc_id").alias("__key"), F.xxhash64("text").alias("xx"), F.monotonically_increasing_id().alias("row"), "text")
    is_huge = F.coalesce(F.octet_length("text") >= huge, F.lit(False))
    # a huge text is cut where it is read, so that no row that is shuffled or written is longer than a part
    small = texts.where(~is_huge).select("doc_id", "__key", "xx", "row", F.lit(0).alias("part"), F.col("text").cast("binary").alias("piece"))
    cut = texts.where(is_huge).mapInArrow(_parts(4, chunk), "doc_id long, __key long, xx long, row long, part int, piece binary, sha string").drop("sha")
    is_top = _key("doc_id").eqNullSafe(_key("top.doc_id")) & (F.col("xx") == F.col("top.xx"))
    own = members.select(*CLASS, F.expr(f"int((size - 1) div {TOGETHER} + 1)").alias("salts"), _key("doc_id").alias("__key"), "xx", is_top.alias("as_top")).distinct()
    found = tables.write(small.unionByName(cut).join(own, ["__key", "xx"]), "members")
    # a repeated row's place among all of its kind
    rows = found.withColumn("salt", F.pmod(F.xxhash64("xx", "row"), "salts").cast("int")).withColumn("is_top", F.lit(False))
    one = found.where("as_top").groupBy(*CLASS, "salts", "xx", "part").agg(F.first("piece").alias("piece"), F.first("doc_id").alias("doc_id"))
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("is_top", F.lit(True))
    meet = [*CLASS, "salt", "part"]
    columns = [*meet, "is_top", "doc_id", "xx", "piece"]
    dealt = rows.select(*columns).unionByName(one.select(*columns)).repartition(*meet).sortWithinPartitions(*meet, F.desc("is_top"))
    return dealt.mapInArrow(_differing, "doc_id long, xx long").distinct()


def dedup(docs: DataFrame, huge: int = HUGE, chunk: int = PART, weak: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, xx, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (null is smallest); of
    repeated rows with that doc_id one. Null text equals empty text. Empty
    tables give no rows; other columns are ignored. ``huge`` is the size in
    bytes from which a text is dealt out in parts of ``chunk`` bytes; ``weak``
    reduces the fingerprints, for tests of collisions."""
    tables = common.Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = tables.write(_prints(docs, huge, chunk, weak).withColumns({"turn": F.lit(0), "row": F.monotonically_increasing_id()}), "prints")
    turn = 0
    while True:
        # written, so that the join deals both sides out and can split a large group
        groups = tables.write(prints.groupBy(*CLASS).agg(F.count("*").alias("size"), F.max(F.struct("doc_id", "row", "xx")).alias("top")).where("size > 1"), "groups")
        joined = tables.write(prints.join(groups, CLASS, "left"), "joined")
        wrong = tables.write(_compared(tables, docs, joined.where(F.col("size").isNotNull() & (F.col("turn") == turn)), huge, chunk), "differing")
        if not wrong.take(1):
            break
        # those that differ get a class of their own, which is compared in the next turn
        moved = wrong.select(_key("doc_id").alias("__key"), "xx", F.lit(1).alias("__moved"))
        prints = tables.write(prints.withColumn("__key", _key("doc_id")).join(moved, ["__key", "xx"], "left").withColumn("turn", F.col("turn") + F.coalesce("__moved", F.lit(0))).drop("__key", "__moved"), "prints")
        turn += 1
    tables.drop(joined)
    alone = F.col("size").isNull()
    return joined.select("doc_id", "xx", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.when(alone, True).otherwise(F.col("row") == F.col("top.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``; see ``dedup`` for the defined cases."""
    return dedup(common.documents(spark, sf_dir)).drop("xx")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id AS doc_id, g.keep_id AS keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
