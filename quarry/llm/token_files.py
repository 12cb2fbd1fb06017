"""Token ids on disk as directly addressable codes.

A segment holds documents in order; one that is longer than a segment goes on in
the next. Its ids are cut into levels of 8 bits, lowest first. Level k keeps the bytes of those ids that reach it, a bitmap that
tells which of them go on to level k + 1, and a directory with the bitmap's rank
before every 512th bit. So the place of a token's next byte is one rank away and
any token, or run of tokens, is read without decoding what stands before it.

Segments are rows of a Parquet table with binary columns: a store that only
Spark reaches can hold it, and Spark's commit keeps it whole when executors are
lost. Columns: shard, segment, n_tokens, and ``code``, the levels as laid out by
``pack``; doc_ids, doc_nulls and doc_ends hold the documents of the segment,
first_doc the number of the first one in its shard, from_before and goes_on
whether the first began in an earlier segment and the last ends in a later one."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common, tokens

STEP = 512  # bits between entries of a rank directory
SEGMENT_TOKENS = 1 << 16
BLOCK_SHARDS = 4_000


def pack(ids: np.ndarray) -> bytes:
    """Levels of the ids: for each, n, its bytes, bitmap and rank directory."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= 256
        n = len(rest)
        bitmap = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, n, STEP), dtype=np.int64))[:-1]]).astype("<u8") if n else np.zeros(0, "<u8")
        out.append(struct.pack("<QQQ", n, len(bitmap), len(ranks)) + (rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.tobytes())
        if not more.any():
            return b"".join(out)
        rest = rest[more] >> np.uint32(8)


class Segment:
    """Reads a packed segment in place."""

    def __init__(self, code: bytes):
        self.levels, at = [], 0
        while at < len(code):
            n, bits, ranks = struct.unpack_from("<QQQ", code, at)
            at += 24
            low = np.frombuffer(code, np.uint8, n, at)
            bitmap = np.frombuffer(code, np.uint8, bits, at + n)
            self.levels.append((low, bitmap, np.frombuffer(code, "<u8", ranks, at + n + bits)))
            at += n + bits + 8 * ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, i: int) -> int:
        """Set bits of the level's bitmap before bit i."""
        _, bitmap, ranks = self.levels[level]
        block = min(i // STEP, len(ranks) - 1)
        if block < 0:
            return 0
        part = int.from_bytes(bitmap[block * STEP // 8 : -(-i // 8)].tobytes(), "little")
        return int(ranks[block]) + (part & ((1 << (i - block * STEP)) - 1)).bit_count()

    def token(self, i: int) -> int:
        value = 0
        for k, (low, bitmap, _) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(k, i)
        return value

    def run(self, i: int, j: int) -> np.ndarray:
        """Tokens i to j, j not included."""
        out = self.levels[0][0][i:j].astype("<u4")
        where = None
        for k, (_, bitmap, _) in enumerate(self.levels[:-1]):
            first = i >> 3
            on = np.flatnonzero(np.unpackbits(bitmap[first : -(-j // 8)], bitorder="little")[i - 8 * first : j - 8 * first])
            where = on if where is None else where[on]
            i = self.rank(k, i)
            j = i + len(on)
            out[where] |= self.levels[k + 1][0][i:j].astype("<u4") << np.uint32(8 * (k + 1))
        return out


SEGMENTS = "shard int, segment int, n_tokens long, first_doc long, from_before boolean, goes_on boolean, doc_ids binary, doc_nulls binary, doc_ends binary, code binary"


def write(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int | None = 2, shards: int | None = None) -> None:
    """Writes the ids of all texts to a segment table at ``path``.

    Documents are dealt in ranges of ascending doc_id, null first, so shards
    follow one another in that order; rows of one doc_id come as they are read,
    and many of them are several shards. A null text is empty. An empty table
    gives no segment. Without ``shards`` there are as many as the session's
    shuffles have partitions."""
    from pyspark import TaskContext

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = tokens.encoder(tokenizer, kind), TaskContext.get().partitionId()
        end = b"" if end_id is None else struct.pack("<I", end_id)
        held, ends, ids, size, segment, first, before = [], [], [], 0, 0, 0, False

        def flush(goes_on: bool) -> pa.RecordBatch:
            nonlocal held, ends, ids, size, segment, first, before
            nulls = np.array([d is None for d in held], np.uint8)
            row = [shard, segment, size, first, before, goes_on, np.array([d or 0 for d in held], "<i8").tobytes(), nulls.tobytes(), np.array(ends, "<i8").tobytes(), pack(np.frombuffer(b"".join(ids), "<u4"))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.binary()] * 4]
            first, before = first + len(held) - goes_on, goes_on
            held, ends, ids, size, segment = [], [], [], 0, segment + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SEGMENTS.split(", ")])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = encoder.encode(text.as_py()) + end
                at = 0
                while True:
                    # only what is too long for any segment is cut
                    whole = len(raw) - at <= 4 * SEGMENT_TOKENS
                    part = raw[at:] if whole else raw[at : at + 4 * (SEGMENT_TOKENS - size)]
                    at += len(part)
                    held.append(doc_id)
                    ids.append(part)
                    size += len(part) // 4
                    ends.append(size)
                    if size >= SEGMENT_TOKENS:
                        yield flush(not whole)
                    if whole:
                        break
        if held:
            yield flush(False)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row's number splits the rows of one doc_id, null too
    ordered = docs.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "__row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__row")
    # small row groups: a reader holds a few of them, not a shard
    ordered.select("doc_id", "text").mapInArrow(encode, SEGMENTS).write.option("parquet.block.size", 8 << 20).parquet(path)


def _starts(segments: DataFrame) -> DataFrame:
    """shard, segment and the number of ids in all segments before.

    Sums run within a shard, over the shards of a block and over blocks: a task holds a row for each of some thousands."""
    block = F.floor(F.col("shard") / BLOCK_SHARDS)
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", block)
    upto = lambda over: F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = shards.groupBy("block").agg(F.sum("n").alias("n")).select("block", upto(Window.orderBy("block")).alias("block_start"))
    in_block = shards.select("shard", "block", upto(Window.partitionBy("block").orderBy("shard")).alias("in_block"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    own = segments.select("shard", "segment", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("in_shard"))
    return own.join(in_block, "shard").join(blocks, "block").select("shard", "segment", (F.col("block_start") + F.col("in_block") + F.col("in_shard")).alias("segment_start"))


def _times(m: list[int], v: int) -> int:
    """A matrix over the field of two, by columns, times a vector."""
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v, i = v >> 1, i + 1
    return out


@lru_cache(maxsize=1)
def _zero_bytes() -> list[list[int]]:
    """What 1, 2, 4 and so on zero bytes behind a message do to its checksum."""
    bit = [0xEDB88320, *(1 << k for k in range(31))]
    square = lambda m: [_times(m, c) for c in m]
    byte = square(square(square(bit)))
    out = [byte]
    while len(out) < 48:
        out.append(square(out[-1]))
    return out


def crc32_joined(first: int, second: int, length: int) -> int:
    """The checksum of two messages one behind the other, the second of ``length`` bytes."""
    for m in _zero_bytes():
        if length & 1:
            first = _times(m, first)
        length >>= 1
    return first ^ second


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's parts (start, n_tokens, ids_crc32), in order, as one row."""
    for b in batches:
        rows = []
        for doc_id, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            crc = 0
            for p in parts:
                crc = crc32_joined(crc, p["ids_crc32"], 4 * p["n_tokens"])
            rows.append((doc_id, parts[0]["start"], sum(p["n_tokens"] for p in parts), crc))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each document is read from its segment by way of the rank directories."""
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for b in batches:
            for shard, segment, _, first, before, goes_on, ids, nulls, ends, code in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                s, ends = Segment(code), np.frombuffer(ends, "<i8")
                begins, n = np.concatenate([[0], ends[:-1]]), len(ends)
                sums = [zlib.crc32(s.run(i, j)) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
                cut = np.zeros(n, bool)
                cut[0] |= before
                cut[-1] |= goes_on
                doc_id = pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(nulls, np.uint8).astype(bool))
                columns = [pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(first + np.arange(n), pa.int64()), pa.array(cut), doc_id, pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "segment", "nth", "cut", "doc_id", "at", "n_tokens", "ids_crc32"])

    # written, as whole documents and cut ones are taken from it apart
    rows = common.written(segments.mapInArrow(decode, "shard int, segment int, nth long, cut boolean, doc_id long, at long, n_tokens long, ids_crc32 long"), "pieces")
    placed = rows.join(_starts(segments), ["shard", "segment"]).withColumn("start", F.col("segment_start") + F.col("at"))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    parts = placed.where("cut").groupBy("shard", "nth").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("start", "n_tokens", "ids_crc32"))).alias("parts"))
    return placed.where("not cut").select(*columns).unionByName(parts.select("doc_id", "parts").mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the byte-level ids of ``documents`` with end id 2 and reads them back.

    Defined cases: null text is empty (one id, the end); null doc_id comes first;
    rows of one doc_id follow one another as they are read; other columns are ignored."""
    path, docs = common.new_path(spark, "ids"), common.documents(spark, sf_dir)
    # the scan's partitions go by bytes, so shards do not grow with the table
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    write(docs, path, tokens.tokenizer_path("byte_bpe_50k.json"), shards=shards)
    return read(spark, path)
