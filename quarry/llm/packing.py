"""Best-fit decreasing packing whose bin counts are certified by lower bounds.

Pieces are dealt at random to partitions, each packed by best-fit decreasing.
Dual feasible functions bound from below how many bins a partition needs, and
how many all pieces need; both are returned. A partition's gap is how far its
bins lie above its own bound, or above its tokens' share of the bound of all
pieces where that is more: a partition that is at its own bound may still hold
half-empty bins that another's pieces would fill. While the total lies above its
bound, partitions with gaps give up their emptiest bins, each as many as its gap
asks for, four times as many as the total lies above at first; the pieces are
exchanged, dealt anew and packed again. Each turn asks for twice as many as the
one before, and for one bin at least of each partition with a gap. Turns end when
the bound is met, or when two in a row gain less than a hundredth of what is left
to gain."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, tokens

CAPACITY = 4096
PART_PIECES = 100_000  # of a partition, about
LEAST_PARTS = 4  # with which the packing starts
GIVEN, MORE = 4, 2  # bins given up for each that the total lies above its bound; times that in each further turn
IDLE = 2  # turns in a row that gain next to nothing, after which the exchange ends


def lower_bound(lengths: np.ndarray, capacity: int, count: np.ndarray | None = None) -> int:
    """The largest of the bounds that dual feasible functions give.

    u_k (Fekete and Schepers) rounds x (k + 1) / C down unless it is whole;
    the other family counts pieces above C - t as whole bins and those below
    t as nothing. Any such f has sum f(x) <= 1 over each bin. ``count`` tells
    how often each length occurs; without it, each occurs once."""
    if not len(lengths):
        return 0
    size, count = np.unique(lengths, return_counts=True) if count is None else (lengths, count)
    best = -(-int((size * count).sum()) // capacity)
    for k in range(1, 21):
        scaled = size * (k + 1)
        whole = scaled % capacity == 0
        # in units of 1 / (k * C)
        total = int((np.where(whole, size * k, (scaled // capacity) * capacity) * count).sum())
        best = max(best, -(-total // (k * capacity)))
    for t in range(1, capacity // 2 + 1, max(1, capacity // 64)):
        f = np.where(size > capacity - t, capacity, np.where(size < t, 0, size))
        best = max(best, -(-int((f * count).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece. Pieces come in descending order.

    Bins are kept by the space left; a bit set of the spaces that occur finds
    the tightest one with a few machine operations."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made, out = 0, 0, np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fitting = mask >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = stacks[space].pop()
            if not stacks[space]:
                mask &= ~(1 << space)
        else:
            space, b, made = capacity, made, made + 1
        out[i] = b
        if space > n:
            stacks[space - n].append(b)
            mask |= 1 << (space - n)
    return out


def _packed(pdf: pd.DataFrame, part: int, turn: int, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
    size = pdf["length"].to_numpy()
    bins = best_fit_decreasing(size, capacity)
    n = int(bins.max()) + 1
    fill = np.bincount(bins, weights=size, minlength=n).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(size[order])
    first = np.searchsorted(bins[order], np.arange(n))
    begin = np.concatenate([[0], ends])[first]
    offset = np.empty(len(pdf), np.int64)
    offset[order] = ends - size[order] - begin[bins[order]]
    emptier = np.empty(n, np.int64)  # bins of the partition that go before a bin when some are given up
    emptier[np.argsort(fill, kind="stable")] = np.arange(n)
    return pdf.assign(sequence_id=(turn << 56) + (part << 32) + bins, offset=offset, fill=fill[bins], emptier=emptier[bins], part_tokens=int(size.sum()), part_bins=n, part_bound=lower_bound(size, capacity))


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_part: int = PART_PIECES) -> DataFrame:
    """Adds sequence_id, offset and the certificates to pieces (doc_id, piece, start, length, ids_crc32).

    ``bins`` and ``bound`` are the number of sequences and the least that any
    packing of all pieces has; ``part_bins`` and ``part_bound`` are those of the
    partition in which a piece was packed last. No piece may be longer than the
    capacity. Ties and repeated rows are packed each on its own; no pieces give
    no rows."""
    from pyspark import TaskContext

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema = f"{columns}, __row long, sequence_id long, offset long, fill long, emptier long, part_tokens long, part_bins long, part_bound long"
    names = [*(c.split()[0] for c in columns.split(", ")), "__row"]
    tables = common.Tables(pieces.sparkSession)

    def packer(turn: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [b for b in batches if len(b)]
            if rows:
                yield _packed(pd.concat(rows, ignore_index=True), TaskContext.get().partitionId(), turn, capacity)

        return run

    def packed(rest: DataFrame, total: int, turn: int, least: int) -> DataFrame:
        # the deal depends on the written row alone, so a lost partition comes back the same, and equal rows are dealt apart
        dealt = rest.repartition(common.parts_for(total, per_part, least), F.xxhash64("__row", F.lit(turn)))
        return tables.write(dealt.mapInPandas(packer(turn), schema), f"packed{turn}")

    rows = tables.write(pieces.select(*names[:-1], F.monotonically_increasing_id().alias("__row")), "pieces")
    lengths = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    size, count = (np.array([r[k] for r in lengths], np.int64) for k in (0, 1))
    bound, n_tokens = lower_bound(size, capacity, count), int((size * count).sum())
    gap = F.greatest(F.col("part_bins") - F.col("part_bound"), F.col("part_bins") - F.lit(bound / max(1, n_tokens)) * F.col("part_tokens"), F.lit(0.0))
    given_up = lambda per, turns: (F.col("emptier") < F.ceil(per * gap) + turns) & (gap > 0) & (F.col("fill") < capacity)

    def bins_and_gaps(table: DataFrame) -> tuple[int, float]:
        """Sums over the partitions in which a table was packed; each is read from its first piece."""
        r = table.where("emptier = 0 and offset = 0").agg(F.sum("part_bins").alias("bins"), F.sum(gap).alias("gaps")).first()
        return r.bins or 0, r.gaps or 0.0

    # tables of packed pieces, the sum of their partitions' gaps, how many bins they have given up for each bin of a gap, and in how many turns
    first = packed(rows, int(count.sum()), 0, LEAST_PARTS)
    total, gaps = bins_and_gaps(first)
    parts, factor, turn, idle = [(first, gaps, 0.0, 0)], GIVEN, 1, 0
    while total > bound and idle < IDLE:
        # as many more as the total asks for, dealt among the partitions by their gaps
        more_per = factor * (total - bound) / sum(gaps for _, gaps, _, _ in parts)
        rest, *others = (t.where(given_up(g + more_per, k + 1) & ~given_up(g, k)).select(*names, "offset") for t, _, g, k in parts)
        for more in others:
            rest = rest.unionByName(more)
        rest = tables.write(rest, "given")
        n, given = rest.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        again = packed(rest.drop("offset"), n, turn, 1)
        made, gaps = bins_and_gaps(again)
        gain = given - made
        if gain > 0:
            parts = [(t, gaps_, g + more_per, k + 1) for t, gaps_, g, k in parts] + [(again, gaps, 0.0, 0)]
            total -= gain
        idle = 0 if gain > 0 and 100 * gain >= total - bound else idle + 1
        factor, turn = factor * MORE, turn + 1
    out, *others = (t.where(~given_up(g, k)) for t, _, g, k in parts)
    for more in others:
        out = out.unionByName(more)
    tables.drop(*(t for t, *_ in parts))
    return out.drop("__row", "fill", "emptier", "part_tokens").withColumns({"bins": F.lit(total).cast("long"), "bound": F.lit(bound).cast("long")})


def token_pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int) -> DataFrame:
    """Ids of each text and the end id, cut after every ``capacity`` tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(tokenizer, kind), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = encoder.encode(text.as_py()) + end
                rows += [(doc_id, i, i * capacity, len(part) // 4, zlib.crc32(part)) for i in range(-(-len(raw) // (4 * capacity))) for part in [raw[4 * capacity * i : 4 * capacity * (i + 1)]]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, tokenizer or tokens.tokenizer_path("word_bpe_49k.json"), "word", 1, capacity), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all ``documents`` into sequences of at most 4096 tokens.

    Defined cases: a null or empty text is its end id alone; null doc_ids and
    repeated rows are packed as any other; other columns are ignored."""
    return pack_documents(common.documents(spark, sf_dir))
