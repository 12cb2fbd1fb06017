"""Exact dense search: the stated queries, in blocks, against all vectors.

Queries are dealt to blocks of bounded size, and each block to slots: a block is
in all of its slots, a vector in one slot of each block of its cell (all vectors
are of one cell, unless an index has cells). Both go to their slots as rows of one
shuffle, queries first. So a task holds one block and meets vectors as they come,
nothing is broadcast, and no pair of a block and a batch is ever a row. What is
asked for is passed on: the best k for each query, kept over all vectors of a
task, links, or how many. The plan does not grow with the queries, and none of
them passes through the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quarry.functions import text as T
from quarry.operators.best import Best
from quarry.operators.lexical import ranked

BLOCK = 4096  # queries that are held in memory together, about
WIDE = 16_384  # the same where all meet all, so that fewer copies of the vectors are dealt out
SPREAD = 64  # slots at least
CELLS = 2_000_000  # scores that are held at a time


class EmbedderMismatchError(ValueError):
    """The stored vectors come from another model or have another length."""


def assert_embedder(stored: dict, model: str, dim: int) -> None:
    if stored.get("embedding_model") != model or stored.get("embedding_dim") != dim:
        raise EmbedderMismatchError(f"stored vectors are of {stored.get('embedding_model')!r} with {stored.get('embedding_dim')!r} numbers, asked for {model!r} with {dim}")


def _normed(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.fill_null([]) if column.null_count else column
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and not (lengths == dim).all():
        raise EmbedderMismatchError(f"a vector has {int(lengths[lengths != dim][0])} numbers, the queries have {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


FOUND = "query_id long, source string, doc_id long, score double"


def _met(queries: DataFrame, vectors: DataFrame, block: int, counts: dict[int, int] | None = None) -> DataFrame:
    """cell, block, salt, kind, id, source, embedding: of each slot the queries (kind 0), then the vectors (kind 1).

    ``queries``: cell, query_id, embedding and, if it is asked for, source.
    ``vectors``: cell, source, doc_id, embedding. ``counts``: queries of each
    cell, where they are known."""
    if counts is None:
        counts = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # as many as there are cells
    total, blocks = sum(counts.values()), {c: -(-n // block) for c, n in counts.items()}
    # few queries are cheap to copy; of many each cell gets slots by its share
    spread = {c: -(-SPREAD // blocks[c]) if total <= 4 * BLOCK else max(1, round(4 * SPREAD * n / total / blocks[c])) for c, n in counts.items()}
    table = pa.table({"cell": pa.array(counts, pa.int32()), "blocks": pa.array([blocks[c] for c in counts], pa.int32()), "spread": pa.array([spread[c] for c in counts], pa.int32())})
    slots = F.broadcast(queries.sparkSession.createDataFrame(table))
    kind = "array<float>" if queries.schema["embedding"].dataType == vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    source = F.col("source").cast("string") if "source" in queries.columns else F.lit(None).cast("string")

    def rows(df: DataFrame, of: int, id_: str, name: Column, copies: str) -> DataFrame:
        # as a generator's output: Spark fails on a union whose columns are expressions with lambdas over columns that are gone (fake embeddings)
        whole = F.inline(F.array(F.struct(F.lit(of).alias("kind"), F.col(id_).cast("long").alias("id"), name.alias("source"), F.col("embedding").cast(kind).alias("embedding"))))
        met = df.withColumn("cell", F.col("cell").cast("int")).join(slots, "cell").select("cell", "blocks", "spread", whole)
        return met.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))

    out = ("kind", "id", "source", "embedding")
    number = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    q = rows(queries, 0, "query_id", source, "spread").select("cell", number, F.col("__copy").alias("salt"), *out)
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.col("spread")).cast("int").alias("salt")
    v = rows(vectors, 1, "doc_id", F.col("source").cast("string"), "blocks").select("cell", F.col("__copy").alias("block"), place, *out)
    n = max(1, min(sum(blocks[c] * spread[c] for c in counts), int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return q.unionByName(v).repartition(n, "cell", "block", "salt").sortWithinPartitions("cell", "block", "salt", "kind")


def _scores(batches: Iterator[pa.RecordBatch], self_deny: bool, copies: int = 1) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """Queries, their sources, sources, documents and cosines, not yet rounded, of parts of a slot, ``CELLS`` at a time;
    fewer where the reader makes ``copies`` of a part."""
    slot, parts, asked = None, [], None
    for b in batches:
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1).tolist(), b.num_rows]
        for first, end in zip(edges, edges[1:], strict=False):
            if first == end:
                continue
            if slot != (key := tuple(keys[:3, first].tolist())):
                slot, parts, asked = key, [], None
            if keys[3, first] == 0:
                parts.append(b.slice(first, end - first))
                continue
            if asked is None and parts:
                ids, lists = (pa.concat_arrays([p.column(i) for p in parts]) for i in (4, 6))
                dim = len(lists[0].as_py()) if lists[0].is_valid else 0
                ids = ids.to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                asked = ids[order], pa.concat_arrays([p.column(5) for p in parts]).take(pa.array(order)), _normed(_matrix(lists, dim))[order]
                parts = []
            if asked is None:  # no query has fallen into this block
                continue
            ids, whose, q = asked
            step = max(1, CELLS // copies // len(ids))
            for at in range(first, end, step):
                part = b.slice(at, min(step, end - at))
                score = q @ _normed(_matrix(part.column(6), q.shape[1])).T
                docs = part.column(4).to_numpy(zero_copy_only=False)
                if self_deny:
                    low, high = np.searchsorted(ids, docs), np.searchsorted(ids, docs, "right")
                    own = np.repeat(np.arange(len(docs)), high - low)
                    score[np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(own)), own] = -np.inf
                yield ids, whose, part.column(5), docs, score


def best_of(met: DataFrame, k: int, self_deny: bool = False) -> DataFrame:
    """query_id, source, doc_id, score: what is among the best k of a task for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for ids, _, sources, docs, score in _scores(batches, self_deny, 4):
            names = np.empty(len(docs), object)
            names[:] = sources.to_pylist()
            np.round(score, 6, out=score)
            score += 0.0
            best.add(ids, names, docs, score)
            if best.full():
                yield from best.rows(pa.int64(), pa.int64())
        yield from best.rows(pa.int64(), pa.int64())

    return met.mapInArrow(run, FOUND)


def cell_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """As ``best_of`` for queries and vectors of the same cell only (both have a column cell)."""
    return best_of(_met(queries, vectors, block), k)


def _one_cell(df: DataFrame) -> DataFrame:
    return df.withColumn("cell", F.lit(0))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, deny: DataFrame | None = None, self_deny: bool = False, denied: int = 0, block: int = BLOCK) -> DataFrame:
    """query_id, source, doc_id, score, rank; cosine to six places, ties by source and doc_id.

    ``queries``: query_id, embedding. ``vectors``: source, doc_id, embedding.
    ``denied`` is how many documents ``deny`` may take from one query: tasks
    pass on so many more."""
    return ranked(best_of(_met(_one_cell(queries), _one_cell(vectors), block), k + denied, self_deny), k, deny)


def _reaches(score: np.ndarray, threshold: float) -> np.ndarray:
    """Which scores are at the threshold or more when rounded to six places; only those close to it are rounded."""
    out = score >= threshold - 1e-6
    i, j = np.nonzero(out & (score < threshold + 1e-6))
    out[i, j] = np.round(score[i, j], 6) >= threshold
    return out


def cell_links(queries: DataFrame, vectors: DataFrame, threshold: float, block: int = WIDE, counts: dict[int, int] | None = None) -> DataFrame:
    """query_id, source, doc_id, score of all other vectors of the query's cell whose cosine with it is at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, sources, docs, score in _scores(batches, True):
            i, j = np.nonzero(_reaches(score, threshold))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), sources.take(pa.array(j)), pa.array(docs[j]), pa.array(np.round(score[i, j], 6) + 0.0)], names=["query_id", "source", "doc_id", "score"])

    return _met(queries, vectors, block, counts).mapInArrow(run, FOUND)


def similar(queries: DataFrame, vectors: DataFrame, threshold: float, block: int = WIDE) -> DataFrame:
    """query_id, source, doc_id, score of all other vectors whose cosine with the query is at least the threshold."""
    return cell_links(_one_cell(queries), _one_cell(vectors), threshold, block)


def link_counts(queries: DataFrame, vectors: DataFrame, threshold: float, block: int = WIDE) -> DataFrame:
    """query_id, n: how many rows ``similar`` has for a query, where it has any; links are counted as they are met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(0, np.int64), np.empty(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held[n > 0]), pa.array(n[n > 0])], names=["query_id", "n"])
        for ids, _, _, _, score in _scores(batches, True):
            if ids is not held:
                yield out()
                held, n = ids, np.zeros(len(ids), np.int64)
            n += np.count_nonzero(_reaches(score, threshold), axis=1)
        yield out()

    return _met(_one_cell(queries), _one_cell(vectors), block).mapInArrow(run, "query_id long, n long").groupBy("query_id").agg(F.sum("n").alias("n"))


def linked(queries: DataFrame, vectors: DataFrame, threshold: float, block: int = WIDE) -> DataFrame:
    """doc_id of vectors (cell, source, doc_id, embedding) at the threshold or more of a query (cell, source, query_id, embedding) of their own source and cell, once for each block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, whose, sources, docs, score in _scores(batches, False):
            near = _reaches(score, threshold)
            if len(names := set(whose.to_pylist()) | set(sources.to_pylist())) > 1:
                place = {name: i for i, name in enumerate(names)}
                near &= np.array([place[x] for x in whose.to_pylist()])[:, None] == np.array([place[x] for x in sources.to_pylist()])[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(docs[near.any(0)])], names=["doc_id"])

    return _met(queries, vectors, block).mapInArrow(run, "doc_id long")


def with_fake_embeddings(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("embedding", T.fake_embedding(F.col(text)))


def cosine_score(a: Column, b: Column) -> Column:
    return F.round(T.cosine(a, b), 6)
