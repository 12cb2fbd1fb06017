"""The best k of each query that a task has met so far, kept while batches come and given out once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HELD = 2_000_000  # candidates that a task holds; more are given out before its end


def order_of(values: np.ndarray) -> np.ndarray:
    """The place of each value in ascending order, as Spark sorts them: null first, texts by code points."""
    if values.dtype != object:
        return np.unique(values, return_inverse=True)[1]
    place = {v: i for i, v in enumerate(sorted(set(values.tolist()), key=lambda v: (v is not None, "" if v is None else v)))}
    return np.fromiter((place[v] for v in values.tolist()), np.int64, len(values))


def plain(column: pa.Array) -> np.ndarray:
    """An Arrow column as numbers, or as objects where it has nulls or holds no integers."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


class Best:
    """Candidates (query, source, doc, score); of each query the k highest scores stay, equal ones in order of source and doc."""

    def __init__(self, k: int):
        self.k, self.cut = k, {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.seen = 0

    def add(self, queries: np.ndarray, sources: np.ndarray, docs: np.ndarray, score: np.ndarray) -> None:
        """``score``: a row for each query, a column for each document; what is not finite is no candidate."""
        if not score.size:
            return
        keep = min(self.k, score.shape[1])
        least = np.partition(score, score.shape[1] - keep, axis=1)[:, score.shape[1] - keep] if keep else np.full(len(score), np.inf)
        if self.cut:
            least = np.maximum(least, [self.cut.get(q, -np.inf) for q in queries.tolist()])
        i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        self.parts.append((queries[i], sources[j], docs[j], score[i, j]))
        self.size += len(i)
        if self.size > 2 * self.seen + 100_000:
            self.prune()

    def prune(self) -> None:
        if not self.parts:
            return
        q, source, doc, score = (np.concatenate([p[n] for p in self.parts]) for n in range(4))
        number = order_of(q)
        order = np.lexsort((order_of(doc), order_of(source), -score, number))
        number = number[order]
        nth = np.arange(len(number)) - np.searchsorted(number, number)
        kept = order[nth < self.k]
        self.cut = dict(zip(q[order[nth == self.k - 1]].tolist(), score[order[nth == self.k - 1]].tolist(), strict=True))
        self.parts = [(q[kept], source[kept], doc[kept], score[kept])]
        self.size = self.seen = len(kept)

    def full(self) -> bool:
        return self.size > HELD

    def rows(self, query_type: pa.DataType, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """What is held, as query_id, source, doc_id, score; nothing is held then."""
        self.prune()
        for q, source, doc, score in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(q.tolist(), query_type), pa.array(source.tolist(), pa.string()), pa.array(doc.tolist(), doc_type), pa.array(score, pa.float64())], names=["query_id", "source", "doc_id", "score"])
        self.parts, self.cut, self.size, self.seen = [], {}, 0, 0
