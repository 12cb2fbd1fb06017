"""Cells of a space of directions: fitted on a bounded sample, every row in the cell of the nearest direction.

The angle between two vectors is at least the difference of their angles to any
third direction. So a row of a cell can have an angle of at most t with a query
only if the query's angle to the cell's direction is at most t plus the widest
angle between the direction and a row of the cell."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import scratch
from quarry.operators import dense

SAMPLE = 50_000  # rows at most that directions are fitted on, chosen by hash
ROWS_FOR_CELL = 16  # of the sample, at least
MOST_CELLS = 4096
SLACK = 2e-6  # scores are rounded to six places
WORTH = 0.5  # of all pairs: beyond that a join meets all
FEW = 10_000  # vectors that meet each other sooner than directions are fitted
COPIES = 32  # cells that a row is dealt to, on average: beyond that a join meets all
ROWS = 32_768  # rows that go out at a time


def unit(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def fitted(vectors: DataFrame, cells: int) -> np.ndarray:
    """Directions by Spark's k-means on unit vectors of a sample of ``vectors`` (embedding); one without direction where there is too little.

    The sample is written once, so ``vectors`` are made once. Spark's solver by
    rows would send the distances of all pairs of directions to the driver in
    every turn; that by blocks sends the directions' sums only."""
    rows = vectors.select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("length > 0")
    sample = scratch.written(rows.orderBy(F.xxhash64("v")).limit(SAMPLE).select(F.transform("v", lambda x: x / F.col("length")).alias("v")), "sample")
    k = min(cells, MOST_CELLS, sample.count() // ROWS_FOR_CELL)
    if k < 2:
        return np.zeros((1, 1))
    return unit(np.array(KMeans(k=k, seed=7, maxIter=12, initSteps=1, solver="block").fit(sample.select(array_to_vector("v").alias("features"))).clusterCenters()))


def placed(vectors: DataFrame, directions: np.ndarray) -> DataFrame:
    """Adds cell and __angle, the angle to the cell's direction."""
    names = vectors.columns
    at = names.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(at)
            matrix = unit(lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1))
            cosine = matrix @ directions.T if directions.any() else np.zeros((len(matrix), 1))
            cell = cosine.argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle(cosine[np.arange(len(cell)), cell]), pa.float64())], names=[*names, "cell", "__angle"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{ddl}, cell int, __angle double")


@dataclass
class Cells:
    """Directions with the widest angle and the number of rows of each cell: ``MOST_CELLS`` at most."""

    directions: np.ndarray
    widest: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, directions: np.ndarray, rows: DataFrame) -> Cells:
        """``rows``: what ``placed`` gave, written."""
        found = {r.cell: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("__angle").alias("widest")).collect()}
        return cls(directions, np.array([found[c].widest if c in found else 0.0 for c in range(len(directions))]), np.array([found[c].n if c in found else 0 for c in range(len(directions))]))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of queries and directions, and the highest one that a row of each cell can have."""
        cosine = unit(queries) @ self.directions.T if self.directions.any() else np.zeros((len(queries), 1))
        bound = np.cos(np.maximum(angle(cosine) - self.widest, 0.0)) + SLACK
        bound[:, self.counts == 0] = -np.inf
        bound[(queries * queries).sum(1) == 0] = np.where(self.counts == 0, -np.inf, 1.0)  # a query without direction is at 0 with all
        return cosine, bound


def _reaching(batches: Iterator[pa.RecordBatch], cells: Cells, threshold: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches (query_id, embedding), and of each row which cells may hold a row at ``threshold`` or more of it."""
    step = max(1, ROWS // len(cells.counts))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            _, bound = cells.bounds(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1))
            yield part, bound >= threshold


def _asked(asked: DataFrame) -> DataFrame:
    return asked.select(F.col("query_id").cast("long").alias("query_id"), "embedding")


def reached(asked: DataFrame, cells: Cells, threshold: float) -> DataFrame:
    """query_id, embedding, cell: every cell that may hold a row at ``threshold`` or more of a query (query_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, near in _reaching(batches, cells, threshold):
            q, c = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), b.column(1).take(pa.array(q)), pa.array(c, pa.int32())], names=["query_id", "embedding", "cell"])

    return _asked(asked).mapInArrow(run, f"query_id long, embedding {asked.schema['embedding'].dataType.simpleString()}, cell int")


def reached_counts(asked: DataFrame, cells: Cells, threshold: float) -> dict[int, int]:
    """How many rows ``reached`` has of each cell that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cells.counts), np.int64)
        for _, near in _reaching(batches, cells, threshold):
            n += near.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], names=["cell", "n"])

    return {r.cell: r.n for r in _asked(asked).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # MOST_CELLS at most


@dataclass
class CloseJoin:
    """What a join has met: pairs that were multiplied, of all pairs; and its links."""

    links: DataFrame
    compared: int
    all_pairs: int


def close(vectors: DataFrame, threshold: float, cells: int | None = None, few: int | None = None) -> CloseJoin:
    """Links query_id, source, doc_id, score between different rows of ``vectors`` (source, doc_id, embedding) at ``threshold`` or more, each from both ends.

    Each row meets the cells that it can have a link in. Where these hold more
    than ``WORTH`` of all pairs or come to more than ``COPIES`` a row, as with a
    low threshold in many dimensions, or where there are ``few`` rows, all rows
    meet: the links are the same. The cells are counted before a row is copied."""
    n = vectors.count()
    asked = vectors.select(F.col("doc_id").alias("query_id"), "embedding")
    directions = fitted(vectors, cells or max(1, round(n**0.5))) if n > (FEW if few is None else few) else np.zeros((1, 1))
    if directions.any():
        rows = scratch.written(placed(vectors, directions), "placed")
        found = Cells.of(directions, rows)
        met = reached_counts(asked, found, threshold)
        compared = sum(m * int(found.counts[c]) for c, m in met.items())
        if compared <= WORTH * n * n and sum(met.values()) <= COPIES * n:
            return CloseJoin(dense.cell_links(reached(asked, found, threshold), rows, threshold, counts=met), compared, n * n)
    return CloseJoin(dense.similar(asked, vectors, threshold), n * n, n * n)
