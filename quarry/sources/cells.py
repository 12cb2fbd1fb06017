"""A stored vector index in cells: approximate and exact nearest vectors, with a filter on stored columns.

Directions of the space are fitted by Spark's k-means on a bounded sample of unit
vectors; every row goes to the cell of the nearest one. ``rows/cell=N/`` holds a
cell's rows with all their columns, in several files where it has many rows;
``cells`` holds, of each cell, its direction, how many rows it has and the widest
angle between the direction and one of them.

A search reads the files of the cells that its queries probe and no others; a
filter on stored columns goes to the scan. The angle between a query and a row of
a cell is at least that to the cell's direction less the cell's widest one. So an
exact search probes the nearest cells first, and then those whose bound reaches
the k-th best score found."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quarry import scratch
from quarry.operators import dense
from quarry.operators.directions import Cells, fitted, placed

FILE_ROWS = 200_000


class CellIndex:
    """An index at ``root``. ``build`` writes a new version whole and then names it, so searches never see half of one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, cells: int | None = None) -> None:
        """``vectors``: source, doc_id, embedding, and columns for filters. Rows without a vector are left out.

        ``cells`` is the root of the number of rows where it is not given, ``MOST_CELLS`` at most."""
        version = f"{self.root}/v-{uuid.uuid4().hex}"
        vectors = vectors.where(F.col("embedding").isNotNull())
        size = vectors.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
        if size.least != size.most:
            raise dense.EmbedderMismatchError(f"vectors have {size.least} to {size.most} numbers")
        directions = fitted(vectors, cells or max(1, round(size.n**0.5)))
        placed(vectors, directions).write.parquet(f"{version}/placed")
        rows = self.spark.read.parquet(f"{version}/placed")
        found = Cells.of(directions, rows)
        files = F.array(*(F.lit(max(1, -(-int(n) // FILE_ROWS))) for n in found.counts))
        split = F.pmod(F.xxhash64("source", "doc_id"), F.get(files, F.col("cell")).cast("long"))
        rows.drop("__angle").repartition("cell", split).write.partitionBy("cell").parquet(f"{version}/rows")
        table = [(c, [float(x) for x in d], float(found.widest[c]), int(found.counts[c])) for c, d in enumerate(directions)]
        self.spark.createDataFrame(table, "cell int, direction array<double>, widest double, n long").coalesce(1).write.parquet(f"{version}/cells")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{version}/placed")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.spark.createDataFrame([(version, vectors.schema.json())], "version string, kinds string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/newest")

    def newest(self) -> Row:
        """version and kinds (the stored columns) of the newest index."""
        return self.spark.read.schema("version string, kinds string").parquet(f"{self.root}/newest").first()

    def cells(self) -> Cells:
        rows = sorted(self.spark.read.parquet(f"{self.newest().version}/cells").collect(), key=lambda r: r.cell)
        return Cells(np.array([r.direction for r in rows]), np.array([r.widest for r in rows]), np.array([r.n for r in rows]))

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """Stored rows, of some cells only: their folders are all that is read."""
        at = self.newest()
        df = self.spark.read.schema(StructType.fromJson(json.loads(at.kinds)).add("cell", IntegerType())).parquet(f"{at.version}/rows")
        return df if cells is None else df.where(F.col("cell").isin(cells) if cells else F.lit(False))

    def _probes(self, asked: DataFrame, cells: Cells, probes: int) -> DataFrame:
        """query_id, embedding, cell: the nearest cells of ``asked`` (query_id, embedding) that have rows; with a column least (a score), those behind the nearest whose bound reaches it."""
        more = "least" in asked.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(1)
                cosine, bound = cells.bounds(lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1))
                order = np.argsort(np.where(cells.counts == 0, np.inf, -cosine), axis=1, kind="stable")
                near = np.zeros(cosine.shape, bool)
                np.put_along_axis(near, order[:, :probes], True, 1)
                near &= cells.counts > 0
                if more:
                    near = ~near & (bound >= b.column(2).to_numpy(zero_copy_only=False)[:, None])
                q, c = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), lists.take(pa.array(q)), pa.array(c, pa.int32())], names=["query_id", "embedding", "cell"])

        return asked.mapInArrow(run, "query_id long, embedding array<double>, cell int")

    def _found(self, probes: DataFrame, k: int, where: Column | None) -> DataFrame:
        wanted = sorted(r.cell for r in probes.select("cell").distinct().collect())  # MOST_CELLS at most
        rows = self.rows(wanted)
        return dense.cell_topk(probes, rows if where is None else rows.where(where), k)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, where: Column | None = None) -> DataFrame:
        """query_id, source, doc_id, score, rank among the rows of the ``probes`` nearest cells of each query (query_id, embedding)."""
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return dense.ranked(self._found(self._probes(asked, self.cells(), probes), k, where), k)

    def search_exact(self, queries: DataFrame, k: int = 10, probes: int = 4, where: Column | None = None) -> DataFrame:
        """As ``search``, and equal to a search of all rows: cells that could hold one of the best are read too."""
        cells = self.cells()
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        first = scratch.written(dense.ranked(self._found(self._probes(asked, cells, probes), k, where), k), "first")  # k rows a query; read three times
        last = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        bounded = asked.join(last, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))).select("query_id", "embedding", "least")
        then = self._found(self._probes(bounded, cells, probes), k, where)
        return dense.ranked(first.drop("rank").unionByName(then), k)

    def read_share(self, queries: DataFrame, probes: int) -> float:
        """Which part of the stored rows a search of these queries reads."""
        cells = self.cells()
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        read = [r.cell for r in self._probes(asked, cells, probes).select("cell").distinct().collect()]
        return float(cells.counts[read].sum() / max(1, cells.counts.sum()))
