"""The stored vector index: exact searches against all rows, recall and what is read of it, filters, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense, directions
from quarry.sources import cells as cells_module
from quarry.sources.cells import CellIndex


@pytest.fixture(scope="module")
def clustered(spark):
    """4,000 vectors around 60 directions, a third of them around one, with a column to filter on."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    of = np.where(rng.random(4000) < 0.33, 0, rng.integers(0, 60, 4000))
    x = centres[of] + 0.35 * rng.normal(size=(4000, 24))
    rows = [("a" if i % 3 else "b", i, x[i].tolist(), i % 10) for i in range(4000)]
    rows[7] = ("a", 7, [0.0] * 24, 7)
    return spark.createDataFrame(rows, "source string, doc_id long, embedding array<double>, shelf int")


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    patch = pytest.MonkeyPatch()
    patch.setattr(cells_module, "FILE_ROWS", 60)
    out = CellIndex(spark, f"file://{tmp_path_factory.mktemp('cells')}/index")
    out.build(clustered)
    patch.undo()
    return out


def asked(clustered):
    return clustered.where("doc_id % 100 = 7").select(F.col("doc_id").alias("query_id"), "embedding")


def test_every_row_is_in_one_cell(clustered, index):
    rows = index.rows()
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == list(range(4000))
    cells = index.cells()
    assert cells.counts.sum() == 4000 and len(cells.counts) > 40
    hot = int(cells.counts.argmax())
    assert cells.counts[hot] > 120 and len(index.rows([hot]).inputFiles()) > 1


@pytest.mark.parametrize("where", [None, "shelf = 3 and source = 'a'"])
def test_exact_search_equals_all_rows(clustered, index, where):
    rows = clustered if where is None else clustered.where(where)
    want = dense.dense_topk(asked(clustered), rows.select("source", "doc_id", "embedding"), 10)
    got = index.search_exact(asked(clustered), 10, 2, None if where is None else F.expr(where))
    columns = ["query_id", "source", "doc_id", "score", "rank"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_recall_and_rows_read(spark, clustered, index):
    one = asked(clustered).where("query_id = 107")
    assert index.read_share(one, 2) < 0.4
    want = {tuple(r) for r in dense.dense_topk(asked(clustered), clustered.select("source", "doc_id", "embedding"), 10).select("query_id", "doc_id").collect()}
    got = {tuple(r) for r in index.search(asked(clustered), 10, 6).select("query_id", "doc_id").collect()}
    assert len(want & got) >= 0.9 * len(want)
    light = clustered.where("doc_id <> 7").join(index.rows().groupBy("cell").count().where("count < 100").join(index.rows(), "cell").select("doc_id"), "doc_id", "left_semi").limit(1)
    assert index.read_share(light.select(F.col("doc_id").alias("query_id"), "embedding"), 2) < 0.1


def test_filter_and_cells_reach_the_scan(clustered, index, capsys):
    rows = index.rows([1, 2]).where("shelf = 3")
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("\n")[0] and "EqualTo(shelf,3)" in plan


def test_recall_on_text_vectors(spark, tmp_path):
    docs = dense.with_fake_embeddings(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("source", "doc_id", "text")).select("source", "doc_id", "embedding")
    index = CellIndex(spark, f"file://{tmp_path}/texts")
    index.build(docs)
    q = dense.with_fake_embeddings(spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text"), "text").select("query_id", "embedding")
    want = {tuple(r) for r in dense.dense_topk(q, docs, 10).select("query_id", "doc_id").collect()}
    got = {tuple(r) for r in index.search(q, 10, 10).select("query_id", "doc_id").collect()}
    assert len(want & got) >= 0.9 * len(want)
    assert index.read_share(q.limit(1), 10) < 0.25


def test_odd_rows(spark, tmp_path):
    index = CellIndex(spark, f"file://{tmp_path}/odd")
    schema = "source string, doc_id long, embedding array<float>"
    index.build(spark.createDataFrame([("a", 1, None)], schema))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert index.search(q).count() == 0 and index.search_exact(q).count() == 0
    index.build(spark.createDataFrame([("a", 1, [0.0, 0.0]), ("b", 2, [2.0, 0.0]), ("b", 2, [2.0, 0.0]), (None, 3, [1.0, 1.0])], schema))
    assert [(r.doc_id, round(r.score, 4)) for r in index.search_exact(q).orderBy("rank").collect()] == [(2, 1.0), (2, 1.0), (3, 0.7071), (1, 0.0)]
    with pytest.raises(Exception, match="numbers"):
        index.build(spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, [1.0])], schema))


def test_fitting_sends_no_pairs_of_directions_to_the_driver(spark, tmp_path):
    """401 directions of 8 numbers: beyond a million of k * k * 8 the solver by rows collects their distances in every turn."""
    x = np.random.default_rng(3).random((8000, 8))
    vectors = spark.createDataFrame([("a", i, r.tolist()) for i, r in enumerate(x)], "source string, doc_id long, embedding array<double>")
    group = f"fit-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, group)
    found = directions.fitted(vectors, 401)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs, store = spark.sparkContext.statusTracker().getJobIdsForGroup(group), spark.sparkContext._jsc.sc().statusStore()
    names = {stages.apply(i) for j in jobs for stages in [store.job(j).stageIds()] for i in range(stages.size())}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) > 10 and len(found) == 401
    assert max(store.lastStageAttempt(s).resultSize() for s in names) < 401 * 400 / 2 * 16
