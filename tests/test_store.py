"""Files, the store, streams, run folders and the command line."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from quarry import cli, config, experiment, generation, manifest, providers, scratch, server
from quarry.functions.text import content_hash, fake_embedding
from quarry.operators.dense import EmbedderMismatchError
from quarry.operators.retrieval import RetrievalPlan
from quarry.sources import fetch, files
from quarry.sources.store import ChunkStore
from quarry.streaming.upsert import upsert_stream


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "chunk_id string, document string, parent_id string").withColumn("content_hash", content_hash(F.col("document")))


def test_pages_and_snippets(spark, tmp_path):
    for name, text in (("docs/a.md", "# A"), ("docs/x/b.md", "B"), ("docs/release-notes.md", "no"), ("src/s/one.py", "code\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in files.read_pages(spark, str(tmp_path / "docs")).orderBy("path").collect()] == [("a.md", "# A"), ("x/b.md", "B")]
    assert files.read_pages(spark, str(tmp_path / "docs"), 1).count() == 1
    assert files.read_snippets(spark, str(tmp_path / "src")).first()["path"] == "src/s/one.py"


def test_snapshot_and_eval_set(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"fetched_at": "x", "discussions": [{"discussion_id": "1", "title": "t", "question_body": "q", "answer_body": "a", "url": "u", "category": None}]}, indent=1))
    assert files.read_discussions(spark, str(tmp_path / "d.json")).first()["answer_body"] == "a"
    (tmp_path / "s.jsonl").write_text('{"id": "1", "dataset": "s", "question": "q", "gold_urls": ["u"]}\n\n')
    assert files.read_eval_set(spark, str(tmp_path), "s").first()["gold_urls"] == ["u"]


def test_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}")
    with pytest.raises(FileNotFoundError):
        store.read("docs")
    store.upsert(chunks(spark, ("a", "one", "p"), ("b", "two", "p")), "docs", "sha1")
    store.upsert(chunks(spark, ("b", "new", "p"), ("c", "three", "q")), "docs")
    assert {r["chunk_id"]: r["document"] for r in store.read("docs").collect()} == {"a": "one", "b": "new", "c": "three"}
    assert store.read("docs").where(F.col("embedding") != fake_embedding(F.col("document"))).count() == 0
    assert store.identity("docs")["corpus_sha"] == "sha1" and store.family("docs", "p").count() == 2
    store.upsert(chunks(spark, ("c", "three", "q")), "docs", keep_missing=False)
    assert store.read("docs").count() == 1 and store.readiness(["docs"]) == {"docs": "ok"}
    with pytest.raises(EmbedderMismatchError):
        ChunkStore(spark, f"file://{tmp_path}", "fake", 9).read("docs")


def test_store_writes_what_differs(spark, tmp_path):
    """Written bytes follow the batch, an upsert that says nothing new makes no commit, deltas are merged, ids are read from their buckets."""
    store = ChunkStore(spark, f"file://{tmp_path}", compact_after=4, buckets=8)
    rows = [(f"c{i}", f"document {i} " + "word " * 200, f"p{i % 7}") for i in range(3000)]
    assert store.upsert(chunks(spark, *rows), "docs", "sha1")
    again = [("c5", "changed", "p5"), ("new", "newer", "p1"), ("new", "newer", "p1")]
    assert store.upsert(chunks(spark, *again, rows[6]), "docs")
    base, delta = store.stored_bytes("docs")
    assert delta < base / 20
    assert not store.upsert(chunks(spark, *again, rows[6]), "docs") and len(store.stored_bytes("docs")) == 2
    # a changed parent is written, and its content is not embedded again
    seen = store.read("docs").where("chunk_id = 'c6'").first().embedding

    store.embed = lambda text: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.lit(9.0))  # a vector that tells when it was made
    assert store.upsert(chunks(spark, ("c6", rows[6][1], "elsewhere")), "docs")
    moved = store.get("docs", ["c6"]).first()
    assert moved.parent_id == "elsewhere" and moved.embedding == seen
    assert store.refresh("docs", "sha2") and not store.refresh("docs", "sha2") and len(store.stored_bytes("docs")) == 3
    store.upsert(chunks(spark, ("c7", "embedded anew", "p")), "docs")
    assert store.get("docs", ["c7"]).first().embedding == [9.0] * 8
    store.upsert(chunks(spark, ("c8", "compacted after this", "p")), "docs")
    assert len(store.stored_bytes("docs")) == 1 and store.identity("docs")["corpus_sha"] == "sha2" and store.vacuum("docs") == 5
    want = {c: d for c, d, _ in rows} | {"c5": "changed", "new": "newer", "c7": "embedded anew", "c8": "compacted after this"}
    assert {r.chunk_id: r.document for r in store.read("docs").collect()} == want
    assert store.upsert(chunks(spark, rows[1], ("c5", "changed", "p5")), "docs", keep_missing=False)
    assert sorted(r.chunk_id for r in store.read("docs").collect()) == ["c1", "c5"]


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """A commit that another writer has made first is seen; the upsert begins again from it and nothing is lost."""
    one, two = (ChunkStore(spark, f"file://{tmp_path}") for _ in range(2))
    one.upsert(chunks(spark, ("a", "x", "p"), ("b", "y", "p")), "docs")
    write, met = ChunkStore._write, []

    def late(self, source, rows, buckets):
        out = write(self, source, rows, buckets)
        if self is one and not met:
            met.append(two.upsert(chunks(spark, ("a", "theirs", "p"), ("c", "z", "p")), "docs"))
        return out

    monkeypatch.setattr(ChunkStore, "_write", late)
    one.upsert(chunks(spark, ("a", "x", "p"), ("d", "w", "p")), "docs")
    assert met == [True]
    assert {r.chunk_id: r.document for r in one.read("docs").collect()} == {"a": "x", "b": "y", "c": "z", "d": "w"}
    assert one.log("docs").newest()[0] == 3 and one.vacuum("docs") == 0
    log = one.log("docs")
    assert not log.commit(3, {"x": 1}) and log.commit(4, log.newest()[1])


def test_store_columns_may_be_added(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}")
    store.upsert(chunks(spark, ("a", "x", "p"), ("b", None, None)), "docs")
    store.upsert(chunks(spark, ("b", None, "q"), ("c", "z", "p")).withColumn("shelf", F.lit(3)), "docs")
    assert sorted((r.chunk_id, r.parent_id, r.shelf) for r in store.read("docs").collect()) == [("a", "p", None), ("b", "q", 3), ("c", "p", 3)]
    store.upsert(chunks(spark, ("a", "x", "p")).where("false"), "docs")
    assert store.read("docs").count() == 3


def test_stream(spark, tmp_path):
    rows = chunks(spark, ("a", "one", "p"), ("a", "two", "p"), ("b", "x", "p"))
    rows.write.parquet(f"{tmp_path}/in")
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        upsert_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), store, "docs", f"{tmp_path}/check", order="document").awaitTermination()
    assert {r["chunk_id"]: r["document"] for r in store.read("docs").collect()} == {"a": "two", "b": "x"}


def test_runs(tmp_path, capsys):
    cfg = config.from_dict({"name": "a run", "eval": {"thresholds": {"mrr": {"min": 0.5}, "recall_at_5": {"min": 0.5}}}})
    folder = manifest.new_run(cfg, tmp_path)
    manifest.write_manifest(folder, cfg, "c", {"d": {"mrr": 0.6, "recall_at_k": {"5": 0.4}}})
    assert manifest.metric(manifest.load_run(folder.name, tmp_path), "d", "recall_at_5") == 0.4
    assert manifest.pin(folder.name, tmp_path, "base").name == "base" and len(manifest.list_runs(tmp_path, True)) == 2
    with pytest.raises(FileExistsError):
        manifest.pin(folder.name, tmp_path, "base")
    (tmp_path / "baseline.json").write_text('{"d": "base"}')
    (tmp_path / "c.json").write_text(json.dumps({"name": "a run", "eval": {"thresholds": {"mrr": {"min": 0.5}, "recall_at_5": {"min": 0.5}}}}))
    assert cli.main(["--runs-root", str(tmp_path), "gate", "--run", folder.name, "--config", str(tmp_path / "c.json"), "--dataset", "d"]) == 1
    assert "| mrr | 0.600 | 0.500 | 0.600 | PASS | steady |" in capsys.readouterr().out


def test_providers():
    assert providers.get_embedder().dim == 8
    with pytest.raises(ValueError):
        providers.get_model("none")


def test_experiment(spark):
    rows = [("c1", 1, "docs", "alpha beta", "u1"), ("c2", 2, "docs", "gamma delta", "u2"), ("c3", 3, "docs", "alpha beta", "u3")]
    docs = spark.createDataFrame(rows, "chunk_id string, doc_id long, source string, text string, url string").withColumn("merged_urls", F.array().cast("array<string>"))
    items = spark.createDataFrame([("1", "s", "alpha beta", ["u1"], ["c3"], None), ("2", "s", "gamma", ["u1"], [], "no")], "id string, dataset string, question string, gold_urls array<string>, exclude_chunk_ids array<string>, verified string")
    cfg = config.from_dict({"name": "x", "retrieval": {"dense": {"enabled": False}, "bm25": {"enabled": True}}, "eval": {"datasets": ["s"]}})
    out = experiment.evaluate(cfg, items, docs).collect()
    assert len(out) == 1 and out[0]["retrieved"] == ["c1"] and out[0]["mrr"] == 1.0
    with pytest.raises(NotImplementedError):
        experiment.check_supported(config.from_dict({"name": "x", "generation": {"enabled": True}}))


@pytest.fixture
def small_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    rows = [("c1", "alpha beta gamma", "p", "https://x/a/one"), ("c2", "delta epsilon", "p", "https://x/b/two"), ("c3", "zeta eta", "q", "https://x/b/three#t")]
    df = spark.createDataFrame(rows, "chunk_id string, document string, parent_id string, url string").withColumn("content_hash", content_hash(F.col("document"))).withColumn("merged_urls", F.array().cast("array<string>"))
    store.upsert(df, "docs", "sha9")
    (tmp_path / "sets").mkdir()
    items = [{"id": str(i), "dataset": "d", "question": q, "ground_truth": "g", "gold_urls": [u], "exclude_chunk_ids": [], "verified": v} for i, (q, u, v) in enumerate([("alpha gamma", "https://x/a/one", None), ("epsilon", "https://x/b/two#none", None), ("zeta", "https://x/b/three#t", "no")])]
    (tmp_path / "sets/d.jsonl").write_text("".join(json.dumps(i) + "\n\n" for i in items))
    (tmp_path / "c.yaml").write_text("name: run one\ncorpus:\n  sources: [docs]\nretrieval:\n  dense: {enabled: false}\n  bm25:\n    enabled: true  # lexical\neval:\n  datasets:\n    - d\n  thresholds: {mrr: {min: 0.5}}\n")
    return tmp_path


def test_cli_run(spark, small_store, capsys):
    at = ["--runs-root", str(small_store / "runs")]
    given = ["--config", str(small_store / "c.yaml"), "--sets", str(small_store / "sets"), "--store", f"file://{small_store}/store"]
    assert cli.main([*at, "run", *given]) == 0
    shown = capsys.readouterr().out
    assert "d  (n=2)" in shown and "mrr: 1.000  [1.000, 1.000]" in shown
    (run,) = manifest.list_runs(small_store / "runs")
    folder = small_store / "runs" / run["run_id"]
    rows = manifest.read_jsonl(folder / "retrieval.jsonl")
    assert [(r["item_id"], r["gold_chunk_ids"], r["gold_granularity"], r["retrieved"][0]["chunk_id"], r["retrieved"][0]["rank"]) for r in rows] == [("d::0", ["c1"], "anchor", "c1", 1), ("d::1", ["c2"], "page", "c2", 1)]
    assert rows[0]["metrics"]["recall_at_1"] == 1.0 and rows[0]["retrieved"][0]["url"] == "https://x/a/one"
    assert run["corpus_sha"] == "sha9" and run["timings"]["items"] == 2 and run["timings"]["stages"]["bm25"]["rows"] > 0 and run["metrics"]["d"]["cis"]["mrr"] == [1.0, 1.0] and len(run["dataset_shas"]["d"]) == 64
    assert config.from_dict(config.read_yaml((folder / "config.resolved.yaml").read_text())) == config.load(small_store / "c.yaml")
    assert cli.main([*at, "gate", *given, "--dataset", "d", "--summary-out", str(small_store / "sum.md")]) == 0
    assert "PASS" in (small_store / "sum.md").read_text()
    assert cli.main([*at, "leaderboard", "--dataset", "d", "--out", str(small_store / "board.json")]) == 0
    board = json.loads((small_store / "board.json").read_text())
    assert [r["n"] for r in board] == [2, 2] and board[0]["mrr"] == 1.0 and board[0]["mrr_ci"] == [1.0, 1.0]
    assert manifest.read_jsonl(small_store / "nowhere.jsonl") == []


def test_cli_sessions(spark, small_store, capsys):
    given, sets = ["--dataset", "d", "--sets", str(small_store / "sets")], small_store / "sets"
    assert cli.main(["review", *given, "--n", "10"], iter(["what", "q"])) == 0
    assert "1/3 of d" in capsys.readouterr().out
    assert cli.main(["review", *given], iter(["y", "e new words"])) == 0
    rows = {r["id"]: r for r in manifest.read_jsonl(sets / "d.jsonl")}
    assert sorted(str(r["verified"]) for r in rows.values()) == ["edited", "no", "yes"] and any(r["question"] == "new words" for r in rows.values())
    assert "3/3 of d" in capsys.readouterr().out and not (sets / "d.journal.jsonl").exists()
    # a session that broke off: its journal counts
    (sets / "d.jsonl").write_text("".join(json.dumps({"id": i, "dataset": "d", "question": "epsilon", "gold_urls": [], "extra": 5}) + "\n" for i in "789"))
    (sets / "d.journal.jsonl").write_text(json.dumps({"item_id": "7", "kind": "label", "raw": "n", "decided_at": "2024-01-01"}) + "\n")
    assert cli.main(["label", *given, "--store", f"file://{small_store}/store"], iter([" , ", " https://x/b/two , "])) == 0
    rows = {r["id"]: r for r in manifest.read_jsonl(sets / "d.jsonl")}
    assert rows["7"]["verified"] == "no" and rows["9"]["gold_urls"] == ["https://x/b/two"] and "verified" not in rows["8"] and rows["8"]["extra"] == 5
    assert "https://x/a/one" in capsys.readouterr().out


def test_cli_index_and_gold_of_the_corpus(spark, small_store, capsys):
    """Pages with a snippet and discussions are stored; an evaluation finds gold in the corpus that the store lacks."""
    root = small_store
    for name, text in (("docs/a.md", "# Title { #top }\n## One { #one }\n" + "alpha beta " * 60 + "\n{* ../../src/s.py ln[2] *}\n## Two { #two }\n" + "gamma delta " * 60), ("src/s.py", "first = 1\nsecond_line = 2\n")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "disc.json").write_text(json.dumps({"discussions": [{"discussion_id": "1", "title": "t", "question_body": "q", "answer_body": "an answer", "url": "https://x/d/1", "category": None}]}))
    places = ["--docs", str(root / "docs"), "--snippets", str(root / "src"), "--discussions", str(root / "disc.json"), "--base-url", "https://x"]
    assert cli.main(["index", *places, "--store", f"file://{root}/new", "--sha", "s1"]) == 0
    assert "docs: 2 chunks" in capsys.readouterr().out
    store = ChunkStore(spark, f"file://{root}/new")
    assert "second_line = 2" in "".join(r.document for r in store.read("docs").collect()) and store.identity("docs")["corpus_sha"] == "s1"
    assert [r.chunk_id for r in store.read("discussions").collect()] == ["1"]
    cli.main(["index", *places, "--store", f"file://{root}/new"])
    assert len(store.stored_bytes("docs")) == 1
    (root / "sets/g.jsonl").write_text(json.dumps({"id": "1", "dataset": "g", "question": "gamma", "gold_urls": ["https://x/a/#two"], "exclude_chunk_ids": []}) + "\n")
    (root / "g.yaml").write_text("name: gold\ncorpus:\n  sources: [docs]\nretrieval:\n  dense: {enabled: false}\n  bm25:\n    enabled: true\neval:\n  datasets:\n    - g\n")
    run = ["--runs-root", str(root / "runs"), "run", "--config", str(root / "g.yaml"), "--sets", str(root / "sets"), "--store", f"file://{root}/store"]
    capsys.readouterr()
    assert cli.main(run) == 0 and "n=0" in capsys.readouterr().out
    assert cli.main([*run, *places]) == 0 and "n=1" in capsys.readouterr().out


def test_first_rows_of_a_set(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"id": str(i), "dataset": "s", "question": "q"}) + "\n\n" for i in (5, 3, 9, 1)))
    assert [r.id for r in files.read_eval_set(spark, str(tmp_path), "s", 3).collect()] == ["5", "3", "9"]


def scripted():
    """A model, built in tasks, that says what it was asked in capitals, or a passage for a question that it is to imagine."""

    class Model:
        name = model = "scripted"

        def complete(self, messages, *, temperature=0.0, max_tokens=1024):
            text = messages[-1]["content"]
            return providers.Completion(" delta epsilon \n" if "Passage:" in text else f"{len(messages)} {text.upper()}", "scripted")

    return Model


def test_generation(spark):
    docs = spark.createDataFrame([("docs", 1, "alpha beta"), ("docs", 2, "delta epsilon")], "source string, doc_id long, text string")
    q = spark.createDataFrame([(5, "alpha"), (6, "nothing at all")], "query_id long, query string")
    rows = {r["query_id"]: r for r in generation.answers(q, docs, scripted(), 1, RetrievalPlan(dense=False, bm25=True)).collect()}
    assert rows[5]["contexts"] == ["alpha beta"] and rows[5]["sources"] == [1] and rows[5]["answer"] == "2 CONTEXT:\nALPHA BETA\n\nQUESTION: ALPHA\n\nANSWER:"
    assert rows[6]["contexts"] == [] and rows[6]["answer"].startswith("2 CONTEXT:\n\n\nQUESTION")
    made = generation.hypothetical(scripted())(q, 2).orderBy("query_id", "nth").collect()
    assert [tuple(r) for r in made] == [(5, 1, "delta epsilon"), (5, 2, "delta epsilon"), (6, 1, "delta epsilon"), (6, 2, "delta epsilon")]
    counts = {}
    out = RetrievalPlan(rewriter=generation.hypothetical(scripted()), rewrite_n=1, bm25=True).run(q, docs, counts=counts).where("query_id = 6").collect()
    assert {r["doc_id"] for r in out} == {1, 2} and next(r["rank"] for r in out if r["doc_id"] == 2) == 1
    assert counts["dense_1"].get["rows"] == 4 and {"dense", "bm25", "fusion", "caps"} <= counts.keys()


def test_server():
    app = server.application(lambda: {"docs": "ok", "discussions": "empty"}, lambda text, k: {"question": text, "answer": "a", "contexts": [], "sources": [k]})

    def call(method, path, body=b""):
        told = []
        out = b"".join(app({"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}, lambda status, headers: told.append(status)))
        return int(told[0][:3]), json.loads(out)

    assert call("GET", "/health") == call("GET", "/api/health") == (200, {"status": "ok"})
    assert call("GET", "/api/health/ready") == (503, {"detail": {"ready": False, "problems": ["discussions: empty"]}})
    assert call("POST", "/api/ask", b'{"question": "q"}') == (200, {"question": "q", "answer": "a", "contexts": [], "sources": [5]})
    assert call("POST", "/api/ask", b'{"k": 3}')[0] == 422 and call("GET", "/api/ask")[0] == 405 and call("GET", "/x")[0] == 404


def test_fetch(tmp_path):
    waits, replies = [], iter([(502, {}), (403, {}), (200, {"nodes": [{"id": "1", "title": "t", "bodyText": "q", "url": "u", "answer": {"bodyText": "a"}, "category": None}], "next": "c"}), (200, {"nodes": [{"id": "2", "title": "t", "bodyText": "q", "url": "u", "answer": None}], "next": None})])
    pages = fetch.discussion_pages(lambda _: next(replies), wait=waits.append)
    assert fetch.snapshot(pages, tmp_path / "d.json") == 1 and waits == [1.0, 2.0]
    assert json.loads((tmp_path / "d.json").read_text())["discussions"][0]["discussion_id"] == "1"
    with pytest.raises(ValueError):
        fetch.persistent(lambda _: (404, {}), {})
    with pytest.raises(fetch.TransportError):
        fetch.persistent(lambda _: (500, {}), {}, wait=lambda _: None)
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as tar:
        for name, text in (("top-1/docs/a.md", b"# A"), ("top-1/docs_src/x/b.py", b"code"), ("top-1/setup.py", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    assert fetch.extract(tmp_path / "a.tgz", tmp_path / "out", "s1")["files"] == 2 and (tmp_path / "out/docs_src/x/b.py").read_text() == "code" and not (tmp_path / "out/setup.py").exists()
    assert fetch.chunk_digest(["b", "a"]) == fetch.chunk_digest(["a", "b"])


def test_migrate(spark, tmp_path):
    chunks(spark, ("a", "one", "p")).withColumn("embedding", fake_embedding(F.col("document"))).write.parquet(f"{tmp_path}/old")
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    assert store.migrate(f"file://{tmp_path}/old", "docs", "fake", 8, "s") and not store.migrate(f"file://{tmp_path}/old", "docs", "fake", 8)
    assert store.read("docs").count() == 1 and store.identity("docs")["corpus_sha"] == "s" and not store.migrate(f"file://{tmp_path}/none", "other", "fake", 8)


def test_yaml():
    assert config.read_yaml("a: \"x # y\"  # z\nb: [1, 2]\n") == {"a": "x # y", "b": [1, 2]}
    for bad in ("a:\n  - b: 1\n", "a: &x 1\n", "a: |\n  text\n"):
        with pytest.raises(ValueError):
            config.read_yaml(bad)


def _exchanged(spark, run) -> int:
    """Bytes that the jobs of ``run`` shuffle."""
    group = f"g-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, seen = spark.sparkContext._jsc.sc().statusStore(), set()
    for j in spark.sparkContext.statusTracker().getJobIdsForGroup(group):
        ids = store.job(j).stageIds()
        seen |= {ids.apply(i) for i in range(ids.size())}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return sum(store.lastStageAttempt(i).shuffleWriteBytes() for i in seen if store.lastStageAttempt(i).status().toString() == "COMPLETE")


def test_texts_are_shuffled_once_a_change(spark, tmp_path):
    """An upsert deals its own texts out once and those of the store never; a compaction deals each once."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), "")
    rows = scratch.written(spark.range(0, 2000, 1, 4).withColumn("document", text).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), "document", content_hash(F.col("document")).alias("content_hash")), "rows")
    # shuffled whole, by a column that tells nothing of the texts
    once = _exchanged(spark, lambda: rows.repartition(4, "chunk_id").write.format("noop").mode("overwrite").save())
    store = ChunkStore(spark, f"file://{tmp_path}/once")
    assert _exchanged(spark, lambda: store.upsert(rows, "docs")) < 1.3 * once
    again = rows.withColumn("document", F.concat("document", F.lit("."))).withColumn("content_hash", content_hash(F.col("document")))
    assert _exchanged(spark, lambda: store.upsert(again, "docs")) < 1.5 * once
    assert _exchanged(spark, lambda: store.compact("docs")) < 2.4 * once
    assert sorted(map(tuple, store.read("docs").select(*again.columns).collect())) == sorted(map(tuple, again.collect()))


def test_copies_of_an_id_and_ids_that_come_again(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/copies")
    kinds = "chunk_id string, document string, content_hash string"
    held = lambda: sorted(tuple(r) for r in store.read("docs").select("chunk_id", "document").collect())
    assert store.upsert(spark.createDataFrame([("a", "1", "h1"), ("a", "2", "h2"), ("a", "3", "h2"), ("b", "1", "h")], kinds), "docs")
    assert held() == [("a", "3"), ("b", "1")]
    assert not store.upsert(spark.createDataFrame([("a", "3", "h2"), ("a", "9", "h1")], kinds), "docs")
    assert store.upsert(spark.createDataFrame([("a", "4", "h2")], kinds), "docs")  # another text under the old hash
    assert store.upsert(spark.createDataFrame([("b", "1", "h")], kinds), "docs", keep_missing=False) and held() == [("b", "1")]
    assert not store.upsert(spark.createDataFrame([("b", "1", "h")], kinds), "docs", keep_missing=False)
    assert store.upsert(spark.createDataFrame([("a", "4", "h2"), ("c", None, None)], kinds), "docs") and held() == [("a", "4"), ("b", "1"), ("c", None)]
    assert not store.upsert(spark.createDataFrame([("c", None, None)], kinds), "docs")
    store.compact("docs")
    assert held() == [("a", "4"), ("b", "1"), ("c", None)]
