"""Goldens by hand for the operators, and every SQL twin on the smallest tables."""

import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import config, timing
from quarry.functions import text as T
from quarry.operators import best, chunking, dense, directions, fusion, gold, lexical, markdown, metrics, review, runs, stats, synth
from quarry.operators.retrieval import RetrievalPlan
from quarry.plans import registry
from quarry.sources import draws

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def block(n):
    return "a" * (4 * n)


def test_tokens_and_estimates(spark):
    assert one(spark, T.bm25_tokens(F.col("t")), t="import fastapi.encoders, Use response_model") == ["import", "fastapi.encoders", "use", "response_model"]
    assert [one(spark, T.token_estimate(F.col("t")), t=t) for t in ("", "abcd", "abcde")] == [1, 1, 2]
    assert one(spark, T.trigrams(T.trigram_tokens(F.col("t"))), t="a b c a b c") == ["a b c", "b c a", "c a b"]
    assert one(spark, T.trigrams(T.trigram_tokens(F.col("t"))), t="a b") == []
    assert T.model_slug("BAAI/bge-small-en-v1.5") == "bge-small-en-v15"


@pytest.mark.parametrize(("path", "anchor", "url"), [("index.md", None, "https://e.org/"), ("a/index.md", None, "https://e.org/a/"), ("a/b.md", None, "https://e.org/a/b/"), ("a/b.md", "x", "https://e.org/a/b/#x")])
def test_doc_url(spark, path, anchor, url):
    assert one(spark, T.doc_url(F.col("p"), F.lit(anchor), "https://e.org/"), p=path) == url


def test_markdown(spark):
    pages = spark.createDataFrame([("p.md", 'a\n{* ../../src/x.py ln[1:2,4] hl[1] *}\n<div class="termy">\n<b>$</b> &lt;run&gt;\n</div>\n/// tip | Note\nbody\n///\n///\n## Head { #head }\n{* ../no.py *}')], "path string, text string")
    snippets = spark.createDataFrame([("src/x.py", "l1\nl2\nl3\nl4\n")], "path string, content string")
    row = markdown.normalize(pages, snippets).first()
    assert row["text"] == "a\n```python\nl1\nl2\nl4\n```\n$ <run>\n*Tip: Note*\nbody\n///\n## Head\n```python\n# snippet not found: ../no.py\n```"
    assert [tuple(a) for a in row["anchors"]] == [(2, "Head", "head")]


@pytest.mark.parametrize(("sizes", "groups"), [([300, 350], 1), ([420, 300], 2), ([300, 300], 1), ([700], 1), ([300, 250, 200, 50, 700, 10], 3)])
def test_pack(spark, sizes, groups):
    assert len(one(spark, chunking.packed(F.col("u")), u=[block(n) for n in sizes])) == groups


def test_split_oversized(spark):
    parts = one(spark, chunking.atomic(F.col("b"), F.lit(False)), b="\n".join([block(100)] * 7))
    assert [p.count("\n") + 1 for p in parts] == [6, 1]
    assert len(one(spark, chunking.atomic(F.col("b"), F.lit(True)), b="\n".join([block(100)] * 7))) == 1


def test_sections_and_chunks(spark):
    text = "intro " + block(40) + "\n## One\n" + block(160) + "\n```\n## no\n```\n### Sub\n" + block(160) + "\n#### deep\n## Two\n" + block(160)
    pages = spark.createDataFrame([("p.md", text, [(1, "Page", "p"), (2, "One", "one"), (2, "Two", "two")])], "path string, text string, anchors array<struct<level int, title string, anchor string>>")
    rows = sorted(chunking.doc_chunks(pages, "https://e.org").collect(), key=lambda r: r["chunk_index"])
    assert [r["section"] for r in rows] == ["", "One", "One > Sub", "Two"]
    assert [r["url"] for r in rows] == ["https://e.org/p/", "https://e.org/p/#one", "https://e.org/p/#two", "https://e.org/p/"]
    assert rows[1]["parent_id"] == rows[2]["parent_id"] != rows[3]["parent_id"]


def test_merge(spark):
    chunk = lambda doc, section, url: {"document": doc, "section": section, "url": url}
    schema = "c array<struct<document string, section string, url string>>"
    run = lambda cs: spark.createDataFrame([(cs,)], schema).select(chunking.merge_undersized(F.col("c")).alias("x")).first()["x"]
    out = run([chunk(block(30), "A > 1", "u1"), chunk(block(30), "A > 2", "u2"), chunk(block(30), "A > 3", "u3")])
    assert len(out) == 1 and out[0]["merged_urls"] == ["u2", "u3"] and out[0]["url"] == "u1"
    assert len(run([chunk(block(160), "A", "u"), chunk(block(30), "A", "u")])) == 2
    assert len(run([chunk(block(30), "A", "u"), chunk(block(10), "B", "u")])) == 1


def test_qa_chunks(spark):
    rows = spark.createDataFrame([("d1", "t", "q" * 600, " short ", "u", None), ("d2", "t", "q", "\n\n".join([block(350)] * 4), "u", "c")], "discussion_id string, title string, question_body string, answer_body string, url string, category string")
    out = {r["chunk_id"]: r for r in chunking.qa_chunks(rows).collect()}
    assert set(out) == {"d1", "d2::0", "d2::1"} and out["d1"]["document"] == " short " and len(out["d1"]["question"]) == 500 and out["d1"]["category"] == ""


def test_bm25_and_deny(spark):
    docs = spark.createDataFrame([("s", 1, "Use response_model to filter"), ("s", 2, "nothing here"), ("s", 3, "response_model and response_model again")], "source string, doc_id long, text string")
    q = spark.createDataFrame([(7, "response_model")], "query_id long, query string")
    assert [r["doc_id"] for r in lexical.bm25_topk(q, docs).orderBy("rank").collect()] == [3, 1]
    deny = spark.createDataFrame([(7, 3)], "query_id long, doc_id long")
    assert [(r["doc_id"], r["rank"]) for r in lexical.bm25_topk(q, docs, deny=deny).collect()] == [(1, 1)]


def test_bm25_both_ways(spark):
    """Queries that tasks hold and queries that are joined give the same ranks; null texts, empty queries and ties."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(rng.choice("ab"), i, " ".join(rng.choices(words, k=rng.randrange(25))) if i % 11 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(4)
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(6)))) for i in range(25)], "query_id long, query string")
    deny = spark.createDataFrame([(i, d) for i in range(25) for d in rng.sample(range(300), 20)], "query_id long, doc_id long")
    for more in ({}, {"deny": deny}, {"b": 0.0, "k1": 2.0}):
        held, joined = (sorted(map(tuple, lexical.bm25_topk(q, docs, 7, block=n, **more).collect())) for n in (25, 24))
        assert held == joined and held
    assert lexical.bm25_topk(q.limit(0), docs).count() == 0 and lexical.bm25_topk(q, docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "long", "int"])
def test_bm25_ids_of_any_type(spark, kind):
    """Ids are what they are, whether tasks hold the queries or joins do; ties go by id as its type sorts, null first."""
    docs = spark.createDataFrame([("s", str(i), "river stone" if i % 2 else "quiet river light") for i in (2, 10, 9, 4, 100, 31)] + [(None, None, "river stone")], "source string, doc_id string, text string")
    queries = spark.createDataFrame([(str(i), "stone river") for i in (3, 20)], "query_id string, query string")
    docs, queries = docs.withColumn("doc_id", F.col("doc_id").cast(kind)), queries.withColumn("query_id", F.col("query_id").cast(kind))
    held, joined = (lexical.bm25_topk(queries, docs.where("source is not null"), 4, block=block) for block in (10, 0))
    assert held.select("query_id", "doc_id").schema == joined.select("query_id", "doc_id").schema
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, joined.collect()))
    assert lexical.bm25_topk(queries, docs, 4).where("rank = 1").count() == 2


def test_best_of_many_batches():
    """What a task keeps over batches is what one sort of everything gives."""
    rng = np.random.default_rng(4)
    score = np.round(rng.random((5, 600)), 1)
    score[rng.random(score.shape) < 0.3] = -np.inf
    score[3] = -np.inf
    sources, docs = rng.choice(["a", "b"], 600).astype(object), np.arange(600)[::-1]
    kept = best.Best(7)
    for at in range(0, 600, 37):
        kept.add(np.arange(5), sources[at : at + 37], docs[at : at + 37], score[:, at : at + 37])
        if at % 3 == 0:
            kept.prune()
    rows = [r for b in kept.rows(pa.int64(), pa.int64()) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = [(q, sources[d], docs[d], score[q, d]) for q in range(5) for d in sorted(np.flatnonzero(np.isfinite(score[q])), key=lambda d: (-score[q, d], sources[d], docs[d]))[:7]]
    assert sorted(rows) == sorted(want)


def test_dense(spark):
    docs = dense.with_fake_embeddings(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 3, "z")], "source string, doc_id long, text string"))
    q = dense.with_fake_embeddings(spark.createDataFrame([(1, "y")], "query_id long, query string"), "query")
    top = dense.dense_topk(q, docs, 2).orderBy("rank").collect()
    assert (top[0]["doc_id"], top[0]["score"], len(top)) == (2, 1.0, 2)
    with pytest.raises(dense.EmbedderMismatchError):
        dense.assert_embedder({"embedding_model": "a", "embedding_dim": 8}, "b", 8)
    assert dense.dense_topk(q.limit(0), docs, 2).count() == 0


def test_fusion_caps_rerank(spark):
    rows = [(1, 0, 1, "docs", 10, "dense", 0.9), (1, 0, 2, "docs", 11, "dense", 0.8), (1, 1, 1, "docs", 11, "bm25", 5.0), (1, 1, 2, "docs", 10, "bm25", 4.0), (1, 1, 3, "discussions", 12, "bm25", 3.0)]
    r = spark.createDataFrame(rows, "query_id long, ranking_no int, pos int, source string, doc_id long, stage string, score double")
    out = fusion.reciprocal_rank_fusion(r).orderBy("rank").collect()
    assert [x["doc_id"] for x in out] == [10, 11, 12] and abs(out[0]["final_score"] - (1 / 61 + 1 / 62)) < 1e-8
    assert out[0]["stages"] == ["dense", "bm25"] and out[0]["scores"] == {"dense": 0.9, "bm25": 4.0}
    capped = fusion.per_source_caps(fusion.reciprocal_rank_fusion(r), {"docs": 1}).orderBy("rank").collect()
    assert [(x["doc_id"], x["rank"]) for x in capped] == [(10, 1), (12, 2)]
    texts = spark.createDataFrame([("docs", 10, "no"), ("docs", 11, "word"), ("discussions", 12, "word")], "source string, doc_id long, text string")
    q = spark.createDataFrame([(1, "word")], "query_id long, query string")
    again = fusion.rerank(fusion.reciprocal_rank_fusion(r), q, texts, 2).orderBy("rank").collect()
    assert [x["doc_id"] for x in again] == [11, 12]


def test_stage_times_add_up(spark):
    """Stages run one by one have the rows of the plan run as one, and their task times are those of all their jobs."""
    d = spark.createDataFrame([("docs" if i % 2 else "discussions", i, f"river stone {i % 5} light", f"p{i // 3}", i % 3) for i in range(60)], "source string, doc_id long, text string, parent_id string, chunk_index int")
    q = spark.createDataFrame([(1, "river 3"), (2, "light 4")], "query_id long, query string")
    plan, times = RetrievalPlan(candidates_k=10, dense=True, bm25=True, caps={"docs": 4}, rerank_top_n=5, expand_tokens=50), timing.StageTimes(spark)
    columns = ["query_id", "source", "doc_id", "rank", "content"]
    timed = plan.run(q, d, times=times)
    assert sorted(map(tuple, timed.select(*columns).collect())) == sorted(map(tuple, plan.run(q, d).select(*columns).collect()))
    assert list(times.seconds) == ["dense", "bm25", "fusion", "caps", "rerank", "expand"]
    assert times.rows["dense"] == 20 and times.rows["rerank"] == times.rows["expand"] == 10
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = store.jobsList(None)
    own = [jobs.apply(i) for i in range(jobs.size()) if jobs.apply(i).jobGroup().isDefined() and jobs.apply(i).jobGroup().get().startswith(times.run)]
    stages = {int(j.stageIds().apply(k)) for j in own for k in range(j.stageIds().size())}
    assert abs(sum(times.seconds.values()) - sum(store.lastStageAttempt(s).executorRunTime() for s in stages) / 1000) < 1e-6
    assert all(s > 0 for s in times.seconds.values()) and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert times.to_dict()["bm25"]["rows"] == times.rows["bm25"]


def test_plan_needs_a_stage():
    with pytest.raises(ValueError):
        RetrievalPlan(dense=False, bm25=False)
    cfg = config.from_dict({"name": "x", "retrieval": {"query_rewrite": {"enabled": True, "mode": "other"}}})
    with pytest.raises(NotImplementedError):
        RetrievalPlan.from_config(cfg)


def test_gold(spark):
    chunks = spark.createDataFrame([("c1", "p#a", ["p#b"]), ("c2", "p#c", [])], "chunk_id string, url string, merged_urls array<string>")
    items = spark.createDataFrame([(1, ["p#b"]), (2, ["p#zz"]), (3, ["q"])], "item_id long, gold_urls array<string>")
    out = {r["item_id"]: (r["gold_chunk_ids"], r["gold_granularity"]) for r in gold.resolve_gold(items, gold.gold_index(chunks)).collect()}
    assert out == {1: (["c1"], "anchor"), 2: (["c1", "c2"], "page"), 3: ([], "anchor")}


def test_gold_of_short_items(spark, tmp_path):
    """Items without five inner words, at word ends and within words, as the twin finds them."""
    docs = [(1, "see one two three four five sixteen and more", "a"), (2, "Alpha beta gammas", "a"), (3, "none of it", "b"), (4, "xone two three four five six seventy", "b"), (5, None, "b")]
    items = [(1, "one two three four five six"), (2, "beta gamma"), (3, "it"), (4, "one two three four five six seven"), (5, "beta Gamma"), (6, "..."), (7, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["gold_by_containment"]).fetchall())
    assert want == [(1, 1), (1, 4), (2, 2), (3, 3), (4, 4)]
    assert sorted(map(tuple, registry.queries()["gold_by_containment"](spark, str(tmp_path)).collect())) == want


def test_metrics(spark):
    items = spark.createDataFrame([("d", 1, list("abcde"), ["c", "e"])], "dataset string, item_id long, retrieved array<string>, gold array<string>")
    r = metrics.score_items(items).first()
    assert (r["recall_at_5"], r["recall_at_1"], r["recall_at_3"], r["precision_at_5"], r["mrr"]) == (1.0, 0.0, 0.5, 0.4, 0.333333)
    assert r["ndcg_at_3"] == round(0.5 / (1 + 0.6309297535714574), 6)


def test_bootstrap():
    assert stats.bootstrap_interval([]) == (0.0, 0.0) and stats.bootstrap_interval([0.42]) == (0.42, 0.42)
    lo, hi = stats.bootstrap_interval([0.7] * 9)
    assert abs(lo - 0.7) < 1e-9 and abs(hi - 0.7) < 1e-9
    assert stats.paired_win_rate([0.1, 0.2], [0.5, 0.6]) == 1.0
    with pytest.raises(ValueError):
        stats.paired_win_rate([1.0], [])


def test_seeded_draws_are_those_of_the_generator(spark):
    """Over several blocks, and several sizes at once."""
    for size in (5, 64, 300):
        draw = random.Random(3).randrange
        want = Counter((b, draw(size)) for b in range(40) for _ in range(size))
        rows = draws.read(spark, [5, 64, 300], 40, seed=3, block=1000).where(f"size = {size}").groupBy("b", "place").sum("c").collect()
        assert Counter({(r[0], r[1]): r[2] for r in rows}) == want
    assert draws.read(spark, [], 10).collect() == []
    with pytest.raises(ValueError):
        draws._Reader({"sizes": "[0]"})


def test_bootstrap_of_frames(spark):
    """The intervals and win rates of the frames are those of plain Python, of each set and metric."""
    rng = random.Random(1)
    sets = {("a", "mrr"): [rng.random() for _ in range(37)], ("a", "recall"): [rng.randrange(2) / 1 for _ in range(37)], ("b", "mrr"): [0.42], ("c", "mrr"): [0.7] * 9}
    rows = spark.createDataFrame([(d, m, i, v) for (d, m), vs in sets.items() for i, v in enumerate(vs)], "dataset string, metric string, item_id long, value double")
    got = {(r["dataset"], r["metric"]): (r["lo"], r["hi"]) for r in stats.bootstrap_ci(rows, 200, seed=5).collect()}
    assert got.keys() == sets.keys()
    for key, values in sets.items():
        assert got[key] == pytest.approx(stats.bootstrap_interval(values, 200, seed=5), abs=1e-6)
    base, cand = sets["a", "mrr"], [v + rng.uniform(-0.3, 0.32) for v in sets["a", "mrr"]]
    pairs = spark.createDataFrame([("a", "mrr", i, x, y) for i, (x, y) in enumerate(zip(base, cand, strict=True))], "dataset string, metric string, item_id long, base double, cand double")
    assert stats.paired_bootstrap(pairs, 200, seed=5).first()["p_better"] == stats.paired_win_rate(base, cand, 200, seed=5)
    assert stats.bootstrap_ci(rows.where("false")).collect() == [] and stats.paired_bootstrap(pairs.where("false")).collect() == []


def test_lexical_overlap(spark):
    docs = spark.createDataFrame([(1, "flux capacitor needs plutonium today"), (2, "to be or not to be")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "why flux capacitor needs fuel", 1), (2, "to be or not", 2)], "question_id long, question string, doc_id long")
    assert {r["question_id"]: r["rejected"] for r in synth.lexical_overlap(q, docs).collect()} == {1: True, 2: False}


def test_near_duplicates(spark):
    rows = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [0.99, 0.01]), ("s", 3, [0.0, 1.0])], "set_id string, item_id long, embedding array<double>")
    assert [r["accepted"] for r in synth.near_duplicate_greedy(rows).orderBy("item_id").collect()] == [True, False, True]


def test_greedy_takes_few_turns_on_a_chain(spark, monkeypatch):
    """Vectors each close to the next only, in order: every second one is accepted, in turns that do not grow with the chain."""
    n, written = 600, []
    write = synth.scratch.written
    monkeypatch.setattr(synth.scratch, "written", lambda df, name: (written.append(name), write(df, name))[1])
    step = np.arccos(0.96)
    rows = [("s", i, [float(np.cos(step * i)), float(np.sin(step * i)), 0.02 * i]) for i in range(n)]
    vectors = np.array([r[2] for r in rows])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    links, accepted = np.round(vectors @ vectors.T, 6) >= 0.95, []
    for i in range(n):
        if not any(links[i, j] for j in accepted):
            accepted.append(i)
    for held in (1_000_000, 200):
        monkeypatch.setattr(directions, "FEW", 10)
        monkeypatch.setattr(synth, "HELD", held)
        written.clear()
        out = synth.near_duplicate_greedy(spark.createDataFrame(rows, "set_id string, item_id long, embedding array<double>"))
        assert sorted(r.item_id for r in out.where("accepted").collect()) == accepted
        assert written.count("accepted") <= (6 if held > 1000 else 40)


def test_bm25_looks_at_bounded_parts_of_a_batch(monkeypatch):
    """However many documents a batch has, words are looked at ``TOKENS`` at a time; counts and scores stay."""
    sizes, hits = [], lexical._hits
    monkeypatch.setattr(lexical, "_hits", lambda tokens, words: (sizes.append((len(tokens), len(tokens.flatten()))), hits(tokens, words))[1])
    docs = [["a", "b", "x"][: i % 4] * (1 + 9 * (i == 50)) for i in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array([None if i % 5 == 0 else f"s{i % 2}" for i in range(120)], pa.string()), pa.array(range(120), pa.int64()), pa.array(docs, pa.list_(pa.string()))], names=["source", "doc_id", "tokens"])
    words = pa.array(["a", "b"])
    of = {s: (1.5, {0: 0.7, 1: 0.4}, 60) for s in ("s0", "s1", None)}
    asked = np.array([0, 1, 2]), np.array([0, 0]), np.array([1.0, 1.0])

    def seen(cut: int) -> tuple:
        monkeypatch.setattr(lexical, "TOKENS", cut)
        counted = Counter()
        for out in lexical._counts(words)(iter([batch.slice(3), batch.slice(0, 3)])):
            for r in out.to_pylist():
                counted[r["source"], r["word"]] += r["n"] + 1000 * r["n_words"]
        best_ = [r for out in lexical._best(pa.array([7]), words, asked, of, 5, 1.2, 0.75)(iter([batch])) for r in out.to_pylist()]
        return counted, best_

    whole = seen(10**9)
    sizes.clear()
    assert seen(20) == whole and whole[0]["s0", -1] == 48 + 1000 * sum(len(docs[i]) for i in range(120) if i % 5 and i % 2 == 0)
    assert all(words_ <= 20 or n == 1 for n, words_ in sizes) and len(sizes) > 10


def test_greedy_in_parts_of_several_sets(spark, monkeypatch):
    """Sets that are decided in several parts: what one accepts rejects later items of its own set, and no links are written for these."""
    counted, accepted_of = [], synth._accepted
    monkeypatch.setattr(synth, "AT_FIRST", 24)
    monkeypatch.setattr(synth, "SETS", 2)
    monkeypatch.setattr(synth, "_accepted", lambda *a: (counted.append(1), accepted_of(*a))[1])
    rng = np.random.default_rng(4)
    rows = [(f"s{i % 3}", i // 3, rng.normal(size=6).round(3).tolist()) for i in range(300)] + [("t", 0, [1.0] * 6)]
    want = set()
    for s in ("s0", "s1", "s2", "t"):
        held = []
        for _, i, x in sorted(r for r in rows if r[0] == s):
            x = np.array(x) / np.linalg.norm(x)
            if not any(np.round(x @ y, 6) >= 0.5 for y in held):
                held.append(x)
                want.add((s, i))
    out = synth.near_duplicate_greedy(spark.createDataFrame(rows, "set_id string, item_id long, embedding array<double>"), 0.5)
    assert {(r.set_id, r.item_id) for r in out.where("accepted").collect()} == want and out.count() == 301 and len(counted) > 1


def test_dense_search_of_text_vectors_can_be_written(spark, tmp_path):
    """Vectors that are expressions over a text: what is found can be written, not only collected."""
    docs = dense.with_fake_embeddings(spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id", "text"))
    asked = docs.where("doc_id < 3").select(F.col("doc_id").alias("query_id"), "embedding")
    dense.dense_topk(asked, docs, 1).write.parquet(f"{tmp_path}/found")
    assert {(r.query_id, r.score) for r in spark.read.parquet(f"{tmp_path}/found").collect()} == {(i, 1.0) for i in range(3)}


def test_similarity_join_packs_no_blocks(spark, monkeypatch):
    """Links are counted in tasks, over several blocks and slots; queries are not packed into blocks that a join copies."""
    monkeypatch.setattr(dense, "CELLS", 500)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(260, 5))
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(260)], "doc_id long, embedding array<double>")
    n = dense.link_counts(v.select(F.col("doc_id").alias("query_id"), "embedding"), v.withColumn("source", F.lit("")), 0.6, block=70)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (np.round(unit @ unit.T, 6) >= 0.6).sum(1) - 1
    assert {r.query_id: r.n for r in n.collect()} == {i: int(c) for i, c in enumerate(want) if c}
    assert "FlatMapGroupsInArrow" not in (plan := n._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" in plan


def test_close_pairs_without_meeting_all(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(80, 16))
    x = centres[rng.integers(0, 80, 2500)] + 0.12 * rng.normal(size=(2500, 16))
    x[5] = 0
    v = spark.createDataFrame([("a", i, x[i].tolist()) for i in range(2500)], "source string, doc_id long, embedding array<double>")
    for threshold, share in ((0.95, 0.3), (0.2, 1.0)):
        found = directions.close(v, threshold, few=100)
        want = dense.similar(v.select(F.col("doc_id").alias("query_id"), "embedding"), v, threshold)
        assert found.compared <= share * found.all_pairs
        assert found.links.count() == want.count() == found.links.select("query_id", "doc_id").intersect(want.select("query_id", "doc_id")).count()


def test_review(spark):
    items = spark.createDataFrame([(str(i), "q", [f"https://x/s{i % 2}/p"] if i else [], None if i < 4 else "yes", None) for i in range(5)], "item_id string, question string, gold_urls array<string>, verified string, verified_at string")
    open_ = review.to_review(items, 5).orderBy("place").collect()
    assert {r.item_id for r in open_} == {"0", "1", "2", "3"} and open_[0].item_id == "0"  # _root comes before s0 and s1
    shown = []
    entries = list(review.journalled(open_, iter(["y", "?", "e  better ", "q", "n"]), review.review_entry, shown.append))
    assert [(e["item_id"], e["decision"], e.get("edited_question")) for e in entries] == [(open_[0].item_id, "y", None), (open_[2].item_id, "e", "better")] and len(shown) == 4
    assert list(review.journalled(open_, iter([]), review.review_entry, shown.append)) == []
    assert [review.review_entry(x) for x in ("e", "x", "y no", "")] == [None] * 4 and review.label_entry(" , ") is None
    journal = [{**e, "raw": None, "edited_question": e.get("edited_question")} for e in entries] + [{"item_id": "3", "kind": "label", "decision": None, "edited_question": None, "raw": raw, "decided_at": at} for raw, at in ((" a, b ,", "2"), ("N", "1"))]
    done = {r.item_id: r for r in review.from_journal(items, spark.createDataFrame(journal, review.JOURNAL)).collect()}
    assert done[entries[0]["item_id"]].verified == "yes" and done[entries[1]["item_id"]].question == "better" and done[entries[1]["item_id"]].verified == "edited"
    assert done["3"].gold_urls == ["a", "b"] and done["3"].verified == "yes" and done["4"].verified == "yes"
    for kind, raw, letter in (("review", None, "x"), ("review", None, "e"), ("label", " , ", None)):
        bad = spark.createDataFrame([("1", kind, letter, None, raw, "1")], review.JOURNAL)
        with pytest.raises(Exception, match="cannot apply|expected URLs"):
            review.from_journal(items, bad).collect()


def test_gate(spark):
    limits = spark.createDataFrame([("a", 0.5, 0.02), ("b", 0.5, 0.02), ("c", 0.5, 0.02), ("d", 0.5, 0.02), ("e", 0.5, 0.02)], "metric string, floor double, tolerance double")
    values = spark.createDataFrame([("b", 0.4), ("c", 0.6), ("d", 0.7), ("e", 0.6)], "metric string, value double")
    base = spark.createDataFrame([("c", 0.7), ("d", 0.6)], "metric string, value double")
    out = runs.gate(limits, values, base)
    assert {r["metric"]: (r["verdict"], r["note"]) for r in out.collect()} == {"a": ("FAIL", "missing"), "b": ("FAIL", "floor"), "c": ("FAIL", "regressed"), "d": ("WARN", "improved"), "e": ("PASS", "no baseline")}
    assert runs.gate_verdict(out).first()["verdict"] == "FAIL"


def test_best_rows_of_a_slot_hold_few_scores():
    """What a task of a dense search holds beside its queries does not grow with its vectors, and is a part of what links may hold; the rows are those of all scores at once."""
    rng = np.random.default_rng(11)
    q, v = rng.normal(size=(2048, 16)), rng.normal(size=(12_000, 16))

    def part(kind, ids, x):
        n = len(ids)
        same = pa.array(np.zeros(n, np.int32))
        columns = [same, same, same, pa.array(np.full(n, kind, np.int32)), pa.array(ids), pa.array(["all"] * n), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 16, dtype=np.int32)), pa.array(x.ravel()))]
        return pa.RecordBatch.from_arrays(columns, names=["cell", "block", "salt", "kind", "id", "source", "embedding"])

    class Met:
        def mapInArrow(self, run, _):  # noqa: N802
            return run

    run, peaks = dense.best_of(Met(), 3), []
    for n in (12_000, 6000):
        batches = [part(0, np.arange(2048), q), *(part(1, np.arange(i, i + 3000), v[i : i + 3000]) for i in range(0, n, 3000))]
        tracemalloc.start()
        found = pa.Table.from_batches(list(run(iter(batches))))
        peaks.append(tracemalloc.get_traced_memory()[1] / 2**20)
        tracemalloc.stop()
    assert max(peaks) < 25 and peaks[0] < 1.2 * peaks[1]
    score = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v[:6000] / np.linalg.norm(v[:6000], axis=1, keepdims=True)).T, 6)
    order = np.argsort(-score, axis=1, kind="stable")[:, :3]
    assert sorted(zip(found["query_id"].to_pylist(), found["doc_id"].to_pylist(), strict=True)) == sorted((i, int(j)) for i in range(2048) for j in order[i])


def test_stated_rows_need_no_python_workers(spark):
    """The rows that a query states are in its plan; an RDD of tuples has Python workers of its own on the executors."""
    for name in ("gate", "leaderboard", "compare_runs"):
        assert "LogicalRDD" not in registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("name: base\nretrieval:\n  top_k: 5\n  bm25: { enabled: false, k1: 1.5 }\neval:\n  k_values: [1, 5]\n  thresholds:\n    mrr: { min: 0.5 }\n")
    (tmp_path / "top.yaml").write_text("extends: base.yaml\nname: top  # a note\nretrieval:\n  bm25:\n    enabled: true\n")
    cfg = config.load(tmp_path / "top.yaml", ["retrieval.top_k=7", "eval.self_retrieval=none"])
    assert (cfg.name, cfg.retrieval.top_k, cfg.retrieval.bm25.enabled, cfg.retrieval.bm25.k1, cfg.eval.k_values, cfg.eval.thresholds["mrr"].min) == ("top", 7, True, 1.5, [1, 5], 0.5)
    with pytest.raises(ValueError):
        config.load(tmp_path / "top.yaml", ["retrieval.topk=7"])
    (tmp_path / "a.yaml").write_text("extends: b.yaml\n")
    (tmp_path / "b.yaml").write_text("extends: a.yaml\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "a.yaml")
    other = config.load(tmp_path / "top.yaml", ["generation.llm.model=z", "retrieval.top_k=7", "eval.self_retrieval=none"])
    assert config.split_hashes(cfg)[0] == config.split_hashes(other)[0] and config.split_hashes(cfg)[1] != config.split_hashes(other)[1]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, name):
    """Spark and DuckDB give the same rows."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda it: sorted((tuple(r) for r in it), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
