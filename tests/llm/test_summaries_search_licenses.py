"""Quantile summaries, ranked search and licence scans against plain Python, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import datetime
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, licenses, quantiles, ranked_search, registry

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# quantile summaries


def plain_quantiles(rows, q=20):
    """(stream, grp, batch, i) -> n, target, exact_x, sorted x, of rows (stream, grp, batch, x)."""
    groups = defaultdict(list)
    for stream, grp, batch, x in rows:
        groups[stream, grp, batch].append(x)
        groups[stream, grp, -1].append(x)
    out = {}
    for key, xs in groups.items():
        xs, n = sorted(xs), len(xs)
        for i in range(1, q) if n >= q else ():
            target = -(-i * n // q)
            out[(*key, i)] = n, target, xs[target - 1], xs
    return out


def hold(got, want, budget):
    assert {(r.stream, r.grp, r.batch, r.i) for r in got} == set(want)
    last = {}
    for r in sorted(got, key=lambda r: r.i):
        n, target, exact, xs = want[r.stream, r.grp, r.batch, r.i]
        assert (r.n, r.target, r.exact_x) == (n, target, exact)
        assert (r.n_below, r.n_upto) == (sum(x < r.answer for x in xs), sum(x <= r.answer for x in xs))
        assert r.rank_error == max(0, r.n_below + 1 - target, target - r.n_upto) <= r.error
        assert r.within == (1000 * r.rank_error <= 10 * n)
        assert min(20, len(set(xs))) <= r.points <= min(n, budget)
        assert xs[0] <= r.answer <= xs[-1] and r.answer >= last.get((r.stream, r.grp, r.batch), r.answer)
        last[r.stream, r.grp, r.batch] = r.answer


def shop(path):
    import pyarrow.parquet as pq

    read = lambda name, *c: pq.read_table(f"{path}/{name}.parquet", columns=list(c)).to_pylist()
    once = {r["click_id"]: r for r in read("clicks", "click_id", "client_id", "value")}
    rows = [("value", r["client_id"], r["click_id"], r["value"]) for r in once.values()]
    items = {r["item_id"]: r for r in read("items", "item_id", "brand", "price")}
    rows += [("price", items[r["item_id"]]["brand"], r["vendor_id"], items[r["item_id"]]["price"]) for r in read("sale_lines", "item_id", "vendor_id") if r["item_id"] in items]
    out = []
    for stream, grp, id_, money in rows:
        if grp is not None and money is not None:
            batch = zlib.crc32(str(id_).encode()) % 16
            out.append((stream, str(grp), batch, math.floor(100 * money + 0.5) + 1000 * batch))
    return out


def test_op11_whole_query(spark):
    got = registry.queries()["op11_quantile_summaries"](spark, SF).collect()
    hold(got, plain_quantiles(shop(SF)), 2000)
    assert all(r.within for r in got)


def test_quantiles_with_small_budget_wide_values_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FAN", 16)
    rng = random.Random(3)
    rows = [("s", "hot", rng.randrange(2), rng.choice([int(rng.expovariate(1) * 40_000), rng.randrange(10**9), 7])) for _ in range(30_000)]
    rows += [("s", f"g{i % 50}", i % 3, -(i % 40)) for i in range(4000)] + [("t", "one", 0, 5)] * 500 + [("t", "few", 1, 2)] * 19
    df = spark.createDataFrame([(*r, 1) for r in rows], "stream string, grp string, batch int, x long, c long").repartition(5)
    got = quantiles.summarised(df, budget=200).collect()
    hold(got, plain_quantiles(rows), 200)
    assert any(r.error for r in got) and any(r.rank_error for r in got)


def test_collapse_keeps_weight_heavy_points_and_its_bound():
    rng = np.random.default_rng(5)
    for case in range(60):
        n = int(rng.integers(30, 400))
        x = np.sort(rng.choice(10_000, n, replace=False)).astype(np.int64)
        w = rng.integers(1, 6, n) * np.where(rng.random(n) < 0.05, 500, 1)
        kept, weight, error, _ = quantiles.collapse(x, w, 25, bool(case % 2))
        assert weight.sum() == w.sum() and len(kept) <= 25 and (np.diff(kept) > 0).all() and np.isin(kept, x).all()
        shift = [abs(int(w[x <= v].sum()) - int(weight[kept <= v].sum())) for v in x]
        assert max(shift) <= error


def test_shop_streams_on_odd_rows(spark):
    day = datetime.datetime(2024, 1, 1)
    clicks = spark.createDataFrame(
        [(1, 7, 2.5, day), (1, 7, 2.5, day), (2, None, 1.0, day), (3, 8, None, day), (4, 8, float("nan"), day), (5, 8, 1e300, day), (None, 9, 1.005, day), (-6, 9, -3.337, day)],
        "click_id long, client_id long, value double, x timestamp",
    )
    lines = spark.createDataFrame([(1, 10), (1, 10), (1, None), (2, 5), (None, 5), (9, 5), (3, 5)], "item_id long, vendor_id long")
    items = spark.createDataFrame([(1, "B", 1.0), (1, "B", 1.0), (2, None, 2.0), (3, "", 4.0), (4, "C", 1.0)], "item_id long, brand string, price double")
    batch = lambda i: zlib.crc32(str(i).encode()) % 16 if i is not None else 0
    x = lambda money, i: math.floor(100 * money + 0.5) + 1000 * batch(i)
    got = sorted(map(tuple, quantiles.shop_streams(clicks, lines, items).select("stream", "grp", "batch", "x", "c").collect()))
    want = [("value", "7", batch(1), x(2.5, 1), 1), ("value", "9", batch(None), x(1.005, None), 1), ("value", "9", batch(-6), x(-3.337, -6), 1), ("price", "B", batch(10), x(1.0, 10), 2), ("price", "B", batch(None), x(1.0, None), 1), ("price", "", batch(5), x(4.0, 5), 1)]
    assert got == sorted(want)
    assert quantiles.summarised(quantiles.shop_streams(clicks.where("false"), lines.where("false"), items)).count() == 0


# ranked search

TERM = re.compile(ranked_search.TERM)


def plain_search(docs, queries, k):
    texts = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    sizes = [len(t) for _, t in texts if t]
    n_docs, total = len(sizes), sum(sizes)
    df = Counter(w for _, t in texts for w in set(t))
    terms = defaultdict(set)
    for item, text in queries:
        terms[item] |= set(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, asked in terms.items():
        found = []
        for doc, words in texts:
            tf, m = Counter(words), 100 - 50 + (50 * len(words) * n_docs) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in asked if tf[w])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if no else doc, -score) for rank, (score, no, doc) in enumerate(sorted(found)[:k], 1)]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


@pytest.mark.parametrize("words,docs_", [(3_000_000, 1 << 15), (3000, 90)])
def test_search_equals_plain_scores(spark, monkeypatch, words, docs_):
    monkeypatch.setattr(ranked_search, "SEGMENT_WORDS", words)
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", docs_)
    monkeypatch.setattr(ranked_search, "WAVE", 3)
    monkeypatch.setattr(ranked_search, "WINDOW", 40)
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 300)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "中文", "x1y2"]
    draw = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.02)), 302)] for _ in range(n))
    docs = [(i, draw(rng.randrange(1, 60))) for i in range(700)] + [(i, "tie tie") for i in range(700, 800)]
    docs += [(None, "tie tie"), (5, "W1 w2"), (5, "W1 w2"), (801, None), (802, ""), (803, "—!? ."), (804, draw(40_000))]
    queries = [(i, draw(12)) for i in range(20)] + [(20, "tie W1"), (21, None), (22, "nowhere"), (23, "w1"), (23, "w2 w2"), (None, "tie")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score long").repartition(2)
    q = spark.createDataFrame(queries, "item_id long, text string")
    tables = common.Tables(spark)
    index = ranked_search.build_index(tables, d)
    got = ranked_search.search(tables, index, q, 30).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(key, got)) == sorted(map(key, plain_search(docs, queries, 30)))
    held = {(r.term, r.df) for r in index.postings.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    assert held == {(w.encode(), n) for w, n in Counter(w for _, t in docs for w in set(TERM.findall((t or "").translate(LOWER)))).items()}


def test_search_on_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for docs, queries in ((d.where("false"), d), (d, d.where("false")), (d.withColumn("text", F.lit("...")), d)):
        tables = common.Tables(spark)
        assert ranked_search.search(tables, ranked_search.build_index(tables, docs), queries.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 2**62], np.int64)
    data, size = ranked_search.packed(values)
    assert ranked_search.unpacked(data).tolist() == values.tolist() and size.sum() == len(data)


def test_blocks_below_the_threshold_stay_packed():
    segment = ranked_search._Segment()
    for i in range(4000):
        segment.add(i, b"common rare rare" if i in (100, 200) else b"common word")
    lists = None
    for row in segment.rows(0, 4000, 8002).to_pylist():
        if row["term"] is None:
            lists = ranked_search._Lists(row["heads"], row["data"], 4000, 8002)
        else:
            lists.add({b"common": 0, b"word": 1, b"rare": 2}[row["term"]], row["df"], row["heads"], row["data"])
    lists.close()
    top = ranked_search._Top(2, 1)
    place = np.array([lists.terms[0], lists.terms[2]])
    lists.search(place, np.array([1, 7000]), top)
    lists.search(place, np.array([1, 7000]), top)
    assert top.doc.tolist() == [100, 200] or top.doc.tolist() == [100, 100]
    assert lists.open.sum() < len(lists.open) / 1.5


# licence scans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for i in range(len(words)) for phrase, label in BASE.items() if words[i : i + phrase.count(" ") + 1] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_op13_base_columns_of_the_whole_query(spark):
    docs = {r.doc_id: r.text for r in common.documents(spark, SF).collect()}
    got = registry.queries()["op13_license_scan"](spark, SF).collect()
    assert len(got) == len(docs) and sum(r.n_base for r in got)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score > 0) == (r.labels != "")


def test_phrases_over_slices_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "SLICE", 64)
    rng = random.Random(2)
    parts = ["MIT", "License", "cc", "by", "by-NC", "gnu", "General", "public", "license,", "apache", "\n", "é", "中", "(x)"]
    texts = [None, "", "...", "CC BY CC-BY cc by", "x" * 300 + " mit license"] + [" ".join(rng.choices(parts, k=200)) for _ in range(60)]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(None, "mit license", True), (3, texts[3], True)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels boolean").coalesce(1)).collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [plain_base(t) for _, t, _ in rows]
    assert got[0].labels == "" and got[0].score == 0 and got[-2].doc_id is None
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(
    "text,families,asks",
    [
        ("MIT", {"mit"}, licenses.PERMISSIVE),
        ("MIT OR GPL-2.0-only AND Apache-2.0", {"mit", "gpl", "apache"}, licenses.PERMISSIVE),
        ("(MIT OR GPL-3.0-or-later) AND Apache-2.0 WITH LLVM-exception", {"mit", "gpl", "apache"}, licenses.PERMISSIVE),
        ("MIT AND GPL-2.0+", {"mit", "gpl"}, licenses.COPYLEFT),
        ("GPL-2.0 with Classpath-exception-2.0 */", {"gpl"}, licenses.WEAK),
        ("LGPL-2.1 OR CC-BY-NC-4.0", {"lgpl", "cc-by-nc"}, licenses.WEAK),
        ("MIT OR ( GPL-2.0", {"mit"}, licenses.PERMISSIVE),
        ("mit this file or apache-2.0", {"mit"}, licenses.PERMISSIVE),
        ("MIT AND Foo-1.0", {"mit"}, None),
        ("MIT) OR ISC", {"mit"}, licenses.PERMISSIVE),
    ],
)
def test_expressions(text, families, asks):
    found = licenses.evaluate(text.encode())
    assert (found.families, found.asks) == (families, asks)


def test_no_expressions_and_deep_ones():
    assert [licenses.evaluate(t) for t in (b"", b"or MIT", b"((MIT", b")", b"and and")] == [None] * 5
    assert licenses.evaluate(b"(" * 20_000 + b"MIT" + b")" * 20_000).families == {"mit"}


def test_labels_of_tags_and_notices():
    scan = licenses.scan(b"// SPDX-License-Identifier: GPL-2.0-only OR MIT\nReleased under the MIT License. Licensed under CC BY-NC 4.0.")
    assert scan.labels == {"gpl", "mit", "cc-by", "cc-by-nc", "terms:restricted"} and scan.base_labels == {"mit", "cc-by"} and scan.n_tags == 1
    assert licenses.scan(b"SPDX-License-Identifier: Foo-1.0").labels == set()
    assert licenses.scan(b"mit licenses, an apache licensee").labels == set()
