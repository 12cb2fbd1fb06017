"""The ten operators against plain Python, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, exact_dedup, line_dedup, mixing, near_dedup, packing, quality_crf, quality_rules, registry, secrets, token_counts, token_files, tokens

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, score double, kept boolean, size int"


def table(spark, rows):
    """Rows of (doc_id, text, source) with columns whose names clash with results."""
    return spark.createDataFrame([(*r, 0.5, True, 1) for r in rows], SCHEMA).repartition(3)


LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
ODD = [(1, None, "a"), (2, "", None), (3, "Same Text here", "a"), (4, "same text HERE", "b"), (4, "same text HERE", "b"), (5, LONG, "b"), (6, LONG.upper(), "c"), (None, "no id", "a"), (7, "é É ß 中文 \n\n\t x", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, ODD).where("false")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for table_ in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table_} AS SELECT * FROM '{SF}/{table_}.parquet'")
    want, got = con.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.project(", ".join(columns)).fetchall())


def test_empty_tables(spark, none):
    assert near_dedup.near_duplicates(none).count() == 0
    assert line_dedup.dedup(none).count() == 0
    assert quality_rules.judge(quality_rules.measure(none)).count() == 0
    assert exact_dedup.dedup(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert secrets.scan(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_crf.train(none, labels)
    assert quality_crf.score(none, model, "q").count() == 0
    assert quality_crf.score(table(spark, ODD), model, "q").where("abs(q - 0.5) > 1e-9").count() == 0


def shingles(text, n):
    w = re.findall(SPACE, (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(rows[i][0], len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i in range(len(rows))]


@pytest.mark.parametrize("block", [3, 1000])
def test_near_dedup(spark, monkeypatch, block):
    """A group of many edited copies, of which some link only by others, and the odd rows."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = [(r[0], r[1]) for r in ODD]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, "one two three"), (201, "One TWO three"), (202, "a b c d e"), (203, "a b c d f")]
    got = near_dedup.near_duplicates(table(spark, [(*r, "s") for r in rows]), size=4)
    assert sorted(map(repr, got.select("doc_id", "n_shingles", "component_id").rdd.map(tuple).collect())) == sorted(map(repr, brute_components(rows, 4)))


def test_sketch_estimate():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 4000, dtype=np.uint64), rng.integers(0, 2**63, 1000, dtype=np.uint64)
    x, y = np.unique(a), np.unique(np.concatenate([a[:3000], b]))
    j, _ = near_dedup.estimate(near_dedup.registers(x)[None], near_dedup.registers(y)[None], np.array([4000.0]), np.array([4000.0]))
    assert abs(j[0] - 0.6) < 0.12


def brute_lines(rows):
    """Per row: the text that stays, its lines before and the lines that went."""
    lines = [((d if d is not None else -(2**63)), (t or "").split("\n")) for d, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where = defaultdict(set)
    for d, ls in lines:
        for line in ls:
            if len(key(line)) >= 20:
                where[key(line)].add(d)
    gone = lambda d, line: len(where.get(key(line), ())) >= 3 and d != max(where[key(line)])
    return [("\n".join(line for line in ls if not gone(d, line)), len(ls), sum(gone(d, line) for line in ls)) for d, ls in lines]


def test_line_dedup_brute(spark):
    """Nulls, repeats of one doc_id, ties, a long text of frequent lines; columns with clashing names stay as they are."""
    rng = random.Random(3)
    pool = [f"line number {i} that is Long enough é" for i in range(40)] + ["short", "", "  "]
    rows = [(r[0], r[1]) for r in ODD]
    rows += [(rng.choice([None, *range(50, 80)]), "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t", "\r"]) for _ in range(rng.randrange(8)))) for _ in range(120)]
    rows += [(300, "\n".join(rng.choice(pool).upper() for _ in range(30_000))), (301, "\n".join(rng.choice(pool) for _ in range(30_000)))]
    rows += rows[-3:]
    clash = spark.createDataFrame([(d, t, 1, "x", 2.5, True) for d, t in rows], "doc_id long, text string, n_lines int, line_dedup string, lost double, k boolean").repartition(3)
    out = line_dedup.dedup(clash)
    assert out.columns == [*clash.columns, "line_dedup_"]
    got = [(r["doc_id"], r["text"], r["line_dedup_"].n_lines, r["line_dedup_"].n_dropped, r["n_lines"], r["line_dedup"], r["lost"], r["k"]) for r in out.collect()]
    want = [(d, *kept, 1, "x", 2.5, True) for (d, _), kept in zip(rows, brute_lines(rows), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_line_keys_are_independent(spark):
    """The second hash is no function of the first."""
    import xxhash

    row = spark.createDataFrame([(1, "a line that is long enough to count")], "doc_id long, text string").select(F.explode(line_dedup._keys(F.col("text"))).alias("k")).select("k.*").first()
    assert row.h2 != xxhash.xxh64_intdigest(b"second", row.h1 % 2**64) - 2**64 * (xxhash.xxh64_intdigest(b"second", row.h1 % 2**64) >= 2**63)


def test_line_dedup_long_texts(spark):
    """Texts of 100,000 lines, shared and own: the work of a text grows with its lines."""
    lines = [f"a line of a very long text, {i * 7919 % 100_003}" for i in range(100_000)]
    rows = [(d, "\n".join([*lines[d * 1000 :], f"the last line of text {d}"])) for d in range(3)]
    got = [(r["doc_id"], r["text"], r["line_dedup"].n_lines, r["line_dedup"].n_dropped) for r in line_dedup.dedup(table(spark, [(*r, "s") for r in rows])).collect()]
    assert sorted(got) == sorted((d, *kept) for (d, _), kept in zip(rows, brute_lines(rows), strict=True))


def test_line_dedup(spark):
    shared = "A line that many DOCUMENTS share"
    rows = [(1, f"  {shared}\nown one"), (2, f"{shared.lower()}\t\nown two\n"), (3, f"{shared}\n{shared}"), (4, "short\nshort"), (5, None), (6, "")]
    out = {r["doc_id"]: (r["text"], r["line_dedup"].n_lines, r["line_dedup"].n_dropped) for r in line_dedup.dedup(table(spark, [(*r, "s") for r in rows])).collect()}
    assert out == {1: ("own one", 2, 1), 2: ("own two\n", 3, 1), 3: (f"{shared}\n{shared}", 2, 0), 4: ("short\nshort", 2, 0), 5: ("", 1, 0), 6: ("", 1, 0)}


def test_quality_crf_marginals():
    """Forward-backward against the sum over all labellings."""
    rng = np.random.default_rng(0)
    per, good, bond = np.array([3, 1, 4]), rng.normal(size=8), rng.normal(size=(2, 2))
    got, _ = quality_crf.forward_backward(good, bond, per)
    at = 0
    for n in per:
        total, on = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(good[at + i] * y[i] for i in range(n)) + sum(bond[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            on += w * np.array(y)
        assert np.allclose(got[at : at + n], on / total)
        at += n


def slow_score(text, model):
    """A document's score by plain recursions over its lines, with features counted anew."""
    lines = (text or "").encode().split(b"\n")
    x = [quality_crf.line_features([line])[0][0] for line in lines]
    none = np.zeros(quality_crf.FEATURES - 1)
    good = [float(np.concatenate([x[i], x[i - 1][1:] if i else none, x[i + 1][1:] if i + 1 < len(x) else none]) @ model.weights) for i in range(len(x))]
    forward, backward = [[0.0, good[0]]], [[0.0, 0.0]]
    for g in good[1:]:
        forward.append([(g if y else 0) + np.logaddexp(forward[-1][0] + model.bond[0, y], forward[-1][1] + model.bond[1, y]) for y in (0, 1)])
    for g in good[:0:-1]:
        backward.append([np.logaddexp(model.bond[y, 0] + backward[-1][0], model.bond[y, 1] + g + backward[-1][1]) for y in (0, 1)])
    total = weight = 0.0
    for f, b, line in zip(forward, backward[::-1], lines, strict=True):
        n = len(line.decode()) + 1
        total += n / (1 + math.exp(min(500, (f[0] + b[0]) - (f[1] + b[1]))))
        weight += n
    p = min(0.999, max(0.001, total / weight))
    return 1 / (1 + math.exp(-min(30, max(-30, model.slope * math.log(p / (1 - p)) + model.shift))))


def test_quality_crf_brute(spark):
    """The registered query against plain recursions, over whole texts."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = registry.queries()["op3_quality_crf"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - slow_score(texts[r.doc_id], model)) < 1e-6 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_crf_odd(spark, odd, tmp_path):
    """Null doc_ids are not held out, empty texts are one empty line, repeats score alike, extra columns are ignored; a long text in parts."""
    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    rows = registry.queries()["op3_quality_crf"](spark, f"file://{tmp_path}").collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((d for d, _, _ in ODD), key=repr)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    scores = defaultdict(set)
    for r in rows:
        scores[r.doc_id].add(r.score)
    assert scores[1] == scores[2] and len(scores[4]) == 1 and all(0 <= r.score <= 1 for r in rows)


def test_quality_crf_parts(monkeypatch):
    """A long text in parts has the score of the whole, and marginals by odds are those of the recursion; its sample has runs of its lines."""
    rng = random.Random(6)
    text = "\n".join("é word| " * rng.randrange(30) for _ in range(400)).encode()
    for case in range(4):
        draw = np.random.default_rng(case)
        model = quality_crf.Model(draw.normal(size=3 * quality_crf.FEATURES - 2), draw.normal(size=(2, 2)) * (1, 4, 12, 40)[case], 1.0, 0.0)
        x, chars, per_text = quality_crf.line_features([text])
        marginal, _ = quality_crf.forward_backward(model.line_scores(x, per_text), model.bond, per_text)
        want = 1 / (1 + math.exp(-quality_crf._logit((marginal * (chars + 1)).sum() / (chars + 1).sum())))
        many = [text[i : i + 700] for i in range(0, len(text), 700)]
        for size in (7, 100, 5000, 1 << 20):
            monkeypatch.setattr(quality_crf, "PART_BYTES", size)
            for most in (1, 1 << 20):
                monkeypatch.setattr(quality_crf, "BATCH_BYTES", most)
                assert abs(model.scores([memoryview(text)])[0] - want) < 1e-9
        assert np.allclose(model.scores(many), [model.scores([t])[0] for t in many], atol=1e-9)
    for size in (50, 1 << 18):
        monkeypatch.setattr(quality_crf, "PART_BYTES", size)
        monkeypatch.setattr(quality_crf, "RUN", 30)
        x, chars = quality_crf.sample_features(memoryview(text))
        assert np.allclose(x, quality_crf.line_features([text])[0]) and len(chars) == 400
        monkeypatch.setattr(quality_crf, "RUN", 10)
        x, chars = quality_crf.sample_features(memoryview(text))
        whole = quality_crf.line_features([text])[0]
        assert len(x) == 160 and sum(any(np.array_equal(a, whole[i : i + 10]) for i in range(0, 400, 10)) for a in np.split(x, 16)) == 16


def test_quality_crf_of_line_ends():
    """A text of very many short lines takes memory for a part at a time."""
    rng = np.random.default_rng(1)
    model = quality_crf.Model(rng.normal(size=3 * quality_crf.FEATURES - 2), rng.normal(size=(2, 2)), 1.0, 0.0)
    text = b"\n" * (8 << 20)
    tracemalloc.start()
    score = model.scores([memoryview(text)])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < score < 1 and most < 150 << 20


def test_quality_crf_sample_of_repeated_rows(spark):
    """Rows that repeat a sampled doc_id come to the driver once."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    rows = [(i, ("clean river stone.\n" if i % 2 else "BUY ## | 777\n") * 5) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = quality_crf.train(docs, labels)
    many = quality_crf.train(docs.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n"), labels)
    assert np.array_equal(one.weights, many.weights) and one.slope == many.slope


def test_quality_crf_long_documents(spark):
    """Junk after 160 clean lines of a labelled document is learnt."""
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice(("river", "stone", "light", "paper", "green", "quiet")) for _ in range(9)) + "."
    junk = lambda: "$$ " + " ".join(rng.choice(("BUY", "WIN", "##", "!!!", "| |", "777")) for _ in range(9))
    rows = [(i, "\n".join([clean() for _ in range(160)] + [(junk if i % 2 else clean)() for _ in range(160)]), "a") for i in range(16)]
    docs, labels = table(spark, rows), spark.createDataFrame([(i, 1 - i % 2) for i in range(16)], "doc_id long, quality int")
    model = quality_crf.train(docs, labels)
    scores = {r.doc_id: r.s for r in quality_crf.score(docs, model, "s").select("doc_id", "s").collect()}
    assert max(scores[i] for i in scores if i % 2) < 0.3 and min(scores[i] for i in scores if not i % 2) > 0.7


def test_quality_crf_groups(monkeypatch):
    """Groups of documents give the same fit as all together."""
    rng = random.Random(5)
    line = lambda words: " ".join(rng.choice(words) for _ in range(rng.randrange(4, 12)))
    texts = ["\n".join([line(("river", "stone", "light.")) for _ in range(20 + i)] + [line(("BUY", "##", "| |", "777")) if i % 3 == 0 else line(("paper", "green.")) for _ in range(20)]).encode() for i in range(16)]
    x, chars, per_text = quality_crf.line_features(texts)
    quality = np.array([float(i % 3 > 0) for i in range(16)])
    one = quality_crf.fit(x, chars, per_text, quality)
    monkeypatch.setattr(quality_crf, "GROUP_LINES", 100)
    many = quality_crf.fit(x, chars, per_text, quality)
    assert len(list(quality_crf._groups(x, chars, per_text, quality))) > 5
    assert np.allclose(one.weights, many.weights, atol=1e-5) and np.allclose(one.bond, many.bond, atol=1e-5) and np.allclose([one.slope, one.shift], [many.slope, many.shift], atol=1e-5)


def test_quality_crf_held_out(spark):
    out = registry.queries()["op3_quality_crf"](spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").df()
    both = out[out.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95 and out.score.between(0, 1).all()
    assert all(bool(h) == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(out.doc_id, out.held_out, strict=True))


def test_quality_rules_brute(odd):
    for r in quality_rules.judge(quality_rules.measure(odd)).collect():
        texts = {t or "" for d, t, _ in ODD if d == r["doc_id"]}
        w = re.findall(SPACE, texts.pop())
        windows = defaultdict(list)
        for i in range(len(w) - 2):
            windows[tuple(w[i : i + 3])].append(i)
        repeated = {p + k for ps in windows.values() if len(ps) > 1 for p in ps for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(repeated))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))


@pytest.mark.parametrize(("huge", "weak"), [(8 << 20, None), (64, None), (8 << 20, 2), (64, 3)])
def test_exact_dedup(odd, huge, weak):
    """Whole and dealt out in parts; with fingerprints so weak that most collide."""
    got = exact_dedup.dedup(odd, huge=huge, chunk=50, weak=weak).collect()
    groups = defaultdict(list)
    for d, t, _ in ODD:
        groups[(t or "").translate(LOWER)].append(d)
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == len(groups)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r["text_sha256"] == sha]
        assert len(own) == len(ids) and {r["group_size"] for r in own} == {len(ids)}
        assert {r["keep_id"] for r in own} == {max((i for i in ids if i is not None), default=None)}
        assert [r["doc_id"] for r in own if r["kept"]] == [own[0]["keep_id"]]


def test_exact_dedup_repeated_rows(spark, monkeypatch):
    """Many repeats of one null doc_id and of one text, dealt out to many tasks."""
    monkeypatch.setattr(exact_dedup, "TOGETHER", 5)
    rows = [(None, "Twice", "a")] * 60 + [(1, "twice", "a")] * 40 + [(2, "b" * 500, "a"), (3, "B" * 500, "b"), (3, "b" * 499 + "c", "b")]
    got = exact_dedup.dedup(table(spark, rows), huge=100, chunk=64, weak=5).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 1, 100, False)] * 60 + [(1, 1, 100, False)] * 39 + [(1, 1, 100, True), (2, 3, 2, False), (3, 3, 2, True), (3, 3, 1, True)], key=repr)


def test_fingerprints_compose():
    text = bytes(random.Random(1).randrange(256) for _ in range(300_000))
    for k, (p, b) in enumerate(zip(exact_dedup.PRIMES, exact_dedup.BASES, strict=True)):
        h = 0
        for c in text:
            h = (h * b + c + 1) % p
        assert exact_dedup.fingerprints([text])[k][0] == h


@pytest.mark.parametrize("size", [tokens.SLICE, 1, 4])
@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder(monkeypatch, name, kind, size):
    monkeypatch.setattr(tokens, "SLICE", size)
    encoder, rng = tokens.Encoder(tokens.tokenizer_path(name), kind, keep=200), random.Random(5)
    letters = [*"aAé é\t\n\r\x0b\x1c\x85\xa0 'sdlt12!?.,ßİΣσ中😀\x01", "<|endoftext|>", "'s", "  ", " \n\n ", "the", " word"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 14)))
        assert encoder.encode(text) == encoder.whole(text), repr(text)


LONG_TEXT = """
import resource, sys
from quarry.llm import token_counts, tokens
text = "".join(f"w{i} and more " for i in range(5000)) * 500
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
{make}
before = peak()
run(text)
print(len(text) >> 20, peak() - before)
"""


@pytest.mark.parametrize("make", ["run = tokens.Encoder(tokens.tokenizer_path('byte_bpe_50k.json'), 'byte').encode", "run = tokens.Encoder(tokens.tokenizer_path('word_bpe_49k.json'), 'word').encode", "run = token_counts.Counter(token_counts.read_vocabulary(tokens.tokenizer_path('piece_bpe_32k.model'))).count"])
def test_long_text_in_slices(make):
    """What a long text needs beside itself and its ids (here twice, 4 bytes each) stays small."""
    out = subprocess.run([sys.executable, "-c", LONG_TEXT.replace("{make}", make)], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()
    assert float(out[1]) < 200 and int(out[0]) > 30


def test_codes():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, m, 3000) for m in (200, 60_000, 2**31)]).astype(np.uint32)
    s = token_files.Segment(token_files.pack(ids))
    assert len(s) == len(ids) and (s.run(0, len(ids)) == ids).all()
    for i in rng.integers(0, len(ids), 300).tolist():
        j = min(len(ids), i + int(rng.integers(0, 700)))
        assert s.token(i) == ids[i] and (s.run(i, j) == ids[i:j]).all()
    assert len(token_files.Segment(token_files.pack(ids[:0]))) == 0


def test_crc32_joined():
    rng = random.Random(3)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(rng.randrange(5000))
        assert token_files.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files_cut(spark, tmp_path):
    """Texts longer than a segment go on in the next one; many rows of one doc_id are several shards."""
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    texts = ["one two " * 70_000, "short", "three " * 200_000, ""]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, f"none {i % 7}", "s") for i in range(200)]
    token_files.write(table(spark, rows), f"file://{tmp_path}/ids", path, shards=5)
    stored = spark.read.parquet(f"file://{tmp_path}/ids")
    assert stored.agg(F.max("n_tokens")).first()[0] <= 2 * token_files.SEGMENT_TOKENS and stored.where("goes_on").count() >= 4
    assert stored.select("shard").distinct().count() > 2
    got = sorted(map(tuple, token_files.read(spark, f"file://{tmp_path}/ids").collect()), key=lambda r: r[1])
    encoder, at = tokens.Encoder(path, "byte"), 0
    raws = {d: encoder.whole(t) + b"\x02\0\0\0" for d, t, _ in rows if d is not None}
    assert [r[0] for r in got] == [None] * 200 + [0, 1, 2, 3]
    for d, start, n, crc in got:
        assert start == at and (d is None or (n, crc) == (len(raws[d]) // 4, zlib.crc32(raws[d])))
        at += n
    none_crcs = sorted(zlib.crc32(encoder.whole(f"none {i % 7}") + b"\x02\0\0\0") for i in range(200))
    assert sorted(r[3] for r in got[:200]) == none_crcs


def test_token_files(spark, odd, none, tmp_path):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    token_files.write(odd, f"file://{tmp_path}/ids", path, shards=3)
    got = sorted(map(tuple, token_files.read(spark, f"file://{tmp_path}/ids").collect()), key=lambda r: r[1])
    encoder, at = tokens.Encoder(path, "byte"), 0
    for row, (d, t) in zip(got, sorted(((d, t or "") for d, t, _ in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), strict=True):
        raw = encoder.whole(t) + b"\x02\0\0\0"
        assert row == (d, at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    token_files.write(none, f"file://{tmp_path}/none", path)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.choice([1, 7, 30, 33, 50, 51, 64]), i) for i in range(3000)]
    rows += rows[:5]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), capacity=64, per_part=300).toPandas()
    assert len(out) == len(rows) and (out.groupby("sequence_id").length.sum() <= 64).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert out.sequence_id.nunique() <= 1.03 * packing.lower_bound(np.array([r[3] for r in rows]), 64)
    assert set(out.bins) == {out.sequence_id.nunique()} and set(out.bound) == {packing.lower_bound(np.array([r[3] for r in rows]), 64)}
    assert (out.part_bins >= out.part_bound).all()


def test_packing_exchange(spark):
    """Halves that fit each other alone: partitions that have too many of one kind exchange them until the bound is met."""
    rng = random.Random(5)
    rows = [(i, 0, 0, 2500 if i % 2 else 1596, i) for i in range(4000)]
    rng.shuffle(rows)
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), per_part=200).toPandas()
    assert sorted(out.doc_id) == list(range(4000)) and out.sequence_id.nunique() == 2000 == out.bound.iloc[0] == out.bins.iloc[0]
    assert (out.groupby("sequence_id").length.sum() == 4096).all()


def test_packing_bounds():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = np.sort(rng.integers(1, 65, rng.integers(1, 40)))[::-1]
        assert packing.lower_bound(sizes, 64) <= packing.best_fit_decreasing(sizes, 64).max() + 1
    assert packing.lower_bound(np.array([40] * 10), 64) == 10


def test_packing_odd(odd, none):
    """Ids, cuts and starts against the library; nulls, repeats, and texts of many pieces."""
    encoder = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json"), "word")
    want = []
    for d, t, _ in ODD:
        ids = [*encoder.library.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, i, 64 * i, len(ids[64 * i : 64 * i + 64]), zlib.crc32(np.array(ids[64 * i : 64 * i + 64], "<u4").tobytes())) for i in range(-(-len(ids) // 64))]
    out = packing.pack_documents(odd, capacity=64)
    rows = out.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    place = defaultdict(list)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
    for p in place.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 64
    assert len(place) == rows[0].bins >= rows[0].bound
    assert packing.pack_documents(none).count() == 0


def test_mixing_targets():
    out = mixing.targets({"a": 100, "b": 100, None: 100, "c": 10})
    assert abs(out["a"] - 445 * 5 / 12) < 1e-9 and out["c"] == 20 and abs(sum(out.values()) - 465) < 1e-9 and all(out[k] <= 2 * v for k, v in {"a": 100, "b": 100, None: 100, "c": 10}.items())


def brute_targets(rows):
    """Size and target of each source, by water filling in small steps of its own."""
    size = defaultdict(int)
    for _, t, source in rows:
        size[source] += len(re.findall(SPACE, t or ""))
    names = sorted((n for n in size if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in size)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    full: set = set()
    while True:
        free = [n for n in names if n not in full]
        left = 1.5 * sum(size.values()) - sum(2 * size[n] for n in full)
        goal = {n: 2.0 * size[n] if n in full else left * weight[n] / sum(weight[m] for m in free) for n in names}
        more = {n for n in free if goal[n] > 2 * size[n]}
        if not more:
            return size, goal
        full |= more


def test_mixing(spark, odd):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["x", "x", "x", "y", "z", None])) for i in range(6000)]
    rows += [(9000, "one more w " * 5, "c")] * 100 + [(9001, None, "empty"), (9002, "", "empty"), (None, "w", "x")]
    docs = spark.createDataFrame([(*r, 7, "l", 0.5, True, -1, "h", 3, 4) for r in rows], "doc_id long, text string, source string, size int, level string, target double, h boolean, copies int, mix string, times int, threshold int").repartition(3)
    size, goal = brute_targets(rows)
    a, b = (sorted(map(tuple, mixing.mix(d).select("doc_id", "text", "source", "size", "level", "target", "h", "copies", "mix", "times", "threshold", "mix_.size", "mix_.source_size", "mix_.target", "mix_.copies").collect()), key=repr) for d in (docs, docs.repartition(5)))
    assert a == b and sorted((r[:11] for r in a), key=repr) == sorted(((*r, 7, "l", 0.5, True, -1, "h", 3, 4) for r in rows), key=repr)
    taken = defaultdict(int)
    for r in a:
        n, source_size, target, copies = r[11:]
        assert n == len(re.findall(SPACE, r[1] or "")) and source_size == size[r[2]] and abs(target - goal[r[2]]) < 1e-6 and copies in (0, 1, 2)
        taken[r[2]] += n * copies
    assert all(-40 <= taken[s] - goal[s] <= 0.001 for s in size)
    assert taken["c"] == 2 * size["c"]
    got = mixing.mix(odd).collect()
    want_size, want_goal = brute_targets(ODD)
    assert sorted(((r["doc_id"], r["text"], r["source"], r["mix"].size) for r in got), key=repr) == sorted(((d, t, s, len(re.findall(SPACE, t or ""))) for d, t, s in ODD), key=repr)
    assert all(r["mix"].source_size == want_size[r["source"]] and abs(r["mix"].target - want_goal[r["source"]]) < 1e-6 for r in got)


def test_mixing_repeated_rows(spark):
    """A source of one row, repeated, is taken as far as its target goes."""
    rows = [(1, "a few words that are said again and again now", "c")] * 100 + [(i, "w " * 100, "a") for i in range(40)] + [(i, "w " * 100, "b") for i in range(40)]
    size, goal = brute_targets(rows)
    got = mixing.mix(table(spark, rows)).where("source = 'c'").select("mix.*").collect()
    assert size["c"] == 1000 and goal["c"] < 2000
    assert abs(sum(r["size"] * r.copies for r in got) - goal["c"]) <= 10


def in_hash_order(rows):
    """Words still missing when documents of (hash, size) are taken in order of their hashes wherever they fit, and the hashes."""
    total = sum(n for _, n in rows)
    left, taken = int(1.5 * total) - total, []
    sums = defaultdict(int)
    for h, n in rows:
        sums[h] += n
    for h in sorted(sums):
        if left >= 1 and sums[h] <= left:
            left -= sums[h]
            taken.append(h)
    return left, set(taken)


@pytest.mark.parametrize("driver", [True, False])
def test_mixing_large_document(spark, monkeypatch, driver):
    """A document of half a source stands at the boundary; short ones behind it fill its place."""
    if not driver:
        monkeypatch.setattr(mixing, "SENT", 0)
        monkeypatch.setattr(mixing, "FEW", 3)
    rng = random.Random(8)
    rows = [(1000 * s + i, "w " * rng.randrange(20, 61), f"s{s}") for s in range(3) for i in range(500)]
    rows += [(1000 * s + 999, "w " * sum(t.count("w") for _, t, x in rows if x == f"s{s}"), f"s{s}") for s in range(3)]
    rows += [(None, "w " * 30, "s0")] * 5
    missing = []
    for s in range(3):  # one source a table: the target is one and a half times its words
        docs = table(spark, [r for r in rows if r[2] == f"s{s}"])
        mixed = mixing.mix(docs).select("doc_id", "mix.*", F.expr("xxhash64('mix', doc_id, text) & 9223372036854775807").alias("h"))
        # repeated rows have hashes of their own: which of them is which does not show
        ties = [r[0] for r in spark.range(5).select(F.expr("IF(id = 0, xxhash64('mix', CAST(null AS LONG), repeat('w ', 30)), xxhash64('tie', xxhash64('mix', CAST(null AS LONG), repeat('w ', 30)), id)) & 9223372036854775807")).collect()]
        got = [(r.h, r["size"], r.copies, r.target) for r in mixed.where("doc_id is not null").collect()]
        again = sorted((r.copies for r in mixed.where("doc_id is null").collect()), reverse=True)
        left, taken = in_hash_order([r[:2] for r in got] + [(h, 30) for h in ties[: len(again)]])
        missing.append((got[0][3] - sum(n * k for _, n, k, _ in got) - 30 * sum(again)) / got[0][3])
        assert {h for h, _, k, _ in got if k == 2} == taken - set(ties) and {k for _, _, k, _ in got} <= {1, 2}
        assert sum(k == 2 for k in again) == len(taken & set(ties))
    assert max(missing) < 0.001


KEYS = ("password", "passwd", "secret", "token", "api_key", "APIKEY")
ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_key", "apikey")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


@pytest.mark.parametrize("block", [secrets.BLOCK, 2])
def test_secrets(spark, monkeypatch, odd, block):
    monkeypatch.setattr(secrets, "BLOCK", block)
    rng, rows = random.Random(7), []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(6)):
            parts.append(rng.choice([rng.choice(KEYS) + rng.choice(["=", ": ", '" : "', " "]) + "".join(rng.choices("abcDEF019+/_.=-", k=rng.randrange(1, 9))), "AKIA" + "".join(rng.choices("ABC019", k=rng.randrange(12, 20))), "".join(rng.choices("0123456789abcdef", k=rng.randrange(20, 30))), "wörter 中文", "secret=token: abcdefgh"]))
        rows.append((i, rng.choice(["", " ", "x\n"]).join(parts), "s"))
    for r in secrets.scan(table(spark, rows)).collect():
        want = base_spans(rows[r["doc_id"]][1])
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    assert secrets.scan(odd).where("spans <> ''").count() == 0


def brute_random(text, base):
    """Starts and ends of the runs that the battery and the step-up let through, in plain Python."""
    share = {x.split()[0]: float(x.split()[1]) / 1000 for x in secrets.LETTERS.split(", ")}
    tail = lambda z: 1 / (1 + math.exp(min(700, max(-700, 1.5976 * z + 0.07056 * z**3))))
    runs = [(m.start(), m.end(), m[0].rstrip("=")) for m in re.finditer(secrets.RUN, text)]
    ranked = []
    for a, b, body in runs:
        if not re.search("[A-Za-z]", body) or any(s < b and a < e for s, _, e in base):
            continue
        alphabet = next(letters for pattern, letters in secrets.ENCODINGS if re.fullmatch(pattern, body))
        k, n, codes = len(alphabet), len(body), [alphabet.index(c) for c in body]
        odds = sum(math.log(k * share.get(c.lower() if body == body.upper() else c, secrets.SIGN_SHARE)) for c in body)
        cells = max(2, min(8, n // 5))
        size = Counter(c * cells // k for c in range(k))
        seen = Counter(c * cells // k for c in codes)
        chi, df = sum((seen[j] - n * size[j] / k) ** 2 / (n * size[j] / k) for j in range(cells)), cells - 1
        high = [2 * c >= k for c in codes]
        expected = 1 + 2 * sum(high) * (n - sum(high)) / n
        z_runs = abs(1 + sum(x != y for x, y in itertools.pairwise(high)) - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
        mean = sum(codes) / n
        serial = sum((x - mean) * (y - mean) for x, y in itertools.pairwise(codes)) / max(sum((c - mean) ** 2 for c in codes), 1e-9)
        p = min(1, 3 * min(tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))), 2 * tail(z_runs), 2 * tail(abs(serial + 1 / n) * math.sqrt(n))))
        if odds <= math.log(secrets.RATE) and p >= secrets.LEVEL:
            ranked.append((math.exp(max(odds, -700) - math.log(p)), a, b))
    ranked.sort()
    rank = max((i for i, (p, _, _) in enumerate(ranked, 1) if p <= secrets.RATE * i / len(runs)), default=0)
    return {(a, b) for _, a, b in ranked[:rank]}


@pytest.mark.parametrize("block", [secrets.BLOCK, 2])
def test_random_runs_brute(spark, monkeypatch, block):
    monkeypatch.setattr(secrets, "BLOCK", block)
    rng, rows = random.Random(12), []
    words = ["internationalization", "CharacteristicsOfTheRiver", "src/main/java/org", "donaudampfschifffahrt", "un-deux-trois-quatre", "getUserNameFromDatabase", "2024-01-01T12-30-00", "LAAITIONELLEELLE"]
    letters = ["0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "".join(a for _, a in secrets.ENCODINGS[8:9]), secrets.ENCODINGS[9][1], secrets.ENCODINGS[10][1], "ab", "x9"]
    for i in range(200):
        parts = [rng.choice(words) if rng.random() < 0.5 else "".join(rng.choices(rng.choice(letters), k=rng.randrange(14, 70))) + rng.choice(["", "=", "=="]) for _ in range(rng.randrange(5))]
        rows.append((i, rng.choice([" ", " é, ", "\n"]).join(parts), "s"))
    found = 0
    for r in secrets.scan(table(spark, rows)).collect():
        got = {(int(x[1]), int(x[2])) for x in (y.split(":") for y in r["spans"].split(",") if y) if x[0] == "random"}
        assert got == brute_random(rows[r["doc_id"]][1], base_spans(rows[r["doc_id"]][1])), rows[r["doc_id"]][1]
        found += len(got)
    assert found > 60


def test_secrets_of_a_dump(spark):
    """A text of many spans of two kinds, some over several blocks."""
    rng = random.Random(8)
    text = "\n".join(rng.choice(["%032x", "token=%032x", "AKIA%024X"]) % rng.getrandbits(128) for _ in range(3 * secrets.BLOCK))
    (r,) = secrets.scan(table(spark, [(1, text, "s")])).collect()
    want = base_spans(text)
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
    assert {x for x in r["spans"].split(",") if x.startswith("random")} == {f"random:{a}:{b}" for a, b in brute_random(text, want)}


def test_random_letters_alone(spark):
    """Keys of letters, and short ones, beside long words."""
    rng = random.Random(13)
    mixed = secrets.ENCODINGS[8][1]
    long = [(i, "see " + "".join(rng.choices(mixed, k=32)) + " internationalization", "s") for i in range(50)]
    short = [(100 + i, "see " + "".join(rng.choices(secrets.ENCODINGS[9][1], k=16)), "s") for i in range(50)]
    small = [(200 + i, "see " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=48)), "s") for i in range(50)]
    prose = [(300, "Rindfleischetikettierungsueberwachung donaudampfschifffahrtsgesellschaft anticonstitucionalmente intergouvernementalisation internationalization electroencefalografista", "s")]
    found = Counter(r["doc_id"] // 100 for r in secrets.scan(table(spark, long + short + small + prose)).where("spans like '%random:4:%' or doc_id >= 300 and spans <> ''").collect())
    assert found[0] >= 45 and found[1] >= 40 and found[2] >= 40 and found[3] == 0


def test_random_runs(spark):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "see " + "".join(rng.choices(letters, k=40)) + " here", "s") for i in range(40)]
    rows += [(100, "internationalization-of-characteristics donaudampfschifffahrtsgesellschaft src/main/java/org/example/controllers", "s"), (101, "aaaaaaaaaaaaaaaaaaaa1111111111111111111111", "s"), (102, "4012888888881881401288888888", "s")]
    found = {r["doc_id"] for r in secrets.scan(table(spark, rows)).where("spans like '%random:4:44%'").collect()}
    assert len(found) >= 36
    assert secrets.scan(table(spark, rows)).where("doc_id >= 100 and spans like '%random%'").count() == 0


def test_token_counts(spark, monkeypatch, odd):
    from tokenizers import Tokenizer, models, normalizers

    vocabulary = token_counts.read_vocabulary(tokens.tokenizer_path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary, *((f"<0x{i:02X}>", 0.0) for i in range(256))], 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    counter, rng = token_counts.Counter(vocabulary, keep=100), random.Random(9)
    letters = [*"ab e  \n\t.,'é中😀▁0x4Áſthing", "the", "  "]
    for text in ["".join(rng.choices(letters, k=rng.randint(0, 16))) for _ in range(3000)] + [t or "" for _, t, _ in ODD]:
        n = len(library.encode(text, add_special_tokens=False).ids)
        for size in (token_counts.SLICE, 3):
            monkeypatch.setattr(token_counts, "SLICE", size)
            assert counter.count(text) == n, repr(text)
    assert token_counts.token_counts(odd).count() == len(ODD)


def test_pipeline(spark):
    """Each stage on its predecessor's rows, against plain Python."""
    sf = "/root/testdata/sf0.001"
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, sf), f"test{i}")
        now = docs.toPandas()
        if i < 4:
            assert docs.columns == names
        if i == 1:
            best = before.assign(k=[(t or "").translate(LOWER) for t in before.text]).groupby("k").doc_id.max()
            assert sorted(now.doc_id) == sorted(best)
        if i == 2:
            want = {c for _, _, c in brute_components(list(zip(before.doc_id, before.text, strict=True)), 5)}
            assert set(now.doc_id) == want
        if i == 3:
            assert set(now.doc_id) <= set(before.doc_id) and now.doc_id.value_counts().max() <= 2
        if i == 4:
            assert sorted(now[now.piece == 0].doc_id) == sorted(before.doc_id) and (now.groupby("sequence_id").length.sum() <= 4096).all()
        before = now
    assert len(before) > 0


def test_pipeline_odd(spark):
    """Nulls, repeats, a very long text and clashing names: each stage hands on whole rows, as they came; empty tables go through."""
    rng, sf = random.Random(11), "/root/testdata/sf0.001"
    prose = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400").limit(6).collect()]
    rows = [*((r[0], r[1], r[2]) for r in ODD), *((i, t, rng.choice("ab")) for i, t in enumerate(prose, 50)), (None, prose[0], "a"), (None, prose[0], "a"), (70, prose[1], None), (71, "\n".join(prose * 40), "z")]
    names = "doc_id long, text string, source string, score double, kept boolean, size int, target int, level int, h int, copies int, row int, cluster int, xx int, __score int, mix int, n_lines int"
    first = docs = spark.createDataFrame([(*r, 0.5, False, *range(11)) for r in rows], names).repartition(3)
    before = sorted(map(tuple, docs.collect()), key=repr)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = common.written(stage(spark, docs, sf), f"odd{i}")
        now = sorted(map(tuple, docs.collect()), key=repr)
        assert docs.columns == first.columns and set(now) <= set(before) and now
        if i in (1, 2):
            assert len(set(now)) == len(now)
        before = now
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == len(before)
    docs = first.where("false")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, sf), f"none{i}")
        assert docs.count() == 0
