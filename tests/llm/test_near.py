"""Near dedup: colliding words, slices, clusters whose members link only by others, groups of many edits."""

import random
import resource

import numpy as np
import pytest

from quarry.llm import common, near_dedup
from quarry.llm.components import components
from tests.llm.test_llm import brute_components, table


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_that_collide_under_powers(spark):
    """Thue-Morse words and their complements have equal polynomials modulo 2**64 for every odd base."""
    rows = [(1, thue_morse(1024, "a", "b"), "s"), (2, thue_morse(1024, "b", "a"), "s"), (3, thue_morse(256, "a", "b"), "s"), (4, thue_morse(256, "b", "a"), "s")]
    got = near_dedup.near_duplicates(table(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(1, 5)]


def test_slices(monkeypatch):
    """A text in slices has the set of the whole text, words across slices and long ones too."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcÄé", k=rng.choice([1, 3, 9, 300, 900]))) for _ in range(400)]
    text = "".join(w + rng.choice([" ", "\n", " \t "]) for w in words).encode()
    (whole,) = near_dedup.shingle_sets([text], 5)
    for size in (64, 500, 4000):
        monkeypatch.setattr(near_dedup, "SLICE", size)
        (sliced,) = near_dedup.shingle_sets([text], 5)
        assert (sliced == whole).all() and len(whole) > 390


def test_long_text_memory():
    """A text of 64 MiB needs less than 500 MB beside itself."""
    rng = np.random.default_rng(1)
    line = b" ".join(b"w%d" % i for i in rng.integers(0, 10**6, 100_000))
    text = line * (-(-(64 << 20) // len(line)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(near_dedup.shingle_sets([text], 5)[0]) > 90_000
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500


@pytest.mark.parametrize(("block", "shingles"), [(7, 250_000), (1000, 300), (1000, 250_000)])
def test_many_edits(spark, monkeypatch, block, shingles):
    """Edited copies of three texts, most of them at the threshold; a centre of some does not fit the others."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    rng, rows = random.Random(block + shingles), []
    for f in range(3):
        base = [f"w{rng.randrange(400)}" for _ in range(90)]
        for i in range(90):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(90)] = f"x{rng.randrange(10**6)}" if i % 2 else f"w{rng.randrange(400)}"
            rows.append((100 * f + i, " ".join(words[: rng.randrange(80, 91)] if i % 3 == 0 else words)))
    got = near_dedup.near_duplicates(table(spark, [(*r, "s") for r in rows]), size=4)
    want = brute_components(rows, 4)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(want)
    assert len({c for _, _, c in want}) > 5


@pytest.mark.parametrize("order", ["sorted", "backwards", "shuffled", "star and two chains"])
def test_components_take_few_turns(spark, monkeypatch, order):
    """Turns grow with the logarithm of a chain's length, whatever its nodes are called; only the result's table stays."""
    n, written = 1000, []
    write = common.Tables.write
    monkeypatch.setattr(common.Tables, "write", lambda self, df, name: (written.append(name), write(self, df, name))[1])
    if order == "star and two chains":
        links = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(300, 600)] + [(2 * i, 2 * i + 2) for i in range(1000, 1200)] + [(5, 5), (1, 0)]
    else:
        names = {"sorted": list(range(n)), "backwards": list(range(n, 0, -1)), "shuffled": random.Random(1).sample(range(10**9), n)}[order]
        links = list(zip(names, names[1:], strict=False))
    tables = common.Tables(spark)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long").coalesce(1), tables).collect()}
    parts: dict[int, set[int]] = {}
    for u, v in links:
        whole = parts.get(u, {u}) | parts.get(v, {v})
        parts.update(dict.fromkeys(whole, whole))
    assert set(got) == set(parts) and all(label in parts[node] for node, label in got.items())
    assert len(set(got.values())) == len({min(p) for p in parts.values()})
    assert written.count("chosen") <= 15 and len(tables.paths) == 1
