"""Calls of a model that are made once."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import synth
from quarry.outcomes import Busy, Outcomes, patient, seconds
from quarry.providers import Completion


def model(log, fails=()):
    """A model that notes in a file what it is asked."""

    class Model:
        name = model = "noted"

        def complete(self, messages, *, temperature=0.0, max_tokens=1024):
            text = messages[-1]["content"]
            with open(log, "a") as out:
                print(json.dumps([len(messages), text]), file=out)
            if text in fails:
                raise RuntimeError("no")
            return Completion(f'"{text.upper()}?"', "noted")

    return Model


def asked(log):
    return sorted(json.loads(line)[1] for line in log.read_text().splitlines()) if log.exists() else []


def test_each_text_is_asked_once(spark, tmp_path):
    log, root = tmp_path / "log", f"file://{tmp_path}/outcomes"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "c")], "n long, q string")
    first = Outcomes(spark, root, model(log, {"b"}), "m", wave=1)
    got = {r.n: r.said for r in first.complete(rows, "q", "said").collect()}
    assert got == {1: '"A?"', 2: None, 3: '"A?"', 4: None, 5: '"C?"'} and asked(log) == ["a", "b", "c"]
    assert [r.error for r in first.failures().collect()] == ["RuntimeError: no"]
    again = Outcomes(spark, root, model(log), "m")
    got = {r.n: r.said for r in again.complete(rows, "q", "said").collect()}
    assert got[2] == '"B?"' and asked(log) == ["a", "b", "b", "c"] and again.failures().count() == 0
    again.complete(rows, "q", "said").count()
    assert len(asked(log)) == 4
    other = Outcomes(spark, root, model(log), "m", temperature=0.7, system="be brief")
    other.complete(rows.where("n = 1"), "q", "said").count()
    assert len(asked(log)) == 5 and json.loads(log.read_text().splitlines()[-1])[0] == 2


def test_a_wave_that_is_through_stays(spark, tmp_path):
    """The driver is lost between two waves: the next run asks for the rest."""
    log, root = tmp_path / "log", f"file://{tmp_path}/outcomes"
    rows = spark.range(40).select(F.col("id").cast("string").alias("q"))
    outcomes = Outcomes(spark, root, model(log), "m", wave=10)
    real, done = outcomes._asked, []

    def lost(missing):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(1)
        return real(missing)

    outcomes._asked = lost
    with pytest.raises(KeyboardInterrupt):
        outcomes.complete(rows, "q", "said")
    before = len(asked(log))
    assert 0 < before < 40
    assert Outcomes(spark, root, model(log), "m").complete(rows, "q", "said").where("said is not null").count() == 40
    assert asked(log) == sorted(map(str, range(40)))


def test_patience():
    waits, replies = [], iter([Busy("3"), Busy(), Busy("soon"), "said"])

    def call():
        reply = next(replies)
        if isinstance(reply, Exception):
            raise reply
        return reply

    assert patient(call, wait=waits.append) == ("said", None, 4) and waits == [3.0, 4.0, 8.0]
    assert patient(lambda: (_ for _ in ()).throw(Busy(0)), tries=2, wait=waits.append) == (None, "the service is busy", 2)
    assert patient(lambda: (_ for _ in ()).throw(Busy(1000)), wait=waits.append)[2] == 1
    assert [seconds(x) for x in (None, "7", 2, "Wed, 21 Oct", -3)] == [None, 7.0, 2.0, None, 0.0]


def test_a_build_goes_on_where_it_broke_off(spark, tmp_path):
    log = tmp_path / "log"
    chunks = spark.createDataFrame([(i, f"text number{i} words{i} here{i}", f"T{i}", "s" if i % 2 else "t", f"u{i}") for i in range(8)], "doc_id long, text string, title string, section string, url string")
    prompt = lambda title, text: F.concat(F.lit("about "), title)
    for fails, kept in (({"about T3", "about T4"}, 6), ((), 8)):
        outcomes = Outcomes(spark, f"file://{tmp_path}/outcomes", model(log, fails), "m")
        judged = synth.build_questions(chunks, synth.generated_by(outcomes, prompt), lambda q: F.lit("answer"), n=8)
        assert judged.where("reject_reason is null or reject_reason = 'duplicate' or reject_reason = 'closed_book'").count() == kept
        assert judged.where("question = 'ABOUT T1?'").count() == 1
    assert len(asked(log)) == 10
