"""Filters and samples for synthetic evaluation questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import scratch
from quarry.functions import text as T
from quarry.functions import words
from quarry.operators import dense, directions
from quarry.outcomes import Outcomes

TURNS, HELD = 4, 1_000_000
AT_FIRST = 10_000  # items of a set whose links are looked for together
LINKS = 20_000_000  # links that are written at a time, about
SETS = 256  # cells that sets are dealt to
ASKED = 200_000  # trigrams of questions that a task holds
RARE_AT_MOST, CLOSED_BOOK_FROM, NEAR_DUPLICATE_FROM = 2, 0.85, 0.95

#: Words that make a trigram ordinary.
STOP_WORDS = (
    "a an the of to for in on at is are was were be been being do does did "
    "doesn don t and or but with from by as that this these those it its i "
    "you your my we our they their he she his her if not no so than then "
    "there here when where which who whom what how why can could should "
    "would will shall may might must has have had having also into out up "
    "down over under again further once"
).split()


def _distinct(texts: pa.Array, wanted: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and place of each text's distinct trigrams, and the trigrams that the places are of; of ``wanted`` only."""
    of, made = words.trigrams(texts)
    if wanted is not None:
        mine = pc.is_in(made, value_set=wanted)
        of, made = of[mine.to_numpy(zero_copy_only=False)], made.filter(mine)
    coded = made.dictionary_encode()
    size = max(1, len(coded.dictionary))
    pairs = np.unique(of.astype(np.int64) * size + coded.indices.to_numpy(zero_copy_only=False))
    return pairs // size, pairs % size, coded.dictionary


def document_trigrams(docs: DataFrame, wanted: pa.Array | None = None) -> DataFrame:
    """doc_id, trigram: distinct in each document; of ``wanted`` only, where it is given."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.parts(batches, 1):
            of, place, trigrams = _distinct(b.column(1), wanted)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), trigrams.take(pa.array(place))], names=["doc_id", "trigram"])

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, f"doc_id {kind}, trigram string")


def trigram_df(docs: DataFrame) -> DataFrame:
    """trigram, df over documents; counted in tasks, a part of the texts at a time, before trigrams are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.parts(batches, 0):
            _, place, trigrams = _distinct(b.column(0))
            yield pa.RecordBatch.from_arrays([trigrams, pa.array(np.bincount(place, minlength=len(trigrams)), pa.int64())], names=["trigram", "n"])

    return docs.select(F.lower("text").alias("text")).mapInArrow(run, "trigram string, n long").groupBy("trigram").agg(F.sum("n").alias("df"))


def is_content(trigram: Column) -> Column:
    return ~F.arrays_overlap(F.split(trigram, " "), F.array(*map(F.lit, STOP_WORDS)))


def lexical_overlap(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """question_id, doc_id, rejected of pairs (question_id, question, doc_id): whether a rare trigram of content words
    is in both. The corpus is counted for the questions' trigrams only; one that it lacks counts 0.

    Up to ``ASKED`` of these are held by every task and looked for as texts are read; more meet the corpus in a join."""
    asked = questions.select("question_id", "doc_id", F.explode(T.trigrams(T.trigram_tokens(F.col("question")))).alias("trigram")).where(is_content(F.col("trigram")))
    wanted = scratch.written(questions.select(F.explode(T.trigrams(T.trigram_tokens(F.col("question")))).alias("trigram")).where(is_content(F.col("trigram"))).distinct(), "asked")
    some = [r.trigram for r in wanted.limit(ASKED + 1).collect()]
    held = document_trigrams(docs, pa.array(some, pa.string())) if len(some) <= ASKED else document_trigrams(docs).join(wanted, "trigram", "left_semi")
    held = scratch.written(held, "held")  # read twice
    df = held.groupBy("trigram").agg(F.count("*").alias("df"))
    shared = asked.join(held, ["doc_id", "trigram"], "left_semi").join(df, "trigram", "left").where(F.coalesce("df", F.lit(0)) <= RARE_AT_MOST)
    hit = shared.select("question_id", "doc_id").distinct().withColumn("rejected", F.lit(True))
    return questions.select("question_id", "doc_id").join(hit, ["question_id", "doc_id"], "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))


def closed_book(questions: DataFrame, answer: Callable[[str], Column] | Column, embed: Callable[[Column], Column] = T.fake_embedding, threshold: float = CLOSED_BOOK_FROM) -> DataFrame:
    """Adds rejected: an answer given without the passage comes close to it (question, text)."""
    given = answer(F.col("question")) if callable(answer) else answer
    return questions.withColumn("rejected", F.round(T.cosine(embed(given), embed(F.col("text"))), 6) >= threshold)


def near_duplicate_pairs(vectors: DataFrame, queries: DataFrame, threshold: float = NEAR_DUPLICATE_FROM) -> DataFrame:
    """query_id, doc_id, score of stated queries against all vectors (doc_id, embedding), other than themselves."""
    return dense.similar(queries, vectors.withColumn("source", F.lit("")), threshold).select("query_id", "doc_id", "score")


def near_duplicate_counts(vectors: DataFrame, threshold: float = NEAR_DUPLICATE_FROM) -> DataFrame:
    """doc_id, n_links of all vectors (doc_id, embedding): how many others are close to each."""
    n = dense.link_counts(vectors.select(F.col("doc_id").alias("query_id"), "embedding"), vectors.withColumn("source", F.lit("")), threshold)
    return vectors.select("doc_id").join(n.withColumnRenamed("query_id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def _in_order(links: DataFrame) -> DataFrame:
    """doc_id of accepted items among the first of each set, those with ``HELD`` of the links (set_id, a, item_a, b, item_b), about: one task a set."""
    size = links.groupBy("set_id").agg(F.count("*").alias("n"), F.percentile_approx("item_b", [i / 64 for i in range(1, 65)], 10_000).alias("cuts"))
    cut = size.select("set_id", F.when(F.col("n") <= HELD, F.lit(None)).otherwise(F.get("cuts", F.greatest(F.lit(0), F.expr(f"int({HELD} * 64 div n) - 1")))).alias("cut"))
    some = links.join(F.broadcast(cut) if cut.count() <= 10_000 else cut, "set_id").where("cut is null or item_b <= cut")

    def run(table: pa.Table) -> pa.Table:
        a, b, order_a, order_b = (table.column(c).to_numpy() for c in ("a", "b", "item_a", "item_b"))
        rejected: set[int] = set()
        near: dict[int, list[int]] = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            near.setdefault(x, []).append(y)
        items = dict(zip(np.concatenate([order_a, order_b]).tolist(), np.concatenate([a, b]).tolist(), strict=True))
        accepted = []
        for i in sorted(items):
            if items[i] not in rejected:
                accepted.append(items[i])
                rejected.update(near.get(items[i], ()))
        return pa.table({"doc_id": pa.array(accepted, pa.int64())})

    return some.select("set_id", "a", "item_a", "b", "item_b").groupBy("set_id").applyInArrow(run, "doc_id long")


def _accepted(first: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """doc_id of the accepted ones among ``first`` (set_id, item_id, doc_id, embedding), and how many links there are.

    An item is accepted when none of the earlier ones close to it is undecided or
    accepted, and then rejects the later ones; each turn decides all items that
    it can, in tables. Long chains would take a turn for each link, so every
    ``TURNS``-th turn goes through the first ``HELD`` links of each set in order.
    Links are found in cells that can hold one."""
    near = directions.close(first.select(F.lit("").alias("source"), "doc_id", "embedding"), threshold).links
    side = lambda x: first.select(F.col("set_id").alias(f"set_{x}"), F.col("item_id").alias(f"item_{x}"), F.col("doc_id").alias(x))
    # links from earlier to later items of one set
    links = near.select(F.col("query_id").alias("a"), F.col("doc_id").alias("b")).join(side("a"), "a").join(side("b"), "b").where("set_a = set_b and item_a < item_b")
    links = scratch.written(links.select(F.col("set_a").alias("set_id"), "a", "item_a", "b", "item_b"), "links")
    open_, accepted, turn, n = first.select("doc_id"), None, 0, links.count()
    while True:
        turn += 1
        if turn % TURNS:
            free = scratch.written(open_.join(links.select(F.col("b").alias("doc_id")), "doc_id", "left_anti"), "accepted")
        else:
            free = scratch.written(_in_order(links), "accepted")
        accepted = free if accepted is None else accepted.unionByName(free)
        if not links.take(1):
            return accepted, n
        gone = links.join(free.select(F.col("doc_id").alias("a")), "a").select(F.col("b").alias("doc_id")).distinct()
        decided = scratch.written(free.unionByName(gone), "decided")
        open_ = scratch.written(open_.join(decided, "doc_id", "left_anti"), "open")
        links = scratch.written(links.join(decided.select(F.col("doc_id").alias("a")), "a", "left_anti").join(decided.select(F.col("doc_id").alias("b")), "b", "left_anti"), "links")


def _split(open_: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """The first ``size`` items of each set, about, and the others; none where no set has more."""
    sets = open_.groupBy("set_id").agg(F.count("*").alias("n"), F.percentile_approx("item_id", [i / 64 for i in range(1, 65)], 10_000).alias("cuts"))
    cuts = scratch.written(sets.select("set_id", F.when(F.col("n") > size, F.get("cuts", F.greatest(F.lit(0), F.expr(f"int({size} * 64 div n) - 1")))).alias("cut")), "cuts")
    if not cuts.where("cut is not null").take(1):
        return open_, None
    both = open_.join(F.broadcast(cuts) if cuts.count() <= 10_000 else cuts, "set_id")
    return both.where("cut is null or item_id <= cut").drop("cut"), both.where("item_id > cut").drop("cut")


def near_duplicate_greedy(items: DataFrame, threshold: float = NEAR_DUPLICATE_FROM) -> DataFrame:
    """set_id, item_id, accepted: in item order, an item close to one accepted before is not (set_id, item_id, embedding).

    Equal vectors of a set are one; of them only the first can be accepted. The
    first items of each set are decided by their links; those that they accept
    meet all later ones, and what is close to them is rejected before its own
    links are looked for. Then come the next: more of them where links are few,
    so that some ``LINKS`` are written at a time. Item ids are unique in a set."""
    rows = items.select("set_id", "item_id", "embedding", F.xxhash64("set_id", "item_id").alias("doc_id"))
    left = scratch.written(rows.groupBy("set_id", "embedding").agg(F.min(F.struct("item_id", "doc_id")).alias("x")).select("set_id", "x.item_id", "x.doc_id", "embedding"), "firsts")
    accepted, size = None, AT_FIRST
    while True:
        now, later = _split(left, size)
        now = scratch.written(now, "now")
        yes, links = _accepted(now, threshold)
        accepted = yes if accepted is None else accepted.unionByName(yes)
        if later is None:
            break
        cell = F.pmod(F.xxhash64("set_id"), F.lit(SETS)).cast("int").alias("cell")
        source = F.col("set_id").cast("string").alias("source")
        by = now.join(yes, "doc_id", "left_semi").select(cell, source, F.col("doc_id").alias("query_id"), "embedding")
        near = dense.linked(by, later.select(cell, source, "doc_id", "embedding"), threshold)
        left = scratch.written(later.join(near, "doc_id", "left_anti"), "left")
        size = max(AT_FIRST // 8, min(8 * size, int(size * (LINKS / max(1, links)) ** 0.5)))
    yes = accepted.withColumn("accepted", F.lit(True))
    return rows.join(yes, "doc_id", "left").select("set_id", "item_id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def seeded_order(key: Column, seed: int) -> Column:
    """A stand-in for a shuffle: the order of SHA-256 over seed and key."""
    return F.sha2(F.concat_ws("-", F.lit(str(seed)), key.cast("string")), 256)


def stratified_sample(rows: DataFrame, n: int, key: str, section: str = "section", seed: int = 0) -> DataFrame:
    """n rows round-robin over the sections in name order; adds place, from 1."""
    nth = F.row_number().over(Window.partitionBy(section).orderBy(seeded_order(F.col(key), seed)))
    top = rows.withColumn("nth", nth).where(F.col("nth") <= n).orderBy("nth", section).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("nth", section))).drop("nth")


def build_report(judged: DataFrame) -> DataFrame:
    """One row of counts of judged questions (question, section, reject_reason null where retained)."""
    count = lambda reason: F.count(F.when(F.col("reject_reason") == reason, 1))
    kept = F.col("reject_reason").isNull()
    return judged.agg(
        F.count(F.when(F.col("question").isNotNull(), 1)).alias("generated"),
        count("lexical").alias("rejected_lexical"),
        count("closed_book").alias("rejected_closed_book"),
        count("duplicate").alias("rejected_duplicate"),
        count("generation_error").alias("rejected_generation_error"),
        F.count(F.when(kept, 1)).alias("retained"),
        F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("section")))), ",").alias("sections_covered"),
    )


def generated_by(outcomes: Outcomes, prompt: Callable[[Column, Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """Questions of a model about chunks, from its table of outcomes; ``prompt`` makes what is asked of title and text."""
    return lambda chunks: outcomes.complete(chunks.withColumn("__asked", prompt(F.col("title"), F.col("text"))), "__asked", "question").drop("__asked")


def build_questions(chunks: DataFrame, generate: Callable[[DataFrame], DataFrame], answer: Callable[[Column], Column], n: int = 150, seed: int = 0, dataset: str = "synthetic", embed: Callable[[Column], Column] = T.fake_embedding) -> DataFrame:
    """Sampled chunks (doc_id, text, title, section, url) with a generated question and the first reason to reject it.

    ``generate`` adds column question, null where it failed; ``generated_by``
    makes one that keeps what a model has said, so that a build that broke off
    goes on without asking again. Stages follow one another as columns."""
    sample = generate(stratified_sample(chunks, n, "doc_id", seed=seed))
    sample = sample.withColumn("question", F.btrim(F.trim("question"), F.lit('"')))
    pairs = sample.where(F.coalesce("question", F.lit("")) != "").select(F.col("doc_id").alias("question_id"), "question", "doc_id")
    lexical = lexical_overlap(pairs, chunks.select("doc_id", "text")).select("doc_id", F.col("rejected").alias("lexical"))
    closed = F.round(T.cosine(embed(answer(F.col("question"))), embed(F.col("text"))), 6) >= CLOSED_BOOK_FROM
    judged = sample.join(lexical, "doc_id", "left")
    reason = F.when(F.coalesce("question", F.lit("")) == "", F.lit("generation_error")).when(F.col("lexical"), F.lit("lexical")).when(closed, F.lit("closed_book"))
    judged = judged.withColumn("reject_reason", reason)
    left = judged.where(F.col("reject_reason").isNull()).select(F.lit(dataset).alias("set_id"), F.col("place").cast("long").alias("item_id"), embed(F.col("question")).alias("embedding"))
    greedy = near_duplicate_greedy(left).select(F.col("item_id").cast("int").alias("place"), "accepted")
    judged = judged.join(greedy, "place", "left")
    return judged.withColumn("reject_reason", F.when(F.col("accepted") == False, F.lit("duplicate")).otherwise(F.col("reject_reason"))).drop("accepted", "lexical")  # noqa: E712
