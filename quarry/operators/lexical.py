"""BM25 over all queries at once.

Only words that some query has are counted: the words of the corpus meet the
queries' words before the first shuffle, so what is dealt out grows with the
hits, not with the corpus. Statistics belong to a source and are never shared.

Up to ``BLOCK`` queries are held by every task: one pass counts documents of
each of their words, another one scores batches of documents and keeps the best
k for each query over all batches of a task, so no posting is shuffled. More
queries, and all scores where they are wanted, go through joins. Both give the
same ranks, whatever the type of the ids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import text as T
from quarry.operators.best import Best, plain

K1, B = 1.2, 0.75
BLOCK = 4096  # queries that a task holds
CELLS = 1_000_000  # scores of queries and documents that a task holds
TOKENS = 250_000  # words that a task looks at together, but for longer documents


def term_frequencies(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """source, doc_id, dl, term, tf of ``docs`` (source, doc_id, text); ``wanted`` (term) restricts the terms."""
    rows = docs.select("source", "doc_id", T.bm25_tokens(F.col("text")).alias("tokens"))
    rows = rows.select("source", "doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if wanted is not None:
        rows = rows.join(wanted, "term", "left_semi")
    return rows.groupBy("source", "doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def document_frequencies(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("source", "term").agg(F.count("*").alias("df"))


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """source, n_docs, avgdl; documents without words count."""
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.avg(F.coalesce(T.bm25_length(F.col("text")), F.lit(0))).alias("avgdl"))


def scores(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, source, doc_id, score for every document that shares a word with the query (query_id, query).

    A word that a query repeats counts as often."""
    asked = queries.select("query_id", F.explode(T.bm25_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    tf = term_frequencies(docs, asked.select("term").distinct())
    weighted = tf.join(document_frequencies(tf), ["source", "term"]).join(corpus_statistics(docs), "source")
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    f = F.col("tf").cast("double")
    weighted = weighted.select("source", "doc_id", "term", (idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("w"))
    return asked.join(weighted, "term").groupBy("query_id", "source", "doc_id").agg(F.round(F.sum(F.col("times") * F.col("w")), 6).alias("score"))


def ranked(scored: DataFrame, k: int, deny: DataFrame | None = None, per: tuple[str, ...] = ("query_id",), ties: tuple[str, ...] = ("source", "doc_id")) -> DataFrame:
    """The best k of each query. Denied pairs (query_id, doc_id) go before ranks are given, so k are left."""
    if deny is not None:
        scored = scored.join(deny, ["query_id", "doc_id"], "left_anti")
    order = Window.partitionBy(*per).orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches (source, doc_id, tokens) in parts of so many rows and of ``TOKENS`` words at most, one document at least."""
    for b in batches:
        offsets, at = b.column(2).offsets.to_numpy(), 0
        while at < b.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOKENS, "right")) - 1), b.num_rows)
            yield b.slice(at, end - at)
            at = end


def _hits(tokens: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of word lists: lengths, and document, word and frequency of all words that are wanted."""
    lengths = np.diff(tokens.offsets.to_numpy())
    found = pc.index_in(tokens.flatten(), value_set=words)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lengths)), lengths)[known]
    pairs, tf = np.unique(doc * max(1, len(words)) + found.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
    return lengths, pairs // max(1, len(words)), pairs % max(1, len(words)), tf


def _counts(words: pa.Array):
    """source, word (-1 for all), n documents, n words of a task."""

    def rows(found: dict[str | None, tuple[np.ndarray, list[int]]]) -> pa.RecordBatch:
        some = [(name, np.flatnonzero(df), df, all_) for name, (df, all_) in found.items()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name for name, word, _, _ in some for _ in range(len(word) + 1)], pa.string()),
                pa.array([w for _, word, _, _ in some for w in (*word.tolist(), -1)], pa.int64()),
                pa.array([n for _, word, df, all_ in some for n in (*df[word].tolist(), all_[0])], pa.int64()),
                pa.array([n for _, word, _, all_ in some for n in (*[0] * len(word), all_[1])], pa.int64()),
            ],
            names=["source", "word", "n", "n_words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str | None, tuple[np.ndarray, list[int]]] = {}
        for b in _parts(batches, CELLS):
            lengths, doc, word, _ = _hits(b.column(2), words)
            coded, wide = b.column(0).dictionary_encode(), max(1, len(words))
            names = [*coded.dictionary.to_pylist(), None]
            source = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
            pairs, times = np.unique(source[doc] * np.int64(wide) + word, return_counts=True)
            edges = np.searchsorted(pairs, np.arange(len(names) + 1) * wide)
            size, total = np.bincount(source, minlength=len(names)), np.bincount(source, weights=lengths, minlength=len(names))
            for i in np.flatnonzero(size).tolist():
                if len(found) * wide > CELLS:
                    yield rows(found)
                    found = {}
                df, all_ = found.setdefault(names[i], (np.zeros(len(words), np.int64), [0, 0]))
                df[pairs[edges[i] : edges[i + 1]] - i * wide] += times[edges[i] : edges[i + 1]]
                all_[0] += int(size[i])
                all_[1] += int(total[i])
        yield rows(found)

    return run


def _best(ids: pa.Array, words: pa.Array, asked: tuple[np.ndarray, np.ndarray, np.ndarray], of: dict, k: int, k1: float, b_: float):
    """source, doc_id, words to the best k of the task for each query. ``asked``: for each word where its queries begin, the queries, the times."""
    begin, query, times = asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind, numbers = Best(k), pa.int64(), np.arange(len(ids))
        for b in _parts(batches, max(1, CELLS // len(ids))) if len(ids) else ():
            kind = b.schema.field(1).type
            lengths, doc, word, tf = _hits(b.column(2), words)
            names = b.column(0).to_pylist()
            average = np.array([of[n][0] for n in names])
            idf = np.array([of[names[d]][1].get(w, 0.0) for d, w in zip(doc.tolist(), word.tolist(), strict=True)])
            length = np.divide(lengths, average, out=np.zeros(len(lengths)), where=average > 0)
            weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * length[doc]))
            n = begin[word + 1] - begin[word]
            each = np.repeat(begin[word] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            score = np.bincount(query[each] * b.num_rows + np.repeat(doc, n), weights=times[each] * np.repeat(weight, n), minlength=len(ids) * b.num_rows).reshape(len(ids), b.num_rows)
            any_ = score > 0
            score = np.round(score, 6) + 0.0
            score[~any_] = -np.inf
            sources = np.empty(b.num_rows, object)
            sources[:] = names
            best.add(numbers, sources, plain(b.column(1)), score)
            if best.full():
                yield from named(best, kind)
        yield from named(best, kind)

    def named(best: Best, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for rows in best.rows(pa.int64(), kind):
            yield pa.RecordBatch.from_arrays([ids.take(rows.column(0)), *rows.columns[1:]], names=rows.schema.names)

    return run


def _held(queries: list, asked_of: DataFrame, docs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """query_id, source, doc_id, score: what is among the best k of a batch, for queries (query_id, words) that tasks hold."""
    id_type, doc_type = asked_of.schema["query_id"].dataType, docs.schema["doc_id"].dataType
    ids = pa.array([r[0] for r in queries], to_arrow_type(id_type))
    terms = sorted({w for r in queries for w in r[1]})
    place = {w: i for i, w in enumerate(terms)}
    rows = sorted((place[w], i, n) for i, r in enumerate(queries) for w, n in Counter(r[1]).items())
    begin = np.searchsorted(np.array([w for w, _, _ in rows], np.int64), np.arange(len(terms) + 1))
    asked = begin, np.array([i for _, i, _ in rows], np.int64), np.array([n for _, _, n in rows], np.float64)
    words = pa.array(terms, pa.string())
    tokens = docs.select(F.col("source").cast("string").alias("source"), "doc_id", F.coalesce(T.bm25_tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    counted = tokens.mapInArrow(_counts(words), "source string, word long, n long, n_words long").groupBy("source", "word").agg(F.sum("n").alias("n"), F.sum("n_words").alias("n_words")).collect()
    of = {r.source: (r.n_words / r.n, {}, r.n) for r in counted if r.word == -1}
    for r in counted:
        if r.word >= 0:
            n = of[r.source][2]
            of[r.source][1][r.word] = float(np.log((n - r.n + 0.5) / (r.n + 0.5) + 1))
    return tokens.mapInArrow(_best(ids, words, asked, of, k, k1, b), f"query_id {id_type.simpleString()}, source string, doc_id {doc_type.simpleString()}, score double")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10, deny: DataFrame | None = None, k1: float = K1, b: float = B, block: int = BLOCK) -> DataFrame:
    """query_id, source, doc_id, score, rank over the sources of ``docs`` together."""
    some = queries.select("query_id", F.coalesce(T.bm25_tokens(F.col("query")), F.array().cast("array<string>"))).limit(block + 1).collect()
    if len(some) > block:
        return ranked(scores(queries, docs, k1, b), k, deny)
    denied = 0 if deny is None else (deny.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)
    return ranked(_held(some, queries, docs, k + denied, k1, b), k, deny)
