"""Ranked lexical search over an inverted index with block maxima.

The index has segments of bounded size. In a segment the documents are numbered,
and each of its words has a posting list in blocks of ``POSTINGS`` documents:
gaps and frequencies as variable-length bytes. Beside the bytes, each block's
head holds its last document and the largest impact in it, the part of a score
that depends on document and frequency. All words and all rows are indexed.

Queries go to tasks in blocks of bounded size; a task gets whole segments, and of
them the lists of the words that are asked for. For each query the shallow
pointers, one a list, pass over the heads: between two block ends all of them
stand still, and there the block maxima, times the words' weights, bound every
score. Where the bound is below the threshold, the k-th best score so far,
nothing is decompressed and the pointers go on behind it. Elsewhere the blocks
under the pointers are decompressed, once for all queries of the task, and the
documents between scored in full. The threshold rises from window to window of a
segment and from segment to segment of a task; with many segments some ``WAVE``
of them are searched first, and the k-th best scores there start the others.
A bound equal to the threshold is looked into, as ties go to the smaller doc_id.
All scores are 64-bit integers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

#: Fixed pattern of the contract: letters, digits and everything that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
POSTINGS = 64
SEGMENT_WORDS, SEGMENT_DOCS = 3_000_000, 1 << 15  # at most, or one document
WINDOW = 2048  # documents that are scored with one threshold
WAVE = 64
QUERY_BYTES = 4 << 20  # of the words of a block of queries, about; one query at least
BROADCAST_BYTES = 8 << 20
BEST = 50

POSTING = "segment long, term binary, df long, heads binary, data binary"
HEAD = np.dtype([("last", "<i4"), ("most", "<i4"), ("end", "<i4")])


class _Numbers(dict):
    """Words by the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the last one of each below 128; and how many bytes each has."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1) << np.uint64(7 * k) if 7 * k < 64 else np.zeros(len(v), bool)
        if not more.any():
            break
        size += more
    out = np.empty(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        has = size > k
        low = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[at[has] + k] = low | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers that ``packed`` made into bytes."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first) if len(last) else np.zeros(0, np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a word's weight is multiplied by; 1,000,000 at most."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Segment:
    """Documents on their way into a segment."""

    def __init__(self):
        self.words, self.lists, self.ids, self.lengths, self.total = _Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, raw: memoryview | bytes) -> None:
        n = 0
        for words in common.cut_words(raw):
            if words:
                self.lists.append((len(self.ids), np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))))
                n += len(words)
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.total += n

    def full(self) -> bool:
        return self.total >= SEGMENT_WORDS or len(self.ids) >= SEGMENT_DOCS

    def rows(self, number: int, n_docs: int, n_words: int) -> pa.RecordBatch:
        """The segment's documents (a row without a word) and the list of every word."""
        size, lengths = max(1, len(self.ids)), np.array(self.lengths, np.int64)
        keys = np.sort(np.concatenate([w.astype(np.int64) * size + d for d, w in self.lists] or [np.zeros(0, np.int64)]))
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        tf = np.diff(first, append=len(keys))
        term, doc = np.divmod(keys[first], size)
        del keys
        df = np.bincount(term, minlength=len(self.words))
        begin = np.cumsum(df) - df
        blocks = -(-df // POSTINGS)
        nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        opens = np.repeat(begin, blocks) + POSTINGS * nth
        closes = np.minimum(opens + POSTINGS, np.repeat(begin + df, blocks))
        gap = np.diff(doc, prepend=0)
        gap[begin[df > 0]] = doc[begin[df > 0]] + 1  # from the place before the first document
        data, width = packed(np.stack([gap, tf], 1).ravel())
        stop = np.concatenate([[0], np.cumsum(width)])
        heads = np.zeros(len(opens), HEAD)
        heads["last"] = doc[closes - 1]
        if len(opens):
            m = 50 + (50 * lengths * n_docs) // max(1, n_words)
            heads["most"] = np.maximum.reduceat(impact(tf, m[doc]), opens)
        at = stop[2 * begin]  # of each list
        heads["end"] = stop[2 * closes] - np.repeat(at, blocks)
        edges = np.concatenate([[0], np.cumsum(blocks)]) * HEAD.itemsize
        ids = np.array([0 if i is None else i for i in self.ids], "<i8").tobytes() + bytes(i is None for i in self.ids)
        slices = lambda edges, whole: pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype("<i4").tobytes()), pa.py_buffer(whole)])
        columns = [
            pa.array([None, *self.words], pa.binary()),
            pa.array([len(self.ids), *df.tolist()], pa.int64()),
            pa.concat_arrays([pa.array([ids], pa.binary()), slices(edges, heads.tobytes())]),
            pa.concat_arrays([pa.array([lengths.astype("<i8").tobytes()], pa.binary()), slices(np.append(at, stop[-1]), data.tobytes())]),
        ]
        return pa.RecordBatch.from_arrays([pa.array([number] * len(columns[0]), pa.int64()), *columns], names=[c.split()[0] for c in POSTING.split(", ")])


@dataclass
class Index:
    """A written index: its postings, and how many documents with a word, words and segments it has."""

    postings: DataFrame
    n_docs: int
    n_words: int
    segments: int


def build_index(tables: common.Tables, docs: DataFrame) -> Index:
    """Indexes every row of ``docs`` (doc_id, text) as a document of its own, repeated rows too."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for b in batches:
            sizes = [sum(map(len, common.cut_words(common.raw_bytes(t)))) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["n_docs", "n_words"])

    total = docs.select("text").mapInArrow(count, "n_docs long, n_words long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_words"))).first()
    n_docs, n_words = int(total.n_docs), int(total.n_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        number, segment = TaskContext.get().partitionId() << 32, _Segment()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                segment.add(doc_id, common.raw_bytes(text))
                if segment.full():
                    yield segment.rows(number, n_docs, n_words)
                    number, segment = number + 1, _Segment()
        if segment.ids:
            yield segment.rows(number, n_docs, n_words)

    postings = tables.write(docs.mapInArrow(run, POSTING), "postings")
    return Index(postings, n_docs, n_words, postings.where("term is null").count())


class _Lists:
    """The lists of one segment that are asked for. Blocks are decompressed when they are first needed."""

    def __init__(self, ids: bytes, lengths: bytes, n_docs: int, n_words: int):
        n = len(lengths) // 8
        self.docs, self.no_id = np.frombuffer(ids, "<i8", n), np.frombuffer(ids, np.uint8, offset=8 * n).astype(bool)
        self.m = 50 + (50 * np.frombuffer(lengths, "<i8").astype(np.int64) * n_docs) // max(1, n_words)
        self.terms: dict[int, int] = {}
        self.parts: list[tuple[int, int, bytes, bytes]] = []

    def add(self, term: int, df: int, heads: bytes, data: bytes) -> None:
        self.terms[term] = len(self.parts)
        self.parts.append((term, df, heads, data))

    def close(self) -> None:
        heads = [np.frombuffer(p[2], HEAD) for p in self.parts]
        self.blocks = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int64)
        self.of = np.repeat(np.arange(len(heads)), np.diff(self.blocks))
        all_ = np.concatenate(heads or [np.zeros(0, HEAD)])
        self.last, self.most = all_["last"].astype(np.int64), all_["most"].astype(np.int64)
        inner = np.ones(len(all_), bool)
        inner[self.blocks[:-1]] = False
        self.first = np.where(inner, np.roll(self.last, 1) + 1, 0)
        size = np.array([len(p[3]) for p in self.parts], np.int64)
        self.stop = all_["end"] + np.repeat(np.cumsum(size) - size, np.diff(self.blocks))
        self.start = np.where(inner, np.roll(self.stop, 1), np.repeat(np.cumsum(size) - size, np.diff(self.blocks)))
        self.data = np.frombuffer(b"".join(p[3] for p in self.parts), np.uint8)
        df = np.array([p[1] for p in self.parts], np.int64)
        held = np.full(len(all_), POSTINGS, np.int64)
        held[self.blocks[1:] - 1] = df - POSTINGS * (np.diff(self.blocks) - 1)
        self.held, self.at = held, np.cumsum(held) - held
        self.doc, self.worth = np.zeros(int(held.sum()), np.int32), np.zeros(int(held.sum()), np.int32)
        self.open = np.zeros(len(all_), bool)
        self.parts = []

    def ranges(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))

    def decompress(self, blocks: np.ndarray) -> None:
        new = blocks[~self.open[blocks]]
        if not len(new):
            return
        values = unpacked(self.data[self.ranges(self.start[new], self.stop[new] - self.start[new])]).reshape(-1, 2)
        held = self.held[new]
        before = np.cumsum(held) - held
        gap = np.cumsum(values[:, 0])
        doc = gap - np.repeat(gap[before] - values[before, 0] - (self.first[new] - 1), held)
        to = self.ranges(self.at[new], held)
        self.doc[to], self.worth[to] = doc, impact(values[:, 1], self.m[doc])
        self.open[new] = True

    def search(self, terms: np.ndarray, weights: np.ndarray, top: _Top) -> None:
        """Puts what is among the best of all documents of this segment into ``top``."""
        n = len(self.docs)
        blocks = self.ranges(self.blocks[terms], self.blocks[terms + 1] - self.blocks[terms])
        times = np.repeat(weights, self.blocks[terms + 1] - self.blocks[terms])
        bound = times * self.most[blocks]
        place = np.concatenate([self.first[blocks], self.last[blocks] + 1])
        order = np.argsort(place, kind="stable")
        total, place = np.cumsum(np.concatenate([bound, -bound])[order]), place[order]
        still = np.flatnonzero(np.diff(place, append=n + 1))
        place, total = np.minimum(place[still], n), total[still]
        bounds = np.repeat(total, np.diff(place, append=n)) if len(place) else total
        offset = n - len(bounds)  # no list begins before
        for a in range(0, n, WINDOW):
            least = top.threshold()
            likely = np.flatnonzero(bounds[max(0, a - offset) : max(0, a + WINDOW - offset)] >= least) + max(a, offset)
            if not len(likely):
                continue
            under = np.searchsorted(likely, self.last[blocks], side="right") > np.searchsorted(likely, self.first[blocks])
            deep = blocks[under]
            self.decompress(deep)
            at = self.ranges(self.at[deep], self.held[deep])
            doc, worth = self.doc[at], self.worth[at] * np.repeat(times[under], self.held[deep])
            inside = (doc >= a) & (doc < a + WINDOW)
            score = np.zeros(min(WINDOW, n - a), np.int64)
            np.add.at(score, doc[inside] - a, worth[inside])
            good = likely[score[likely - a] >= least]
            if len(good):
                top.add(score[good - a], self.docs[good], self.no_id[good])


class _Top:
    """The best k documents of one query so far."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.score, self.doc, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def threshold(self) -> int:
        return max(self.least, int(self.score[-1])) if len(self.score) == self.k else self.least

    def add(self, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        score, doc, no_id = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((doc, no_id, -score))[: self.k]
        self.score, self.doc, self.no_id = score[order], doc[order], no_id[order]


Query = tuple[int | None, list[bytes]]


def _searched(index_size: tuple[int, int], queries: list[Query], of: dict[bytes, int], weights: np.ndarray, least: np.ndarray, k: int):
    """Rows of whole segments one behind the other, the row without a word first: best documents of all of them for each query."""
    asked = [np.array([of[t] for t in terms if t in of], np.int64) for _, terms in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        tops = [_Top(k, int(x)) for x in least]
        lists = number = None

        def finish() -> None:
            if lists is None or not lists.parts:
                return
            place = np.full(len(weights), -1, np.int64)
            for t, p in lists.terms.items():
                place[t] = p
            lists.close()
            for terms, top in zip(asked, tops, strict=True):
                there = terms[place[terms] >= 0]
                if len(there):
                    lists.search(place[there], weights[there], top)

        for b in batches:
            for segment, term, df, heads, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                if term is None:
                    finish()
                    number, lists = segment, _Lists(heads.as_py(), data.as_py(), *index_size)
                    continue
                assert segment == number, "a list without its segment"
                lists.add(of[term], df, heads.as_py(), data.as_py())
        finish()
        item, score, doc = [], [], []
        for i, top in enumerate(tops):
            item += [queries[i][0]] * len(top.score)
            score += top.score.tolist()
            doc += [None if no else d for d, no in zip(top.doc.tolist(), top.no_id.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (item, doc, score)], names=["item_id", "doc_id", "score"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block(tables: common.Tables, index: Index, queries: list[Query], k: int) -> DataFrame:
    """item_id, doc_id, score: the best k of a block of queries, which fits a task, and some more."""
    spark = tables.spark
    terms = sorted({t for _, ts in queries for t in ts})
    wanted = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.binary())}))
    if sum(map(len, terms)) + 16 * len(terms) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    lists = index.postings.join(wanted, "term", "left_semi").select(*index.postings.columns)
    df = {bytes(r.term): r.df for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the block's words at most
    of = {t: i for i, t in enumerate(df)}
    weights = np.array([weight(df[t], index.n_docs) for t in of], np.int64)
    rows = index.postings.where("term is null").unionByName(lists)

    def wave(chosen: DataFrame, least: np.ndarray) -> DataFrame:
        dealt = chosen.repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())
        return tables.write(dealt.mapInArrow(_searched((index.n_docs, index.n_words), queries, of, weights, least, k), "item_id long, doc_id long, score long"), "found")

    least = np.ones(len(queries), np.int64)
    share = -(-index.segments // WAVE)
    if share <= 1:
        return wave(rows, least)
    early = F.pmod(F.xxhash64("segment"), F.lit(share)) == 0
    found = wave(rows.where(early), least)
    known = {r.item_id: r.score for r in ranked(found, k).where(F.col("rank") == k).select("item_id", "score").collect()}  # a row a query
    return found.unionByName(wave(rows.where(~early), np.array([known.get(q[0], 1) for q in queries], np.int64)))


def search(tables: common.Tables, index: Index, queries: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score of the best ``k`` documents of each item of ``queries`` (item_id, text).

    Rows of one item_id are one query with the words of all; a null item_id is
    an item too. Items without a word that the index has give no rows. Equal
    scores go by doc_id, null last."""
    text = common.ascii_lower(F.col("text").cast("string"))
    words = queries.select(F.col("item_id").cast("long").alias("item_id"), F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))).alias("terms"))
    words = tables.write(words.withColumn("bytes", F.octet_length(F.array_join("terms", " "))), "queries")
    total = words.agg(F.sum("bytes").alias("n")).first().n or 0
    n = max(1, -(-total // QUERY_BYTES))
    found = None
    for i in range(n):
        mine: dict[int | None, set[bytes]] = {}
        for r in words.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).select("item_id", "terms").collect():  # some QUERY_BYTES
            mine.setdefault(r.item_id, set()).update(t.encode("utf-8", "surrogatepass") for t in r.terms)
        block = _block(tables, index, [(q, sorted(t)) for q, t in mine.items()], k)
        found = block if found is None else found.unionByName(block)
    return tables.write(ranked(found, k).select("item_id", "rank", "doc_id", "score"), "ranked")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each ``benchmark`` item; see ``build_index`` and ``search`` for the defined cases."""
    tables = common.Tables(spark)
    index = build_index(tables, common.documents(spark, sf_dir))
    out = search(tables, index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    tables.drop(out)
    return out


_TERMS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS_SQL} AS terms FROM documents),
size AS (SELECT count(*) AS N, sum(len(terms))::BIGINT AS L FROM d WHERE len(terms) > 0),
t AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id, row_no, sum(CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1))) AS BIGINT)
      * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * N) // L))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN d USING (row_no) CROSS JOIN size GROUP BY ALL
),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""
