"""Which documents hold a text whole.

One run of words inside a text finds the candidates: documents that lack it
cannot hold the text. The first and last word of a text may be parts of longer ones in
a document, so a text of fewer than seven words has no such run. Such texts go
to tasks in blocks of bounded size, as one automaton that reads each document
once for all of them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

GRAM = 5
BLOCK_BYTES = 4 << 20  # of short texts that a task holds


def _grams(text: str):
    """Hashes of runs of five words."""
    return F.coalesce(T.grams(T.bm25_tokens(F.col(text)), GRAM, F.xxhash64), F.array().cast("array<bigint>"))


def _short(queries: DataFrame, docs: DataFrame) -> DataFrame | None:
    """query_id, doc_id for texts that are looked for letter by letter."""
    size = queries.agg(F.sum(F.octet_length("query") + 16).alias("n")).first().n
    if not size:
        return None
    blocks, out = -(-size // BLOCK_BYTES), None
    for i in range(blocks):
        mine = [(r.query_id, r.query) for r in queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "query").collect()]  # some BLOCK_BYTES
        part = docs.where("text is not null").select("doc_id", "text").mapInArrow(_searched(mine), "query_id long, doc_id long")
        out = part if out is None else out.unionByName(part)
    return out


def _searched(mine: list[tuple[int, str]]):
    of: dict[str, list[int]] = {}
    for query_id, text in mine:
        of.setdefault(text, []).append(query_id)
    everywhere = of.pop("", [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for text, ids in of.items():
            automaton.add_word(text, ids)
        if of:
            automaton.make_automaton()
        for b in batches:
            queries, docs = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = set(everywhere)
                for _, ids in automaton.iter(text) if of else ():
                    held.update(ids)
                queries += held
                docs += [doc] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(docs, pa.int64())], names=["query_id", "doc_id"])

    return run


def holding(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id for every document of ``docs`` (doc_id, text) that holds a query's text (query_id, query) as it stands. An empty text is held by all."""
    q = queries.where("query is not null").withColumn("inner", F.size(T.bm25_tokens(F.col("query"))) >= GRAM + 2)
    asked = q.where("inner").select("query_id", F.get(_grams("query"), F.lit(1)).alias("key"))
    short = _short(q.where("not inner"), docs)
    keys = docs.select("doc_id", F.explode(F.array_distinct(_grams("text"))).alias("key"))
    near = keys.join(asked, "key").select("query_id", "doc_id").distinct()
    long = near.join(q.where("inner").select("query_id", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("query"))).select("query_id", "doc_id")
    return long if short is None else long.unionByName(short)
