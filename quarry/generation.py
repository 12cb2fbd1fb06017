"""Answers and rewritten queries by a language model, called once for each row of a table in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.retrieval import RetrievalPlan, Rewriter
from quarry.providers import LanguageModel

SYSTEM = "Answer from the passages that are given and from nothing else. Where they do not hold the answer, say that it is not known."
HYPOTHESIS = "Write a few sentences that could stand in a page which answers this question. They need not be true.\n\nQuestion: {question}\n\nPassage:"
#: What stands between contexts, and the frame around them and the question.
BETWEEN, FRAME = "\n\n---\n\n", ("Context:\n", "\n\nQuestion: ", "\n\nAnswer:")


def prompt(contexts: Column, question: Column) -> Column:
    """What a model is asked: the contexts (an array), then the question."""
    return F.concat(F.lit(FRAME[0]), F.array_join(contexts, BETWEEN), F.lit(FRAME[1]), question, F.lit(FRAME[2]))


def completed(rows: DataFrame, make: Callable[[], LanguageModel], asked: str, out: str, system: str = "", **settings) -> DataFrame:
    """Adds what the model says to column ``asked``. ``make`` builds the model once in each task."""
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        first = [{"role": "system", "content": system}] if system else []
        for b in batches:
            said = [model.complete([*first, {"role": "user", "content": text}], **settings).content for text in b[asked]]
            yield b.assign(**{out: said})[[*columns, out]]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{ddl}, `{out}` string")


def answers(queries: DataFrame, chunks: DataFrame, make: Callable[[], LanguageModel], k: int = 5, plan: RetrievalPlan | None = None) -> DataFrame:
    """query_id, question, answer, contexts, sources: what the model says about the k best chunks of each query.

    A query without chunks is asked with no context. Sources are doc_ids, in the order of the contexts."""
    found = (plan or RetrievalPlan()).run(queries, chunks, k=k).select("query_id", "source", "doc_id", "rank")
    placed = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text")))
    held = found.join(chunks.select("source", "doc_id", "text"), ["source", "doc_id"]).groupBy("query_id").agg(placed.alias("held"))
    none = F.coalesce(F.col("held"), F.array().cast(held.schema["held"].dataType))
    asked = queries.join(held, "query_id", "left").select("query_id", F.col("query").alias("question"), F.transform(none, lambda x: x["text"]).alias("contexts"), F.transform(none, lambda x: x["doc_id"]).alias("sources"))
    out = completed(asked.withColumn("__prompt", prompt(F.col("contexts"), F.col("question"))), make, "__prompt", "answer", SYSTEM)
    return out.select("query_id", "question", "answer", "contexts", "sources")


def hypothetical(make: Callable[[], LanguageModel], temperature: float = 0.7, max_tokens: int = 256) -> Rewriter:
    """A rewriter whose further queries are passages that a model makes up for each query."""

    def rewrite(queries: DataFrame, n: int) -> DataFrame:
        each = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("nth"), F.replace(F.lit(HYPOTHESIS), F.lit("{question}"), F.col("query")).alias("__asked"))
        out = completed(each, make, "__asked", "query", temperature=temperature, max_tokens=max_tokens)
        return out.select("query_id", "nth", F.trim(F.regexp_replace("query", r"^\s+|\s+$", "")).alias("query"))

    return rewrite
