"""The retrieval plan: the stages that a configuration enables, for all queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry import scratch
from quarry.operators import fusion, lexical
from quarry.operators.dense import dense_topk, with_fake_embeddings
from quarry.timing import StageTimes


class QueryRewriter(Protocol):
    """Further queries for each query: (query_id, query) to (query_id, nth from 1, query)."""

    def __call__(self, queries: DataFrame, n: int) -> DataFrame: ...


Rewriter = Callable[[DataFrame, int], DataFrame]


def _counted(df: DataFrame, stage: str, counts: dict[str, Observation] | None, which: Column | None = None) -> DataFrame:
    """``df``, whose rows (those for which ``which`` holds) are counted as they pass, under the stage's name."""
    if counts is None:
        return df
    counts[stage] = Observation(f"{stage}-{len(counts)}")
    return df.observe(counts[stage], F.count(F.lit(1) if which is None else F.when(which, 1)).alias("rows"))


@dataclass
class RetrievalPlan:
    """Disabled stages add nothing to the plan."""

    top_k: int = 5
    candidates_k: int = 30
    dense: bool = True
    bm25: bool = False
    k1: float = lexical.K1
    b: float = lexical.B
    rrf_k: int = fusion.RRF_K
    caps: dict[str, int] = field(default_factory=dict)
    rewriter: QueryRewriter | None = None
    rewrite_n: int = 1
    rerank_top_n: int | None = None
    scorer: Callable = fusion.overlap_score
    expand_tokens: int | None = None
    embed: Callable = with_fake_embeddings

    def __post_init__(self) -> None:
        if not self.dense and not self.bm25:
            raise ValueError("dense and bm25 are both off: there is nothing to rank")

    @classmethod
    def from_config(cls, cfg, **plugins) -> RetrievalPlan:
        r = cfg.retrieval
        if r.query_rewrite.enabled and r.query_rewrite.mode != "hyde":
            raise NotImplementedError(f"query_rewrite.mode {r.query_rewrite.mode!r}: only hyde")
        if r.parent_expansion.enabled and r.parent_expansion.mode != "section":
            raise NotImplementedError(f"parent_expansion.mode {r.parent_expansion.mode!r}: only section")
        if r.query_rewrite.enabled and "rewriter" not in plugins:
            raise ValueError("query_rewrite is on and no rewriter is given")
        return cls(
            top_k=r.top_k,
            candidates_k=r.candidates_k,
            dense=r.dense.enabled,
            bm25=r.bm25.enabled,
            k1=r.bm25.k1,
            b=r.bm25.b,
            rrf_k=r.fusion.rrf_k,
            caps={"docs": r.per_source_caps.docs, "discussions": r.per_source_caps.discussions},
            rewrite_n=r.query_rewrite.n,
            rerank_top_n=r.rerank.top_n if r.rerank.enabled else None,
            expand_tokens=r.parent_expansion.max_tokens if r.parent_expansion.enabled else None,
            **({k: v for k, v in plugins.items() if k != "rewriter" or r.query_rewrite.enabled}),
        )

    def _dense(self, asked: DataFrame, vectors: DataFrame, deny: DataFrame | None, denied: int) -> DataFrame:
        """query_id, nth, source, doc_id, score, rank: a ranking for each (query_id, nth, query), all of them in one pass over the vectors."""
        if self.rewriter is None:
            return dense_topk(self.embed(asked, "query").select("query_id", "embedding"), vectors, self.candidates_k, deny, denied=denied).withColumn("nth", F.lit(0))
        each = scratch.written(asked.withColumn("one", F.xxhash64("query_id", "nth")), "asked")  # what a model has made up is not made up twice
        names = each.select("one", F.col("query_id").alias("whose"), "nth")
        mine = None if deny is None else deny.join(names, F.col("query_id") == F.col("whose")).select(F.col("one").alias("query_id"), "doc_id")
        found = dense_topk(self.embed(each, "query").select(F.col("one").alias("query_id"), "embedding"), vectors, self.candidates_k, mine, denied=denied)
        return found.join(names, F.col("query_id") == F.col("one")).select(F.col("whose").alias("query_id"), "nth", "source", "doc_id", "score", "rank")

    def run(self, queries: DataFrame, chunks: DataFrame, k: int | None = None, deny: DataFrame | None = None, denied: int = 0, counts: dict[str, Observation] | None = None, times: StageTimes | None = None) -> DataFrame:
        """Candidates (query_id, source, doc_id, final_score, rank, scores, ranks, stages).

        ``queries``: query_id, query. ``chunks``: source, doc_id, text and, as
        stages need them, embedding, parent_id, chunk_index. Rewritten queries
        feed dense search only. Expansion adds content. ``counts`` gets an
        observation for each stage, whose rows are known once the result is run;
        ``times`` runs the stages one by one and gets their rows and task times."""

        def step(stage: str, make: Callable[[], DataFrame]) -> DataFrame:
            return _counted(make(), stage, counts) if times is None else times.stage(stage, make)

        rankings = []
        if self.dense:
            asked = queries.select("query_id", F.lit(0).alias("nth"), "query")
            if self.rewriter is not None:
                asked = asked.unionByName(self.rewriter(queries, self.rewrite_n).select("query_id", "nth", "query"))
            vectors = chunks if "embedding" in chunks.columns else self.embed(chunks, "text")
            found = self._dense(asked, vectors, deny, denied) if times is None else times.stage("dense", lambda: self._dense(asked, vectors, deny, denied))
            for n in range(1 + (self.rewrite_n if self.rewriter is not None else 0)):
                found = _counted(found, f"dense_{n}" if n else "dense", counts, F.col("nth") == n)
            rankings.append(found.select("query_id", F.col("nth").alias("ranking_no"), F.col("rank").alias("pos"), "source", "doc_id", F.lit("dense").alias("stage"), "score"))
        if self.bm25:
            found = step("bm25", lambda: lexical.bm25_topk(queries, chunks, self.candidates_k, deny, self.k1, self.b))
            rankings.append(found.select("query_id", F.lit(1 + (self.rewrite_n if self.dense and self.rewriter is not None else 0)).alias("ranking_no"), F.col("rank").alias("pos"), "source", "doc_id", F.lit("bm25").alias("stage"), "score"))
        together = rankings[0]
        for r in rankings[1:]:
            together = together.unionByName(r)
        fused = step("fusion", lambda: fusion.reciprocal_rank_fusion(together, self.rrf_k))
        capped = step("caps", lambda: fusion.per_source_caps(fused, self.caps).where(F.col("rank") <= self.candidates_k))
        scored = capped if self.rerank_top_n is None else step("rerank", lambda: fusion.rerank(capped, queries, chunks, self.rerank_top_n, self.scorer))
        out = scored.where(F.col("rank") <= (self.top_k if k is None else k))
        return out if self.expand_tokens is None else step("expand", lambda: fusion.expand_parents(out, chunks, self.expand_tokens))
