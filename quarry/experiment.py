"""One evaluation run: every item of every set retrieved, scored and averaged in one plan."""

from __future__ import annotations

import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import manifest, scratch
from quarry.config import RunConfig
from quarry.functions.text import model_slug
from quarry.operators import metrics, stats
from quarry.operators.gold import gold_index, resolve_gold
from quarry.operators.retrieval import RetrievalPlan
from quarry.timing import StageTimes


def check_supported(cfg: RunConfig) -> None:
    if cfg.generation.enabled:
        raise NotImplementedError("generation is not scored: set generation.enabled to false")
    if cfg.eval.self_retrieval == "separate_index":
        raise NotImplementedError("eval.self_retrieval: separate_index")


def evaluate(cfg: RunConfig, items: DataFrame, chunks: DataFrame, corpus: DataFrame | None = None, times: StageTimes | None = None, **plugins) -> DataFrame:
    """Scored items (dataset, item_id, question, gold, gold_granularity, retrieved, found, metrics ...).

    ``corpus`` (chunk_id, url, merged_urls) is what gold is resolved against, if it is not ``chunks``.
    ``items``: the evaluation-item schema. ``chunks``: chunk_id, doc_id (long),
    source, text, url, merged_urls. Items that a person rejected are left out;
    with holdout, an item's own chunks are denied before ranks are given."""
    check_supported(cfg)
    open_ = items.where(F.coalesce("verified", F.lit("")) != "no").withColumn("query_id", F.xxhash64("dataset", "id"))
    resolved = resolve_gold(open_.select(F.col("query_id").alias("item_id"), "gold_urls"), gold_index((chunks if corpus is None else corpus).select("chunk_id", "url", "merged_urls")))
    deny = None
    if cfg.eval.self_retrieval == "holdout":
        own = open_.select("query_id", F.explode("exclude_chunk_ids").alias("chunk_id"))
        deny = own.join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("query_id", "doc_id")
    denied = 0 if deny is None else (deny.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)
    plan = RetrievalPlan.from_config(cfg, **plugins)
    found = plan.run(open_.select("query_id", F.col("question").alias("query")), chunks, k=cfg.retrieval.candidates_k, deny=deny, denied=denied, times=times)
    named = found.join(chunks.select("source", "doc_id", "chunk_id", "url"), ["source", "doc_id"])
    ranked = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "url", F.col("final_score").alias("score"))))
    lists = named.groupBy("query_id").agg(ranked.alias("found")).withColumn("retrieved", F.transform("found", lambda x: x["chunk_id"]))
    gold = resolved.select(F.col("item_id").alias("query_id"), F.col("gold_chunk_ids").alias("gold"), "gold_granularity")
    none = F.array().cast("array<string>")
    joined = open_.select("query_id", "dataset", "id", "question").join(gold, "query_id").join(lists, "query_id", "left")
    return metrics.score_items(joined.select("dataset", F.concat_ws("::", "dataset", "id").alias("item_id"), "question", "gold", "gold_granularity", F.coalesce("retrieved", none).alias("retrieved"), "found"), tuple(cfg.eval.k_values))


def metrics_block(long: list, intervals: list, k_values: tuple[int, ...]) -> dict:
    """A set's metrics as a manifest holds them: n, mrr, a map by k for each other metric, and the intervals by full name."""
    value = {r["metric"]: r["value"] for r in long}
    families = {f"{m}_at_k": {str(k): value.get(f"{m}_at_{k}", 0.0) for k in k_values} for m in ("recall", "precision", "hit_rate", "ndcg")}
    return {"n": max((r["n"] for r in long), default=0), "k_values": list(k_values), "mrr": value.get("mrr", 0.0), "cis": {r["metric"]: [r["lo"], r["hi"]] for r in intervals}, **families}


def _rows(scored: DataFrame, k_values: tuple[int, ...]) -> Iterator[dict]:
    names = ["mrr", *(f"{m}_at_{k}" for k in k_values for m in ("recall", "precision", "hit_rate", "ndcg"))]
    for r in scored.orderBy("dataset", "item_id").toLocalIterator():  # a row for each item that a person labelled
        retrieved = [{"chunk_id": x["chunk_id"], "url": x["url"], "score": x["score"], "rank": x["rank"]} for x in r["found"] or []]
        yield {"item_id": r["item_id"], "dataset": r["dataset"], "question": r["question"], "gold_chunk_ids": list(r["gold"]), "gold_granularity": r["gold_granularity"], "retrieved": retrieved, "metrics": {n: r[n] for n in names}}


def run_experiment(cfg: RunConfig, config_path: str, items: DataFrame, chunks: DataFrame, root: Path, corpus: DataFrame | None = None, corpus_sha: str = "", dataset_shas: dict[str, str] | None = None, **plugins) -> dict:
    """Evaluates, writes a run folder (rows of all items, manifest, resolved configuration) and gives the manifest.

    Its timings have the rows and the task time of each stage of the retrieval.

    The items are scored once, into a table; rows, means and intervals are read from it."""
    began = time.perf_counter()
    k_values = tuple(cfg.eval.k_values)
    scored = scratch.written(evaluate(cfg, items.where(F.col("dataset").isin(*cfg.eval.datasets)), chunks, corpus, times := StageTimes(items.sparkSession), **plugins), "scored")
    means = metrics.aggregate_metrics(scored, k_values).collect()
    intervals = stats.bootstrap_ci(metrics.long_form(scored, k_values)).collect()
    blocks = {d: metrics_block([r for r in means if r["dataset"] == d], [r for r in intervals if r["dataset"] == d], k_values) for d in cfg.eval.datasets}
    folder = manifest.new_run(cfg, root)
    n = manifest.write_rows(folder, _rows(scored, k_values))
    names = {s: f"{s}__{model_slug(cfg.embedding.model)}" for s in cfg.corpus.sources}
    return manifest.write_manifest(folder, cfg, config_path, blocks, timings={"total_seconds": time.perf_counter() - began, "items": n, "stages": times.to_dict()}, corpus_sha=corpus_sha, collection_names=names, dataset_shas=dataset_shas or {})
