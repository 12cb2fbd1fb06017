"""Command line: index corpora, run and gate evaluations, review and label their sets, list, pin and compare runs."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Iterator
from pathlib import Path

from quarry import config, manifest
from quarry.operators import review
from quarry.operators.runs import HEADLINE, WARN_MARGIN, gate_markdown


def gate_rows(run: dict, base: dict | None, cfg: config.RunConfig, dataset: str) -> list[dict]:
    rows = []
    for name, t in cfg.eval.thresholds.items():
        value, before = manifest.metric(run, dataset, name), manifest.metric(base, dataset, name) if base else None
        if value is None:
            note = "missing"
        elif value < t.min:
            note = "floor"
        elif before is None:
            note = "no baseline"
        elif value < before - t.regression_tolerance:
            note = "regressed"
        else:
            note = "improved" if value > before + WARN_MARGIN else "steady"
        verdict = "FAIL" if note in ("missing", "floor", "regressed") else "WARN" if note == "improved" else "PASS"
        rows.append({"metric": name, "verdict": verdict, "value": value, "floor": t.min, "baseline": before, "note": note})
    return rows


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quarry").getOrCreate()


def _places(a: argparse.Namespace):
    from quarry.index import Places

    return Places(a.docs, a.snippets, a.discussions, a.base_url)


def _index(a: argparse.Namespace) -> None:
    """Chunks the corpus and stores it, source by source."""
    from quarry import index
    from quarry.sources.store import ChunkStore

    spark = _session()
    store = ChunkStore(spark, a.store)
    for source, n in index.build(spark, store, _places(a), a.sha).items():
        print(f"{source}: {n} chunks")


def _experiment(a: argparse.Namespace) -> tuple[config.RunConfig, dict]:
    """Runs the configuration on the stored chunks and the sets of the folder."""
    from pyspark.sql import functions as F

    from quarry import index
    from quarry.experiment import check_supported, run_experiment
    from quarry.sources import files
    from quarry.sources.store import ChunkStore

    cfg = config.load(a.config, a.set)
    check_supported(cfg)
    spark = _session()
    store = ChunkStore(spark, a.store)
    parts = [store.read(s).withColumn("source", F.lit(s)) for s in cfg.corpus.sources]
    chunks = parts[0]
    for more in parts[1:]:
        chunks = chunks.unionByName(more, allowMissingColumns=True)
    chunks = chunks.withColumns({"doc_id": F.xxhash64("source", "chunk_id"), "text": F.col("document")})
    items, shas = None, {}
    for name in cfg.eval.datasets:
        one = files.read_eval_set(spark, str(a.sets), name).withColumn("dataset", F.lit(name))
        items = one if items is None else items.unionByName(one)
        shas[name] = files.file_sha256(a.sets / f"{name}.jsonl")
    if items is None:
        raise SystemExit("the configuration names no evaluation set")
    corpus = index.corpus(spark, _places(a), cfg.corpus.sources) if a.docs or a.discussions else None
    return cfg, run_experiment(cfg, a.config, items, chunks, a.runs_root, corpus, corpus_sha=(store.identity(cfg.corpus.sources[0]) or {}).get("corpus_sha", ""), dataset_shas=shas)


def _show(run: dict) -> None:
    print(f"run_id: {run['run_id']}")
    for dataset, block in run["metrics"].items():
        print(f"  {dataset}  (n={block['n']})")
        for name in [*(f"recall_at_{k}" for k in block["recall_at_k"]), "mrr"]:
            value = manifest.metric(run, dataset, name)
            low, high = block["cis"].get(name, (value, value))
            print(f"    {name}: {value:.3f}  [{low:.3f}, {high:.3f}]")


def _session_of(a: argparse.Namespace, lines: Iterator[str]) -> None:
    """A session over a set: each line that is understood goes to the journal beside the set at once, so one that breaks off is resumed; at its end the set is written anew with all decisions."""
    from pyspark.sql import functions as F

    spark = _session()
    path, journal = a.sets / f"{a.dataset}.jsonl", a.sets / f"{a.dataset}.journal.jsonl"
    needed = {"gold_urls": "array<string>", "verified": "string", "verified_at": "string", "ground_truth": "string"}
    items = spark.read.json(str(path))
    items = items.withColumns({c: F.col(c).cast(t) if c in items.columns else F.lit(None).cast(t) for c, t in needed.items()}).withColumnRenamed("id", "item_id")
    decided = lambda: review.from_journal(items, spark.read.schema(review.JOURNAL).json(str(journal)))
    with journal.open("a", encoding="utf-8"):
        now = decided()
    if a.command == "review":
        rows, parse = review.to_review(now, a.n, a.seed).orderBy("place").collect(), review.review_entry  # as many as a person reviews
        show = lambda r: print(f"{r.place}. {r.question}\n   {r.url}\n   y, n, s, q, or e and the question that is right")
    else:
        suggest = (lambda _: []) if a.no_suggestions else _suggestions(a)
        rows, parse = now.where("verified is null").select("item_id", "question", F.substring("ground_truth", 1, 200).alias("answer")).orderBy("item_id").toLocalIterator(), review.label_entry
        show = lambda r: print("\n   ".join([r.question, *([r.answer] if r.answer else []), *suggest(r.question), "addresses between commas, n or q"]))
    for entry in review.journalled(rows, lines, parse, show):
        with journal.open("a", encoding="utf-8") as out:
            print(json.dumps(entry), file=out)
    new, n, verdicts = path.with_suffix(".new"), 0, 0
    with new.open("w", encoding="utf-8") as out:
        for row in decided().withColumnRenamed("item_id", "id").toJSON().toLocalIterator():
            print(row, file=out)
            n, verdicts = n + 1, verdicts + ("verified" in json.loads(row))
    new.replace(path)
    journal.unlink()
    print(f"{verdicts}/{n} of {a.dataset} have a verdict")


def _typed() -> Iterator[str]:
    while True:
        try:
            yield input("> ")
        except EOFError:
            return


def _suggestions(a: argparse.Namespace) -> Callable[[str], list[str]]:
    """Addresses of the ten documentation chunks that are nearest to a question."""
    from pyspark.sql import functions as F

    from quarry.operators.dense import dense_topk, with_fake_embeddings
    from quarry.sources.store import ChunkStore

    spark = _session()
    chunks = ChunkStore(spark, a.store).read("docs").withColumns({"source": F.lit("docs"), "doc_id": F.xxhash64("chunk_id")})

    def suggest(question: str) -> list[str]:
        asked = with_fake_embeddings(spark.createDataFrame([(0, question)], "query_id long, query string"), "query")
        found = dense_topk(asked, chunks, 10).join(chunks.select("doc_id", "url"), "doc_id").orderBy("rank")
        return [r["url"] or "" for r in found.collect()]

    return suggest


def main(argv: list[str] | None = None, lines: Iterator[str] | None = None) -> int:
    """``lines`` is what is typed in a session; the terminal where it is none."""
    top = argparse.ArgumentParser(prog="quarry")
    top.add_argument("--runs-root", type=Path, default=Path("runs"))
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list").add_argument("--pinned", action="store_true")
    pin = sub.add_parser("pin")
    pin.add_argument("run")
    pin.add_argument("--name")
    board = sub.add_parser("leaderboard")
    board.add_argument("--dataset", required=True)
    board.add_argument("--metric", action="append")
    board.add_argument("--out", type=Path)
    run, gate, check, label, build = (sub.add_parser(name) for name in ("run", "gate", "review", "label", "index"))
    for one in (run, gate, build):
        one.add_argument("--docs", help="folder of Markdown pages; gold is resolved against the corpus where it is given")
        one.add_argument("--snippets", help="folder of the code that pages take in")
        one.add_argument("--discussions", help="file of discussions")
        one.add_argument("--base-url", default="")
    build.add_argument("--sha", default="")
    for one in (run, gate):
        one.add_argument("--config", required=True)
        one.add_argument("--set", action="append", default=[])
    for one in (run, gate, check, label):
        one.add_argument("--sets", type=Path, default=Path("eval_sets"))
    for one in (run, gate, label, build):
        one.add_argument("--store", default="store")
    for one in (gate, check, label):
        one.add_argument("--dataset", required=True)
    gate.add_argument("--run", help="a stored run; without it the configuration is run")
    gate.add_argument("--baseline", type=Path)
    gate.add_argument("--summary-out", type=Path)
    check.add_argument("--n", type=int, default=50)
    check.add_argument("--seed", type=int, default=0)
    label.add_argument("--no-suggestions", action="store_true")
    a = top.parse_args(argv)
    if a.command == "list":
        for m in manifest.list_runs(a.runs_root, a.pinned):
            print(m["created_at"], m["run_id"], m["name"])
    elif a.command == "pin":
        print(manifest.pin(a.run, a.runs_root, a.name))
    elif a.command == "leaderboard":
        names = a.metric or HEADLINE
        if a.out:
            manifest.write_leaderboard(a.runs_root, a.out, a.dataset, names)
        for m in reversed(manifest.list_runs(a.runs_root, True)):
            print(json.dumps(manifest.board_row(m, a.dataset, names)))
    elif a.command == "index":
        _index(a)
    elif a.command == "run":
        _show(_experiment(a)[1])
    elif a.command == "gate":
        cfg, this = (config.load(a.config, a.set), manifest.load_run(a.run, a.runs_root)) if a.run else _experiment(a)
        base = manifest.baseline(a.dataset, a.baseline or a.runs_root / "baseline.json", a.runs_root)
        rows = gate_rows(this, base, cfg, a.dataset)
        table = gate_markdown(a.dataset, rows)
        print(table)
        if a.summary_out:
            with a.summary_out.open("a", encoding="utf-8") as out:
                print(table, file=out)
        return int(any(r["verdict"] == "FAIL" for r in rows))
    else:
        _session_of(a, _typed() if lines is None else lines)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
