"""Human verdicts on evaluation items, as tables of decisions; a session writes such a table line by line."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.synth import stratified_sample


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The latest decision on each item (item_id, decision, edited_question, decided_at)."""
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("decided_at")))
    return decisions.withColumn("nth", nth).where("nth = 1").drop("nth")


def apply_reviews(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """``items`` (item_id, question, verified, verified_at) with decisions y, n, e; s and none leave them.

    Another letter, or an edit without a question, is an error."""
    d = last_decisions(decisions).withColumnRenamed("item_id", "__id")
    letter = F.col("decision")
    known = F.when(letter.isNull() | letter.isin("y", "n", "s") | ((letter == "e") & (F.coalesce("edited_question", F.lit("")) != "")), letter).otherwise(F.raise_error(F.concat(F.lit("cannot apply decision "), letter)))
    out = items.join(d, items["item_id"] == d["__id"], "left").withColumn("__letter", known)
    verdict = F.when(F.col("__letter") == "y", "yes").when(F.col("__letter") == "n", "no").when(F.col("__letter") == "e", "edited")
    return out.withColumns(
        {
            "question": F.when(F.col("__letter") == "e", F.col("edited_question")).otherwise(F.col("question")),
            "verified": F.coalesce(verdict, F.col("verified")),
            "verified_at": F.when(verdict.isNotNull(), F.col("decided_at")).otherwise(F.col("verified_at")),
        }
    ).select(*items.columns)


def apply_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """``items`` (item_id, gold_urls, verified, verified_at) with raw labels (item_id, raw, decided_at): URLs between commas, or n."""
    raw = F.trim("raw")
    urls = F.filter(F.transform(F.split(raw, ","), lambda u: F.trim(u)), lambda u: u != "")
    parsed = labels.select(
        F.col("item_id").alias("__id"),
        F.when(F.lower(raw) == "n", F.array().cast("array<string>")).when(F.size(urls) > 0, urls).otherwise(F.raise_error(F.lit("expected URLs between commas, or n"))).alias("__urls"),
        F.when(F.lower(raw) == "n", F.lit("no")).otherwise(F.lit("yes")).alias("__verdict"),
        F.col("decided_at").alias("__at"),
    )
    out = items.join(parsed, items["item_id"] == parsed["__id"], "left")
    return out.withColumns({"gold_urls": F.coalesce("__urls", "gold_urls"), "verified": F.coalesce("__verdict", "verified"), "verified_at": F.coalesce("__at", "verified_at")}).select(*items.columns)


# Sessions: prompts make a journal of decisions, and the folds above make items of it.

JOURNAL = "item_id string, kind string, decision string, edited_question string, raw string, decided_at string"


def to_review(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """What of a stratified sample of ``items`` (item_id, question, gold_urls, verified) has no verdict: place, item_id, question, url."""
    first = F.get("gold_urls", F.lit(0))
    rows = items.select("item_id", "question", "verified", F.coalesce(first, F.lit("")).alias("url"), F.coalesce(T.url_section(first), F.lit("_root")).alias("section"))
    return stratified_sample(rows, n, "item_id", seed=seed).where("verified is null").select("place", "item_id", "question", "url")


def journalled(rows: Iterable[Row], lines: Iterator[str], parse: Callable[[str], dict | None], show: Callable[[Row], None]) -> Iterator[dict]:
    """A row of the journal for each shown row whose line ``parse`` understands; the journal ends with the lines, or with q."""
    for row in rows:
        show(row)
        line = next(lines, "q").strip()
        if line.lower() == "q":
            return
        entry = parse(line)
        if entry is not None:
            yield {"item_id": row["item_id"], "decided_at": datetime.now(UTC).isoformat(), **entry}


def review_entry(line: str) -> dict | None:
    """``y``, ``n``, ``s``, or ``e`` and the question that is to stand, as an entry; none where it is something else."""
    letter, _, question = line.partition(" ")
    letter, question = letter.lower(), question.strip()
    if letter in ("y", "n", "s") and not question:
        return {"kind": "review", "decision": letter}
    return {"kind": "review", "decision": "e", "edited_question": question} if letter == "e" and question else None


def label_entry(line: str) -> dict | None:
    """Addresses between commas, or ``n``; none where there is no address."""
    return {"kind": "label", "raw": line} if line.strip(" ,") else None


def from_journal(items: DataFrame, journal: DataFrame) -> DataFrame:
    """``items`` after all decisions of ``journal`` (``JOURNAL``), reviews before labels."""
    latest = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("decided_at")))
    labels = journal.where("kind = 'label'").withColumn("nth", latest).where("nth = 1").select("item_id", "raw", "decided_at")
    reviews = journal.where("kind = 'review'").select("item_id", "decision", "edited_question", "decided_at")
    return apply_labels(apply_reviews(items, reviews), labels)
