"""Index builds: a corpus in files to chunks in a store, each source one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import chunking, markdown
from quarry.sources import files
from quarry.sources.store import ChunkStore

NO_SNIPPETS = "path string, content string"


@dataclass(frozen=True)
class Places:
    """Where a corpus lies: a folder of pages, one of the code they take in, a file of discussions."""

    docs: str | None = None
    snippets: str | None = None
    discussions: str | None = None
    base_url: str = ""


def page_chunks(spark: SparkSession, at: Places) -> DataFrame:
    snippets = files.read_snippets(spark, at.snippets) if at.snippets else spark.createDataFrame([], NO_SNIPPETS)
    return chunking.doc_chunks(markdown.normalize(files.read_pages(spark, at.docs), snippets), at.base_url)


def discussion_chunks(spark: SparkSession, at: Places) -> DataFrame:
    return chunking.qa_chunks(files.read_discussions(spark, at.discussions))


def _sources(spark: SparkSession, at: Places) -> dict[str, DataFrame]:
    made = {"docs": page_chunks(spark, at) if at.docs else None, "discussions": discussion_chunks(spark, at) if at.discussions else None}
    return {source: chunks for source, chunks in made.items() if chunks is not None}


def corpus(spark: SparkSession, at: Places, sources: list[str]) -> DataFrame | None:
    """Chunks of the corpus itself, which gold is resolved against whatever a store holds; none where it has none of the sources."""
    out = None
    for source, chunks in _sources(spark, at).items():
        if source in sources:
            out = chunks if out is None else out.unionByName(chunks)
    return out


def build(spark: SparkSession, store: ChunkStore, at: Places, sha: str = "") -> dict[str, int]:
    """Brings each source of ``store`` to the corpus: chunks that are gone go, only new content is embedded. How many chunks each has then."""
    out = {}
    for source, chunks in _sources(spark, at).items():
        store.upsert(chunks, source, sha, keep_missing=False)
        out[source] = store.read(source).count()
    return out
