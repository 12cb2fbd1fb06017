"""The chunk store: chunks and vectors of a source and embedder as a base and deltas, in buckets by id, under a log of commits.

An upsert writes the rows that are new or differ, and nothing else; one that
changes nothing makes no commit. A reader takes the newest row of every id: those
of the base that no delta has, and of the deltas the last. Only new content is
embedded, and only the buckets of the ids at hand are read for what is stored.
After ``COMPACT_AFTER`` deltas all are merged into a new base. What a change of
the corpus alone says (its sha, the time) is a commit without rows.

Commits are numbered files that are never written over, each with the whole
state, so readers see a commit or not. A writer that finds its number taken
deletes what it wrote and begins again from the new state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from quarry.functions.text import fake_embedding, model_slug
from quarry.operators.dense import assert_embedder
from quarry.sources.log import CommitLog

BUCKETS = 8  # at first; compactions make more of them as the store grows
COMPACT_AFTER = 16
BUCKET_BYTES = 256 << 20  # of a bucket, about, before a compaction makes more of them
ATTEMPTS = 20
BUCKET, GONE, NTH, SPLIT = "__bucket", "__gone", "__nth", "__split"
IDENTITY = ("embedding_model", "embedding_dim", "corpus_sha", "created_at")


class ChunkStore:
    """``root``/``source``__``slug``/ holds the log and the base and deltas that its commits name."""

    def __init__(self, spark: SparkSession, root: str, model: str = "fake", dim: int = 8, embed: Callable = fake_embedding, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
        self.spark, self.root, self.model, self.dim, self.embed = spark, root.rstrip("/"), model, dim, embed
        self.buckets, self.compact_after = buckets, compact_after

    def place(self, source: str) -> str:
        return f"{self.root}/{source}__{model_slug(self.model)}"

    def log(self, source: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.place(source)}/log")

    def _state(self, source: str) -> tuple[int, dict | None]:
        """The newest commit, checked against this store's embedder; none where the source is new."""
        number, state = self.log(source).newest()
        if state is not None:
            assert_embedder(state, self.model, self.dim)
        return number, state

    def identity(self, source: str) -> dict | None:
        state = self._state(source)[1]
        return None if state is None else {k: state[k] for k in IDENTITY} | {"version": state["commit"]}

    def _segment(self, source: str, segment: dict, buckets: list[int] | None) -> DataFrame:
        df = self.spark.read.schema(StructType.fromJson(segment["kinds"])).parquet(f"{self.place(source)}/{segment['name']}")
        return df if buckets is None else df.where(F.col(BUCKET).isin(buckets) if buckets else F.lit(False))

    def _current(self, source: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """The newest row of every id, of some buckets only: their folders are all that is read."""
        base = self._segment(source, state["base"], buckets).drop(BUCKET)
        if not state["deltas"]:
            return base
        deltas = None
        for n, d in enumerate(state["deltas"]):  # COMPACT_AFTER at most
            part = self._segment(source, d, buckets).drop(BUCKET).withColumn(NTH, F.lit(n))
            deltas = part if deltas is None else deltas.unionByName(part, allowMissingColumns=True)
        last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc(NTH)))
        newest = deltas.withColumn("__last", last).where("__last = 1").drop("__last", NTH)
        kept = base.join(newest.select("chunk_id"), "chunk_id", "left_anti")
        return kept.unionByName(newest.where(f"not {GONE}").drop(GONE), allowMissingColumns=True)

    def read(self, source: str) -> DataFrame:
        state = self._state(source)[1]
        if state is None:
            raise FileNotFoundError(f"no chunks of {source!r} for {self.model!r}")
        return self._current(source, state)

    def _dealt(self, rows: DataFrame, buckets: int) -> tuple[DataFrame, list[str]]:
        """Rows dealt to their buckets, large ones to several tasks, and the columns that group them by id: windows over these and the write that follows need no further shuffle."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # Spark puts small buckets together
        split = F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(max(1, tasks // buckets)))
        placed = rows.withColumns({BUCKET: F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int"), SPLIT: split})
        return placed.repartition(BUCKET, SPLIT), [BUCKET, SPLIT, "chunk_id"]

    def _write(self, source: str, rows: DataFrame, buckets: int) -> dict:
        """Rows as a new segment, its buckets in folders of their own; what ``_dealt`` has dealt stays so."""
        name = f"s-{uuid.uuid4().hex}"
        dealt = rows if BUCKET in rows.columns else self._dealt(rows, buckets)[0]
        placed = dealt.select(*(c for c in dealt.columns if c not in (BUCKET, SPLIT)), BUCKET)
        placed.write.partitionBy(BUCKET).parquet(f"{self.place(source)}/{name}")
        return {"name": name, "kinds": json.loads(placed.schema.json())}

    def _stored(self, source: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """All rows of base and deltas with ``NTH``, -1 for the base, and ``GONE``."""
        rows = self._segment(source, state["base"], buckets).drop(BUCKET).withColumns({NTH: F.lit(-1), GONE: F.lit(False)})
        for n, d in enumerate(state["deltas"]):  # COMPACT_AFTER at most
            rows = rows.unionByName(self._segment(source, d, buckets).drop(BUCKET).withColumn(NTH, F.lit(n)), allowMissingColumns=True)
        return rows

    def _described(self, state: dict | None, corpus_sha: str) -> dict:
        now = datetime.now(UTC).isoformat()
        return {"embedding_model": self.model, "embedding_dim": self.dim, "corpus_sha": corpus_sha or (state or {}).get("corpus_sha") or "", "created_at": now, "buckets": (state or {}).get("buckets", self.buckets)}

    def _committed(self, source: str, change: Callable[[dict | None], dict | None]) -> bool:
        """Makes a commit of what ``change`` makes of the newest state; false where it makes none.

        Segments that a lost attempt has written are deleted."""
        for _ in range(ATTEMPTS):
            number, state = self._state(source)
            new = change(state)
            if new is None:
                return False
            if self.log(source).commit(number + 1, new):
                return True
            known = [] if state is None else [state["base"], *state["deltas"]]
            for segment in (new["base"], *new["deltas"]):
                if segment not in known:
                    self.log(source).files.delete(f"{self.place(source)}/{segment['name']}")
        raise RuntimeError(f"{ATTEMPTS} writers came first")

    def upsert(self, chunks: DataFrame, source: str, corpus_sha: str = "", keep_missing: bool = True, order: str | None = None) -> bool:
        """Writes chunks (chunk_id, document, content_hash, ...) by id; only new content is embedded. False where nothing differs.

        Of rows with one id that with the greatest content_hash counts, or the last by ``order``.
        ``keep_missing`` keeps stored chunks that are not among these."""
        greatest = [*([order] if order else []), "content_hash", "document"]

        def change(state: dict | None) -> dict | None:
            if state is None:
                dealt, by = self._dealt(chunks, self.buckets)
                first = dealt.withColumn(NTH, F.row_number().over(Window.partitionBy(*by).orderBy(*map(F.desc, greatest)))).where(f"{NTH} = 1").drop(NTH)
                return self._described(None, corpus_sha) | {"base": self._write(source, first.withColumn("embedding", self.embed(F.col("document"))), self.buckets), "deltas": []}
            buckets = None
            if keep_missing:
                touched = chunks.select(F.pmod(F.xxhash64("chunk_id"), F.lit(state["buckets"])).cast("int").alias("b")).distinct()
                buckets = sorted(r.b for r in touched.collect())  # as many as there are buckets, at most
            # what is stored meets the chunks with a digest in place of its text
            digest = lambda text: F.unhex(F.sha2(text, 256))
            stored = self._stored(source, state, buckets).withColumn("document", digest(F.col("document")))
            names = [c for c in stored.columns if c not in ("chunk_id", NTH, GONE)]
            old = stored.select("chunk_id", NTH, F.struct(*names, GONE).alias("__old"))
            new = chunks.select("chunk_id", F.lit(len(state["deltas"])).alias(NTH), F.struct(*(c for c in chunks.columns if c != "chunk_id")).alias("__new"))
            dealt, by = self._dealt(new.unionByName(old, allowMissingColumns=True), state["buckets"])
            own = Window.partitionBy(*by).orderBy(F.desc(NTH), *(F.desc(f"__new.{c}") for c in greatest))
            whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            both = dealt.withColumns({"__first": F.row_number().over(own), "__old": F.first("__old", ignorenulls=True).over(whole)}).where("__first = 1")
            given = [c for c in chunks.columns if c != "chunk_id"]
            has = F.col("__old").isNotNull() & ~F.col(f"__old.{GONE}")
            ours = F.col("__new").isNotNull()
            same = has
            for c in names:
                if c in given:
                    mine = F.col(f"__new.{c}")
                    same = same & F.col(f"__old.{c}").eqNullSafe(digest(mine) if c == "document" else mine)
            for c in given:
                if c not in names:
                    same = same & F.col(f"__new.{c}").isNull()
            out = both.where((ours & ~same) if keep_missing else F.when(ours, ~same).otherwise(has))
            columns = [F.col(f"__new.{c}").alias(c) for c in given]
            if "embedding" not in given:
                vector = F.when(has & F.col("__old.content_hash").eqNullSafe(F.col("__new.content_hash")), F.col("__old.embedding"))
                columns.append(F.when(ours, vector.otherwise(self.embed(F.col("__new.document")))).alias("embedding"))
            delta = self._write(source, out.select("chunk_id", *columns, (~ours).alias(GONE), BUCKET), state["buckets"])
            if not self._segment(source, delta, None).take(1):
                self.log(source).files.delete(f"{self.place(source)}/{delta['name']}")
                if not corpus_sha or corpus_sha == state["corpus_sha"]:
                    return None
                return state | self._described(state, corpus_sha)
            return state | self._described(state, corpus_sha) | {"deltas": [*state["deltas"], delta]}

        changed = self._committed(source, change)
        if changed and len(self._state(source)[1]["deltas"]) >= self.compact_after:
            self.compact(source)
        return changed

    def refresh(self, source: str, corpus_sha: str) -> bool:
        """The corpus has a new sha and the chunks stay: a commit without rows. False where the sha is known."""

        def change(state: dict | None) -> dict | None:
            if state is None:
                raise FileNotFoundError(f"no chunks of {source!r} for {self.model!r}")
            return None if state["corpus_sha"] == corpus_sha else state | self._described(state, corpus_sha)

        return self._committed(source, change)

    def compact(self, source: str) -> bool:
        """Merges base and deltas into a new base; the old ones stay until ``vacuum``, for those who read them."""

        def change(state: dict | None) -> dict | None:
            if state is None or not state["deltas"]:
                return None
            size = sum(self.log(source).files.bytes(f"{self.place(source)}/{s['name']}") for s in (state["base"], *state["deltas"]))
            buckets = max(state["buckets"], size // BUCKET_BYTES)
            dealt, by = self._dealt(self._stored(source, state), buckets)
            newest = dealt.withColumn("__rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(NTH)))).where(f"__rank = 1 and not {GONE}")
            return state | {"base": self._write(source, newest.drop("__rank", NTH, GONE), buckets), "deltas": [], "buckets": buckets}

        return self._committed(source, change)

    def vacuum(self, source: str) -> int:
        """Deletes segments that the newest commit does not name; how many. Nobody may be reading or writing them."""
        state, files = self._state(source)[1], self.log(source).files
        named = {s["name"] for s in (state["base"], *state["deltas"])} if state else set()
        gone = [n for n in files.names(self.place(source)) if n.startswith("s-") and n not in named]
        for n in gone:
            files.delete(f"{self.place(source)}/{n}")
        return len(gone)

    def stored_bytes(self, source: str) -> list[int]:
        """Bytes of the base and of each delta."""
        state = self._state(source)[1]
        return [self.log(source).files.bytes(f"{self.place(source)}/{s['name']}") for s in (state["base"], *state["deltas"])] if state else []

    def migrate(self, old: str, source: str, model: str, dim: int, corpus_sha: str = "") -> bool:
        """A table that an earlier layout kept at ``old`` becomes this store's table of ``source``; vectors stay as they are.

        What its identity lacks is filled in. False where there is nothing at ``old`` or the source is there already."""
        assert_embedder({"embedding_model": model, "embedding_dim": dim}, self.model, self.dim)
        if self._state(source)[1] is not None:
            return False
        try:
            rows = self.spark.read.parquet(old)
        except AnalysisException:
            return False
        return self._committed(source, lambda state: None if state is not None else self._described(None, corpus_sha) | {"base": self._write(source, rows, self.buckets), "deltas": []})

    def get(self, source: str, ids: list[str]) -> DataFrame:
        """The rows of these ids, from their buckets."""
        state = self._state(source)[1]
        if state is None:
            raise FileNotFoundError(f"no chunks of {source!r} for {self.model!r}")
        at = self.spark.createDataFrame([(i,) for i in ids], "chunk_id string").select(F.pmod(F.xxhash64("chunk_id"), F.lit(state["buckets"])).cast("int").alias("b")).distinct()
        return self._current(source, state, sorted(r.b for r in at.collect())).where(F.col("chunk_id").isin(*ids))

    def family(self, source: str, parent_id: str) -> DataFrame:
        return self.read(source).where(F.col("parent_id") == parent_id)

    def profile(self, source: str) -> DataFrame:
        """column, kind, n_null: what the stored rows hold."""
        df = self.read(source)
        counts = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns))
        kinds = dict(df.dtypes)
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col(c).alias("n_null")) for c in df.columns)))
        return counts.select(rows.alias("r")).select("r.*")

    def readiness(self, sources: list[str]) -> dict[str, str]:
        """For each source ok, or why it cannot be searched."""
        out = {}
        for s in sources:
            try:
                out[s] = "ok" if self.read(s).take(1) else "empty"
            except Exception as why:  # noqa: BLE001  the report is the result
                out[s] = str(why).splitlines()[0]
        return out
