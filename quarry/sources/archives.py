"""Pinned archives as tables of texts: an index pass, then members read by many tasks.

The index pass reads names and places only, a task for each archive: tar headers
by seeking over contents, a zip's directory. Members are then dealt to tasks by
size and read at their places. A compressed tar has no places; its members are
read in one go by one task, which many archives share out. Names that lead out
of the archive are refused, whatever else is asked for."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a documentation corpus takes of an archive, folders and their suffixes.
WANTED = (("docs", ".md"), ("docs_src", ".py"))
MEMBER = "archive string, kind string, member string, path string, at long, size long"
TASK_BYTES = 64 << 20  # of members that a task reads, about
_KINDS = {".tar": "tar", ".zip": "zip", ".tgz": "stream", ".tar.gz": "stream", ".tar.bz2": "stream", ".tar.xz": "stream"}


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def kind_of(name: str) -> str | None:
    return next((k for suffix, k in _KINDS.items() if name.lower().endswith(suffix)), None)


def relative(member: str, strip: int) -> PurePosixPath | None:
    """The member's name without its first ``strip`` folders; none where nothing is left. Names that lead out are refused."""
    name = PurePosixPath(member.replace("\\", "/"))
    if name.is_absolute() or ".." in name.parts or (name.parts and ":" in name.parts[0]):
        raise ValueError(f"{member!r} leads out of the archive")
    return PurePosixPath(*name.parts[strip:]) if len(name.parts) > strip else None


def _listed(data, kind: str) -> Iterator[tuple[str, int, int]]:
    """Name, place and size of each file in an archive."""
    if kind == "zip":
        with zipfile.ZipFile(data) as z:
            yield from ((i.filename, i.header_offset, i.file_size) for i in z.infolist() if not i.is_dir())
        return
    with tarfile.open(fileobj=data, mode="r:" if kind == "tar" else "r|*") as tar:
        yield from ((m.name, m.offset_data, m.size) for m in tar if m.isfile())


def index(spark: SparkSession, folder: str, wanted: tuple[tuple[str, str], ...] | None = WANTED, strip: int = 1) -> DataFrame:
    """``MEMBER`` rows of the archives in ``folder``: files below the given folders with the given suffixes, or all.

    ``path`` is the name without its first ``strip`` folders."""
    system, root = _opened(folder)
    scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ""
    found = [(f"{scheme}{f.path}", kind_of(f.base_name)) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and kind_of(f.base_name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, path = _opened(archive)
                rows = []
                with own.open_input_file(path) as data:
                    for name, at, size in _listed(data, kind):
                        left = relative(name, strip)
                        if left is not None and (wanted is None or any(left.parts[0] == top and left.suffix == suffix for top, suffix in wanted)):
                            rows.append((archive, kind, name, str(left), at, size))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k > 3 else pa.string()) for k in range(6)], names=[c.split()[0] for c in MEMBER.split(", ")])

    listed = spark.createDataFrame(found, "archive string, kind string")
    return listed.repartition(max(1, min(len(found), 10_000)), "archive").mapInArrow(run, MEMBER)


def texts(members: DataFrame) -> DataFrame:
    """archive, path, text of ``index`` rows; bytes that are no UTF-8 are replaced. ``members`` is read twice: write it where it is dear."""
    total = members.agg(F.sum("size").alias("n"), F.count("*").alias("files")).first()
    tasks = max(1, min(total.files or 1, -(-(total.n or 0) // TASK_BYTES)), min(total.files or 1, 2 * members.sparkSession.sparkContext.defaultParallelism))
    unit = F.when(F.col("kind") == "stream", F.xxhash64("archive")).otherwise(F.xxhash64("archive", F.expr("at div 4194304")))
    dealt = members.repartition(tasks, unit).sortWithinPartitions("archive", "at")

    def read(archive: str, kind: str, wanted: list[tuple[str, str, int, int]]) -> Iterator[tuple[str, str, str]]:
        system, path = _opened(archive)
        decoded = lambda raw: raw.decode("utf-8", "replace")
        with system.open_input_file(path) as data:
            if kind == "tar":
                for _, name, at, size in wanted:
                    data.seek(at)
                    yield archive, name, decoded(data.read(size))
            elif kind == "zip":
                with zipfile.ZipFile(data) as z:
                    yield from ((archive, name, decoded(z.read(member))) for member, name, _, _ in wanted)
            else:
                of = {(member, at): name for member, name, at, _ in wanted}
                with tarfile.open(fileobj=data, mode="r|*") as tar:
                    yield from ((archive, of[m.name, m.offset_data], decoded(tar.extractfile(m).read())) for m in tar if (m.name, m.offset_data) in of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wanted = None, []

        def given() -> Iterator[pa.RecordBatch]:
            for row in read(*key, wanted) if wanted else ():
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in row], names=["archive", "path", "text"])

        for b in batches:
            for archive, kind, member, path, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (archive, kind):
                    yield from given()
                    key, wanted = (archive, kind), []
                wanted.append((member, path, at, size))
        yield from given()

    return dealt.mapInArrow(run, "archive string, path string, text string")


def write(pages: DataFrame, folder: str, n: int, top: str = "corpus", compressed: bool = False) -> DataFrame:
    """Writes ``pages`` (path, text) as ``n`` tar archives, a task each, their names below ``top``; gives archive, files. A task that runs again writes the same file."""
    suffix = "tar.gz" if compressed else "tar"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}.{suffix}"
        system, root = _opened(folder)
        system.create_dir(root, recursive=True)
        files = 0
        with system.open_output_stream(f"{root}/{name}.new", compression=None) as out, tarfile.open(fileobj=out, mode="w|gz" if compressed else "w|") as tar:
            for b in batches:
                for path, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = text.as_py().encode() if text.is_valid else b""
                    member = tarfile.TarInfo(f"{top}/{path}")
                    member.size = len(raw)
                    tar.addfile(member, io.BytesIO(raw))
                    files += 1
        system.move(f"{root}/{name}.new", f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([files], pa.int64())], names=["archive", "files"])

    return pages.select("path", "text").repartition(n, "path").sortWithinPartitions("path").mapInArrow(run, "archive string, files long")
