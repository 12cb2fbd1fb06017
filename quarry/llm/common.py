"""What the operators of this package share: the shared folder, written tables, word bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts, ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent, a temporary folder stands in on a single
    machine (master ``local``); a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _fallback[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    This cuts lineage: lost executors cost at most the stages since the last table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of one run of an operator. Those that its result no longer reads can be deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (path, table)
        return table

    def remove(self, *gone: DataFrame | None) -> None:
        """Deletes those of ``gone`` that are tables of this run."""
        for t in gone:
            if t is not None and id(t) in self.paths:
                delete(self.spark, self.paths.pop(id(t))[0])

    def drop(self, *keep: DataFrame) -> None:
        """Deletes all tables but ``keep``."""
        kept = {id(t) for t in keep}
        for key in [k for k in self.paths if k not in kept]:
            delete(self.spark, self.paths.pop(key)[0])


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, drop: Callable[[], None]) -> None:
    """In a worker process: ``owner`` keeps a table from task to task; ``drop`` empties it."""
    _held[owner] = drop


def release(owner: str = "") -> None:
    """At the start of a task: tables that other operators' tasks have left in this worker go, and freed memory with them."""
    others = [k for k in _held if k != owner]
    for k in others:
        _held.pop(k)()
    if others:
        trim()


def trim() -> None:
    """Hands freed memory back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` alone is right, and quicker, for pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


_LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_TABLE)


def raw_bytes(value: pa.Scalar) -> memoryview | bytes:
    """UTF-8 of a string or binary scalar, not copied; null is empty."""
    return memoryview(value.as_buffer()) if value.is_valid else b""


def lowered(raw: memoryview | bytes) -> bytes:
    return bytes(raw).translate(_LOWER_TABLE)


SLICE = 1 << 20  # bytes of a text that are cut into words together
#: A-Z to a-z; what is no ASCII letter or digit, and not beyond ASCII, to a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def cut_words(raw: memoryview | bytes) -> Iterator[list[bytes]]:
    """The words of a text's bytes, runs of ASCII letters, digits and all that is not ASCII, A-Z lower-cased, slice by slice."""
    rest: list[bytes] = []
    for at in range(0, len(raw), SLICE):
        part = bytes(raw[at : at + SLICE]).translate(_WORDS)
        cut = part.rfind(b" ")
        if cut < 0:
            rest.append(part)
            continue
        yield (b"".join(rest) + part[:cut]).split()
        rest = [part[cut + 1 :]]
    yield b"".join(rest).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def parts_for(rows: int, per_part: int, least: int) -> int:
    """Number of partitions that hold about ``per_part`` rows each."""
    return max(least, -(-rows // per_part))
