"""The draws of Python's seeded generator as a Spark data source.

    draws.read(spark, sizes=[64, 128], resamples=1000, seed=0)

For each size the rows (size, b, place, c) tell how often resample ``b`` of
``size`` values takes the one at ``place``, as ``random.Random(seed)`` draws them
with ``randrange(size)``, one after another over all resamples.

The generator cannot be entered in the middle, so its states are kept: the
planner walks through it once, some nanoseconds a word, and each block of
``BLOCK`` words is a partition that begins at a kept state (2.5 KB) and knows how
many draws lie before it. Tasks make the draws of their block and count them."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 18  # words of a partition
ROWS = pa.schema([("size", pa.int64()), ("b", pa.int64()), ("place", pa.int64()), ("c", pa.int64())])


@dataclass
class Words(InputPartition):
    """Words of the generator from a state on; ``first`` draws lie before them."""

    size: int
    key: bytes
    pos: int
    first: int
    words: int


def _at(key: bytes, pos: int) -> np.random.MT19937:
    generator = np.random.MT19937()
    generator.state = {"bit_generator": "MT19937", "state": {"key": np.frombuffer(key, np.uint32), "pos": pos}}
    return generator


def _draws(generator: np.random.MT19937, words: int, size: int) -> np.ndarray:
    """Places below ``size``: a word's leading bits, as many as the size has; what is too large is passed over."""
    tried = generator.random_raw(words) >> np.uint64(32 - size.bit_length())
    return tried[tried < size]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.sizes, self.seed = sorted(set(json.loads(options["sizes"]))), int(options.get("seed", 0))
        self.n, self.block = int(options.get("resamples", 1000)), int(options.get("block", BLOCK))
        if any(not 0 < s < 1 << 32 for s in self.sizes):
            raise ValueError("sizes lie between 1 and 2**32 - 1: a draw is one word")

    def partitions(self) -> list[InputPartition]:
        out = []
        for size in self.sizes:
            *key, pos = random.Random(self.seed).getstate()[1]
            generator, first = _at(np.array(key, np.uint32).tobytes(), pos), 0
            while first < self.n * size:
                state = generator.state["state"]
                out.append(Words(size, state["key"].tobytes(), int(state["pos"]), first, self.block))
                first += len(_draws(generator, self.block, size))
        return out or [Words(0, b"", 0, 0, 0)]

    def read(self, partition: Words) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        size = partition.size
        places = _draws(_at(partition.key, partition.pos), partition.words, size).astype(np.int64)[: self.n * size - partition.first]
        resample = (partition.first + np.arange(len(places))) // size
        taken, c = np.unique(resample * size + places, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(taken), size), taken // size, taken % size, c)], schema=ROWS)


class Draws(DataSource):
    """Options: sizes (a JSON list), seed, resamples, block (words of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "seeded_draws"

    def schema(self) -> str:
        return "size long, b long, place long, c long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, sizes: list[int], resamples: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """size, b, place, c; a place that two blocks draw for one resample has a row of each."""
    spark.dataSource.register(Draws)
    return spark.read.format("seeded_draws").option("sizes", json.dumps(sizes)).option("resamples", resamples).option("seed", seed).option("block", block).load()
