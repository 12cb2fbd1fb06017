"""Paged discussions as a Spark data source, for batches and for streams.

    spark.dataSource.register(Discussions)
    spark.read.format("discussions").option("transport", "package.module:Factory").option("folder", ...).load()

The transport is named, so that tasks can make their own: called with all
options it gives an object with ``feeds()``, ``latest(feed)`` and ``page(feed,
after)``. A page is what a service replies: a status and {"nodes": [...],
"cursor": where it ends, "more": whether there is another}. Feeds are read side
by side, a task each; the pages of one follow its cursors. A service that is
busy, fails or is out of reach is asked again from the task.

A stream's offset is the cursor of every feed. A batch reads each feed from the
cursor that the last one ended at to the feed's latest one, so a restart goes on
at the stored cursors and a batch that is run again reads the same pages."""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.json as paj
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarry.sources.fetch import TRIES, persistent

KINDS = "id string, title string, bodyText string, url string, answer struct<bodyText: string>, category struct<name: string>"
NODE = pa.schema([("id", pa.string()), ("title", pa.string()), ("bodyText", pa.string()), ("url", pa.string()), ("answer", pa.struct([("bodyText", pa.string())])), ("category", pa.struct([("name", pa.string())]))])


class Transport(Protocol):
    def feeds(self) -> list[str]: ...

    def latest(self, feed: str) -> str | None:
        """The cursor behind the feed's last page; none where it has no page."""

    def page(self, feed: str, after: str | None) -> tuple[int, dict]:
        """Status and page behind a cursor, the first one behind none."""


class FolderPages:
    """Pages that lie in a folder as feed=F/page=N/, nodes in lines of JSON: a service's replies, kept. Cursors are page numbers."""

    def __init__(self, options: dict[str, str]):
        self.fs, self.folder = fs.FileSystem.from_uri(options["folder"])

    def _numbers(self, at: str, key: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return [f.base_name.removeprefix(f"{key}=") for f in found if f.base_name.startswith(f"{key}=")]

    def feeds(self) -> list[str]:
        return sorted(self._numbers(self.folder, "feed"))

    def latest(self, feed: str) -> str | None:
        pages = [int(n) for n in self._numbers(f"{self.folder}/feed={feed}", "page")]
        return str(max(pages)) if pages else None

    def page(self, feed: str, after: str | None) -> tuple[int, dict]:
        number, last = 0 if after is None else int(after) + 1, self.latest(feed)
        if last is None or number > int(last):
            return 200, {"nodes": [], "cursor": after, "more": False}
        nodes: list[dict] = []
        for f in self.fs.get_file_info(fs.FileSelector(f"{self.folder}/feed={feed}/page={number}")):
            if f.size and not f.base_name.startswith(("_", ".")):
                with self.fs.open_input_stream(f.path) as stream:
                    nodes += paj.read_json(stream, parse_options=paj.ParseOptions(explicit_schema=NODE, newlines_in_values=False), read_options=paj.ReadOptions(block_size=max(1 << 20, f.size))).select(NODE.names).to_pylist()
        return 200, {"nodes": nodes, "cursor": str(number), "more": number < int(last)}


def transport(options: dict[str, str]) -> Transport:
    module, _, name = options.get("transport", f"{__name__}:FolderPages").partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


@dataclass
class Feed(InputPartition):
    """Pages of a feed behind one cursor, up to and with the one that ends at another; to the end where that is none."""

    name: str
    after: str | None
    until: str | None


def pages(options: dict[str, str], feed: Feed) -> Iterator[pa.RecordBatch]:
    """A batch for each page, in order; ``tries`` and ``wait`` (seconds that the first pause takes) say how a service is asked again."""
    service = transport(options)
    tries, unit, most = int(options.get("tries", TRIES)), float(options.get("wait", 1.0)), int(options.get("max_pages", 0))
    after, n = feed.after, 0
    while not most or n < most:
        page = persistent(lambda asked: service.page(feed.name, asked["after"]), {"after": after}, tries, lambda seconds: time.sleep(unit * seconds))
        if page["nodes"]:
            yield pa.RecordBatch.from_pylist([{c: node.get(c) for c in NODE.names} for node in page["nodes"]], NODE)
        after, n = page["cursor"], n + 1
        if not page["more"] or (feed.until is not None and after == feed.until):
            return


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [Feed(name, None, None) for name in transport(self.options).feeds()] or [Feed("", None, None)]

    def read(self, partition: Feed) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from pages(self.options, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        service = transport(self.options)
        return {feed: last for feed in service.feeds() if (last := service.latest(feed)) is not None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Feed(name, start.get(name), last) for name, last in sorted(end.items()) if start.get(name) != last]

    def read(self, partition: Feed) -> Iterator[pa.RecordBatch]:
        yield from pages(self.options, partition)

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offset; a service keeps nothing."""


class Discussions(DataSource):
    """Options: transport, tries, wait, max_pages (of each feed, batches only), and those of the transport."""

    @classmethod
    def name(cls) -> str:
        return "discussions"

    def schema(self) -> str:
        return KINDS

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream({k: v for k, v in self.options.items() if k.lower() != "max_pages"})
