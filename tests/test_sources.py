"""Paged discussions and archives as sources."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import archives, discussions, fetch, files
from quarry.sources.discussions import Discussions


class Flaky(discussions.FolderPages):
    """A service that is busy on the first request for each page of each task, and refuses one feed for good where it is told to."""

    def __init__(self, options):
        super().__init__(options)
        self.seen, self.refused = set(), options.get("refused")

    def page(self, feed, after):
        if feed == self.refused:
            return 404, {}
        if (feed, after) not in self.seen:
            self.seen.add((feed, after))
            if after == "0":
                raise fetch.TransportError("gone")
            return (403 if after is None else 502), {}
        return super().page(feed, after)


def put(folder, feed, number, ids):
    at = folder / f"feed={feed}" / f"page={number}"
    at.mkdir(parents=True)
    node = lambda i: {"id": i, "title": f"t{i}", "bodyText": "q", "url": f"u{i}", "answer": {"bodyText": f"a{i}"} if not i.endswith("x") else None, "category": {"name": "c"} if i < "m" else None}
    (at / "part-0.json").write_text("".join(json.dumps(node(i)) + "\n" for i in ids))
    (at / "_SUCCESS").write_text("")


@pytest.fixture
def service(spark, tmp_path):
    spark.dataSource.register(Discussions)
    folder = tmp_path / "pages"
    for feed, pages in {"one": [["a", "bx"], ["c"], ["d", "e"]], "two": [["z"]], "none": []}.items():
        (folder / f"feed={feed}").mkdir(parents=True)
        for n, ids in enumerate(pages):
            put(folder, feed, n, ids)
    return folder


def read(spark, folder, **options):
    return spark.read.format("discussions").options(folder=f"file://{folder}", transport="tests.test_sources:Flaky", wait="0", **options).load()


def test_pages_are_asked_for_again(spark, service):
    rows = read(spark, service)
    assert sorted(r.id for r in rows.collect()) == ["a", "bx", "c", "d", "e", "z"]
    assert sorted(map(tuple, files.answered(rows).select("discussion_id", "answer_body", "category").collect())) == [("a", "aa", "c"), ("c", "ac", "c"), ("d", "ad", "c"), ("e", "ae", "c"), ("z", "az", None)]
    assert sorted(r.id for r in read(spark, service, max_pages="1").collect()) == ["a", "bx", "z"]
    with pytest.raises(Exception, match="gone|status 403|status 502"):
        read(spark, service, tries="1").collect()
    with pytest.raises(Exception, match="refused with status 404"):
        read(spark, service, refused="two").collect()


def test_no_feeds(spark, service, tmp_path):
    (tmp_path / "empty").mkdir()
    assert read(spark, tmp_path / "empty").count() == 0


def test_a_stream_goes_on_at_the_stored_cursors(spark, service, tmp_path):
    def run():
        rows = spark.readStream.format("discussions").options(folder=f"file://{service}", transport="tests.test_sources:Flaky", wait="0").load()
        query = rows.select("id").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert run() == 6
    put(service, "one", 3, ["f"])
    put(service, "late", 0, ["g", "h"])
    assert run() == 3
    assert run() == 0
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == sorted(r.id for r in read(spark, service).collect())


def members(spark, folder, **how):
    return {r.path: r.text for r in archives.texts(archives.index(spark, f"file://{folder}", **how)).collect()}


CONTENT = {"repo-1/docs/a.md": "# A é", "repo-1/docs/x/b.md": "B" * 5000, "repo-1/docs/c.txt": "no", "repo-1/docs_src/s/one.py": "code\n", "repo-1/docs_src/s/__init__.py": "", "repo-1/setup.py": "no"}
TAKEN = {"docs/a.md": "# A é", "docs/x/b.md": "B" * 5000, "docs_src/s/one.py": "code\n", "docs_src/s/__init__.py": ""}


@pytest.mark.parametrize("name", ["p.tar", "p.tar.gz", "p.tgz", "p.zip"])
def test_archives_of_each_kind(spark, tmp_path, name):
    if name.endswith("zip"):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("repo-1")
            for k, v in CONTENT.items():
                z.writestr(k, v)
    else:
        with tarfile.open(tmp_path / name, "w:gz" if "gz" in name else "w") as tar:
            for k, v in CONTENT.items():
                m = tarfile.TarInfo(k)
                m.size = len(v.encode())
                tar.addfile(m, io.BytesIO(v.encode()))
            link = tarfile.TarInfo("repo-1/docs/link.md")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            tar.addfile(link)
    assert members(spark, tmp_path) == TAKEN
    assert set(members(spark, tmp_path, wanted=None, strip=0)) == set(CONTENT)


@pytest.mark.parametrize("bad", ["repo/docs/../../../x.md", "/docs/x.md", "repo\\..\\..\\x.md", "c:/docs/x.md"])
def test_names_that_lead_out_are_refused(spark, tmp_path, bad):
    with tarfile.open(tmp_path / "p.tar", "w") as tar:
        tar.addfile(tarfile.TarInfo(bad), io.BytesIO(b""))
    with pytest.raises(Exception, match="leads out of the archive"):
        members(spark, tmp_path)


@pytest.mark.parametrize("compressed", [False, True])
def test_written_archives_come_back(spark, tmp_path, monkeypatch, compressed):
    monkeypatch.setattr(archives, "TASK_BYTES", 20_000)
    rows = [(f"docs/{i}.md", f"text {i} " * (i * 7)) for i in range(120)] + [("docs/null.md", None)]
    counts = archives.write(spark.createDataFrame(rows, "path string, text string"), f"file://{tmp_path}/a", 5, compressed=compressed).collect()
    assert sum(r.files for r in counts) == 121 and len(counts) == 5
    found = archives.texts(archives.index(spark, f"file://{tmp_path}/a"))
    assert {r.path: r.text for r in found.collect()} == {p: t or "" for p, t in rows}
    assert found.where(F.spark_partition_id() > 0).count() > 0
    digest = fetch.chunk_digest(p for p, _ in rows)
    assert digest == fetch.chunk_digest(r.path for r in found.select("path").collect())
