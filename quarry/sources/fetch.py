"""Corpora from elsewhere: pinned archives and paged discussions. The transport is a parameter, so nothing here needs a network."""

from __future__ import annotations

import hashlib
import json
import tarfile
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from pathlib import Path, PurePosixPath

TRIES, BUSY = 5, 403  # a service that is busy may say 403
WANTED = (("docs", ".md"), ("docs_src", ".py"))


class TransportError(Exception):
    """The service could not be reached."""


def persistent(send: Callable[[dict], tuple[int, dict]], payload: dict, tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> dict:
    """The reply (status, body) of ``send``; busy, failing and unreachable services are asked again after 1, 2, 4 ... seconds."""
    for attempt in range(tries):
        try:
            status, body = send(payload)
            if status < 400:
                return body
            why: Exception = TransportError(f"status {status}")
            if status < 500 and status != BUSY:
                raise ValueError(f"refused with status {status}")
        except TransportError as gone:
            why = gone
        if attempt + 1 < tries:
            wait(2.0**attempt)
    raise why


def discussion_pages(send: Callable[[dict], tuple[int, dict]], max_pages: int | None = None, **how) -> Iterator[list[dict]]:
    """Nodes of each page; ``send`` gets {"after": cursor} and replies with nodes, next (a cursor or nothing)."""
    after, n = None, 0
    while max_pages is None or n < max_pages:
        page = persistent(send, {"after": after}, **how)
        yield page["nodes"]
        after, n = page.get("next"), n + 1
        if not after:
            return


def snapshot(pages: Iterable[list[dict]], path: Path, max_pages: int | None = None) -> int:
    """Answered discussions as a frozen file; how many there are."""
    kept = []
    for node in (x for page in pages for x in page):
        given = (node.get("answer") or {}).get("bodyText") or ""
        if given:
            kept.append({"discussion_id": node["id"], "title": node["title"], "question_body": node["bodyText"], "answer_body": given, "url": node["url"], "category": (node.get("category") or {}).get("name")})
    path.write_text(json.dumps({"fetched_at": datetime.now(UTC).isoformat(), "max_pages": max_pages, "n_discussions": len(kept), "discussions": kept}, indent=2), encoding="utf-8")
    return len(kept)


def extract(archive: Path, root: Path, sha: str) -> dict:
    """Pages and snippets of a pinned archive, below ``root``, without the archive's top folder; SNAPSHOT.json tells which they are.

    Names that lead out of ``root`` are refused."""
    files = []
    with tarfile.open(archive) as tar:
        for member in tar:
            name = PurePosixPath(*PurePosixPath(member.name).parts[1:])
            if not member.isfile() or not any(name.parts[:1] == (top,) and name.suffix == suffix for top, suffix in WANTED):
                continue
            if ".." in name.parts:
                raise ValueError(f"{member.name!r} leads out of the archive")
            target = root / name
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(tar.extractfile(member).read())
            files.append(str(name))
    out = {"sha": sha, "files": len(files), "names_sha256": hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()}
    (root / "SNAPSHOT.json").write_text(json.dumps(out, indent=2), encoding="utf-8")
    return out


def chunk_digest(chunk_ids: Iterable[str]) -> str:
    """First 16 hex digits of SHA-256 over the sorted ids, a line each: the digest of a corpus of files on one machine."""
    return hashlib.sha256("\n".join(sorted(chunk_ids)).encode()).hexdigest()[:16]
