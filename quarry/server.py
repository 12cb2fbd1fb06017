"""The HTTP routes as a WSGI application: health, readiness and questions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

Reply = tuple[int, dict]
STATUS = {200: "200 OK", 404: "404 Not Found", 405: "405 Method Not Allowed", 422: "422 Unprocessable Entity", 503: "503 Service Unavailable"}


def question(body: bytes) -> tuple[str, int]:
    """The question and how many chunks it is answered from, five unless said."""
    data = json.loads(body)
    if not isinstance(data, dict) or not isinstance(data.get("question"), str) or not isinstance(k := data.get("k", 5), int) or isinstance(k, bool):
        raise ValueError("a question and, if at all, a whole number k are expected")
    return data["question"], k


def application(ready: Callable[[], dict[str, str]], ask: Callable[[str, int], dict]) -> Callable[[dict, Callable], Iterable[bytes]]:
    """``ready`` tells of each source whether it can be searched (ok or why not); ``ask`` answers one question.

    A connection that fails while answering is 503, and so is a source that cannot be searched."""

    def healthy(_: bytes) -> Reply:
        return 200, {"status": "ok"}

    def readiness(_: bytes) -> Reply:
        bad = [f"{source}: {why}" for source, why in ready().items() if why != "ok"]
        return (503, {"detail": {"ready": False, "problems": bad}}) if bad else (200, {"ready": True})

    def answer(body: bytes) -> Reply:
        try:
            text, k = question(body)
        except ValueError as why:
            return 422, {"detail": str(why)}
        try:
            return 200, ask(text, k)
        except ConnectionError as why:
            return 503, {"detail": f"no connection: {why}"}

    routes = {("GET", "/health"): healthy, ("GET", "/api/health"): healthy, ("GET", "/api/health/ready"): readiness, ("POST", "/api/ask"): answer}

    def serve(environ: dict, start: Callable) -> Iterable[bytes]:
        method, path = environ["REQUEST_METHOD"], environ.get("PATH_INFO", "")
        route = routes.get((method, path))
        if route is None:
            code, out = (405, {"detail": "method not allowed"}) if any(p == path for _, p in routes) else (404, {"detail": "not found"})
        else:
            code, out = route(environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0)) if method == "POST" else b"")
        raw = json.dumps(out).encode()
        start(STATUS[code], [("Content-Type", "application/json"), ("Content-Length", str(len(raw)))])
        return [raw]

    return serve
