"""Text primitives as Column expressions; all of them stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
#: Fixed pattern: words for lexical search, dotted or underscored names whole.
BM25_TOKEN = r"[a-z0-9]+(?:[._][a-z0-9]+)*"
#: Fixed pattern: words for trigram filters.
TRIGRAM_TOKEN = r"[a-z0-9_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda an expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_estimate(text: Column) -> Column:
    """About four code points to a token, one token at least."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(text) / CHARS_PER_TOKEN)).cast("int")


def content_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def bm25_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(BM25_TOKEN), F.lit(0))


def bm25_length(text: Column) -> Column:
    """How many words ``bm25_tokens`` gives, without making them."""
    return F.regexp_count(F.lower(text), F.lit(BM25_TOKEN))


def trigram_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TRIGRAM_TOKEN), F.lit(0))


def grams(tokens: Column, size: int, joined: Callable[..., Column]) -> Column:
    """``joined(token, token, ...)`` of every run of ``size`` tokens."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        made = F.transform(F.sequence(F.lit(0), n - size), lambda i: joined(*(F.get(t, i + k) for k in range(size))))
        return F.when(n >= size, made)

    return let(tokens, runs)


def trigrams(tokens: Column) -> Column:
    """Distinct word trigrams, joined by a space."""
    return F.coalesce(F.array_distinct(grams(tokens, 3, lambda *w: F.concat_ws(" ", *w))), F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    """Lines of a text; an ending line end opens no further line, an empty text has none."""
    parts = F.split(F.regexp_replace(text, "\r\n?|[\x0b\x0c\x1c-\x1e\x85  ]", "\n"), "\n", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def page_of(url: Column) -> Column:
    """The URL without its fragment."""
    return F.substring_index(url, "#", 1)


def url_section(url: Column) -> Column:
    """First path segment, or ``_root``."""
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1)
    return F.when(segment == "", F.lit("_root")).otherwise(segment)


def path_section(path: Column) -> Column:
    first = F.split_part(path, F.lit("/"), F.lit(1))
    return F.when(F.coalesce(first, F.lit("")) == "", F.lit("_root")).otherwise(first)


def doc_url(path: Column, anchor: Column, base: str) -> Column:
    """Address of a page: ``x.md`` is ``x/``, an index page its folder; then the anchor."""
    stem = F.regexp_replace(path, r"\.md$", "")
    tail = F.when(stem == "index", F.lit("")).when(stem.endswith("/index"), F.regexp_replace(stem, "index$", "")).otherwise(F.concat(stem, F.lit("/")))
    page = F.concat(F.lit(base.rstrip("/") + "/"), tail)
    return F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(page, F.lit("#"), anchor)).otherwise(page)


def model_slug(model: str) -> str:
    return model.rsplit("/", 1)[-1].replace(".", "").lower()


def fake_embedding(text: Column) -> Column:
    """Deterministic vector of eight: the first bytes of SHA-256 over 255."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot / length)
