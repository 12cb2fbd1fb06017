"""Licence scans: identifier tags, notice phrases and licence expressions.

One Aho-Corasick automaton runs over the words of a text, joined by single
spaces, and finds all phrases at once: the base phrases, notices, and the words
of identifier tags. Where it has found a tag, the expression behind it is read
from the raw text by a shunting-yard parser: ``with`` binds closest, then
``and``, then ``or``; an expression ends where no token can continue it, and
the longest complete beginning counts. Each identifier stands for a family and
for how much it asks of those who take the text. Of an ``or`` the taker chooses
the side that asks less, an ``and`` asks what its stricter side asks, and an
exception behind ``with`` takes one step off a copyleft.

A text's labels are the families of its phrases and expressions, and the terms
that all of them together come to. Its score is 1 - the product of (1 - belief)
over the kinds of evidence found: a bare name, a notice, a tag."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

#: The base phrases and labels of op13's contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

FREE, PERMISSIVE, WEAK, COPYLEFT, RESTRICTED = range(5)
TERMS = ("terms:public-domain", "terms:permissive", "terms:weak-copyleft", "terms:copyleft", "terms:restricted")

#: Families by the beginning of an identifier, the longest one that fits; and what they ask.
FAMILIES = {
    "0bsd": ("bsd", FREE),
    "afl": ("afl", PERMISSIVE),
    "agpl": ("agpl", COPYLEFT),
    "apache": ("apache", PERMISSIVE),
    "artistic": ("artistic", WEAK),
    "bsd": ("bsd", PERMISSIVE),
    "bsl": ("bsl", PERMISSIVE),
    "busl": ("busl", RESTRICTED),
    "cc-by": ("cc-by", PERMISSIVE),
    "cc-by-nc": ("cc-by-nc", RESTRICTED),
    "cc-by-nd": ("cc-by-nd", RESTRICTED),
    "cc-by-sa": ("cc-by-sa", COPYLEFT),
    "cc0": ("cc0", FREE),
    "cddl": ("cddl", WEAK),
    "epl": ("epl", WEAK),
    "eupl": ("eupl", COPYLEFT),
    "gfdl": ("gfdl", COPYLEFT),
    "gpl": ("gpl", COPYLEFT),
    "isc": ("isc", PERMISSIVE),
    "lgpl": ("lgpl", WEAK),
    "mit": ("mit", PERMISSIVE),
    "mpl": ("mpl", WEAK),
    "ofl": ("ofl", WEAK),
    "proprietary": ("proprietary", RESTRICTED),
    "psf": ("psf", PERMISSIVE),
    "python": ("psf", PERMISSIVE),
    "unlicense": ("unlicense", FREE),
    "wtfpl": ("wtfpl", FREE),
    "zlib": ("zlib", PERMISSIVE),
}

#: Names alone, and sentences that grant or withhold; words as they stand in a text, and the identifier they mean.
NAMES = {
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "sil open font license": "ofl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
}
NOTICES = {
    "licensed under the apache license": "apache",
    "licensed under the gnu general public license": "gpl",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "subject to the terms of the mozilla public license": "mpl",
    "all rights reserved no part of this": "proprietary",
}
TAGS = ("spdx license identifier", "license expression", "licence expression")
_TAG = re.compile(rb"(?:spdx-license-identifier|licen[cs]e-expression)[ \t]*[:=][ \t\"']*", re.I)

NAME_BELIEF, NOTICE_BELIEF, TAG_BELIEF = 0.6, 0.9, 0.98

_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+_-]*)")
_BINDING = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> tuple[str, int] | None:
    """The family of a lower-cased identifier and what it asks."""
    fits = [p for p in FAMILIES if identifier == p or identifier.startswith((p + "-", p + "+"))]
    return FAMILIES[max(fits, key=len)] if fits else None


@dataclass
class Expression:
    """Families of an expression, and what it asks of the taker: none where an identifier that counts is unknown."""

    families: frozenset[str]
    asks: int | None

    def joined(self, operator: str, other: Expression) -> Expression:
        if operator == "with":  # the other side is an exception, no licence
            return Expression(self.families, WEAK if self.asks == COPYLEFT else PERMISSIVE if self.asks == WEAK else self.asks)
        both = self.families | other.families
        if operator == "or":
            return Expression(both, min((x for x in (self.asks, other.asks) if x is not None), default=None))
        return Expression(both, None if self.asks is None or other.asks is None else max(self.asks, other.asks))


def _complete(text: bytes | memoryview, at: int) -> tuple[list[str], int]:
    """Tokens of the longest complete expression that begins at ``at``, and how many tokens that is."""
    tokens, depth, whole, operand = [], 0, 0, True
    for m in iter(lambda: _TOKEN.match(text, at), None):
        token, at = m[1].decode().lower(), m.end()
        if token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif operand:
            if token in _BINDING:
                break
            depth += token == "("
            operand = token == "("
        elif token in _BINDING:
            operand = True
        else:
            break
        tokens.append(token)
        if not operand and not depth:
            whole = len(tokens)
    return tokens, whole


def evaluate(text: bytes | memoryview, at: int = 0) -> Expression | None:
    """The expression that begins at ``at``; none where there is none."""
    tokens, whole = _complete(text, at)
    values: list[Expression] = []
    waiting: list[str] = []

    def apply() -> None:
        right = values.pop()
        values.append(values.pop().joined(waiting.pop(), right))

    for token in tokens[:whole]:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        elif token in _BINDING:
            while waiting and waiting[-1] != "(" and _BINDING[waiting[-1]] >= _BINDING[token]:
                apply()
            waiting.append(token)
        else:
            known = family(token)
            values.append(Expression(frozenset([known[0]]) if known else frozenset(), known[1] if known else None))
    while waiting:
        apply()
    return values[0] if values else None


@dataclass(frozen=True)
class Phrase:
    words: int
    kinds: tuple[str, ...]  # base, name, notice, tag
    label: str


@lru_cache(maxsize=1)
def _phrases() -> tuple[ahocorasick.Automaton, list[Phrase], int]:
    kinds: dict[str, list[tuple[str, str]]] = {}
    for kind, table in (("base", BASE), ("name", NAMES), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for words, label in table.items():
            kinds.setdefault(words, []).append((kind, label))
    automaton, phrases = ahocorasick.Automaton(), []
    for words, found in kinds.items():
        automaton.add_word(f" {words} ", (len(phrases), len(words) + 2))
        phrases.append(Phrase(words.count(" ") + 1, tuple(k for k, _ in found), found[0][1]))
    automaton.make_automaton()
    return automaton, phrases, max(p.words for p in phrases)


@dataclass
class Scan:
    n_words: int = 0
    n_base: int = 0
    first_word: int | None = None
    last_word: int | None = None
    base_labels: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    kinds: set[str] = field(default_factory=set)
    asks: list[int] = field(default_factory=list)
    n_tags: int = 0

    def score(self) -> float:
        belief = {"base": NAME_BELIEF, "name": NAME_BELIEF, "notice": NOTICE_BELIEF, "expression": TAG_BELIEF}
        doubt = 1.0
        for kind in sorted(self.kinds & set(belief)):
            doubt *= 1 - belief[kind]
        return 1 - doubt


def scan(raw: memoryview | bytes) -> Scan:
    """Phrases and expressions of a whole text (its bytes); a phrase may go on from one slice to the next."""
    automaton, phrases, most = _phrases()
    out, tail = Scan(), []
    for words in common.cut_words(raw):
        line = b" ".join([b"", *tail, *words, b""])
        hits = list(automaton.iter(line.decode("latin-1")))
        if hits:
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            which = np.array([h[1][0] for h in hits])
            start = np.searchsorted(spaces, np.array([h[0] - h[1][1] + 1 for h in hits]))
            new = start + np.array([p.words for p in phrases])[which] > len(tail)
            base = np.array(["base" in p.kinds for p in phrases])[which] & new
            for p in (phrases[i] for i in np.unique(which[new]).tolist()):
                out.kinds |= {*p.kinds}
                if p.label:
                    out.labels.add(p.label)
                    out.asks.append(FAMILIES[p.label][1])
                if "base" in p.kinds:
                    out.base_labels.add(p.label)
            if base.any():
                at = start[base] + out.n_words - len(tail)
                out.n_base += int(base.sum())
                out.first_word = int(at.min()) if out.first_word is None else min(out.first_word, int(at.min()))
                out.last_word = int(at.max()) if out.last_word is None else max(out.last_word, int(at.max()))
        out.n_words += len(words)
        tail = [*tail, *words][-(most - 1) :]
    if "tag" in out.kinds:
        for m in _TAG.finditer(raw):
            found = evaluate(raw, m.end())
            out.n_tags += 1
            if found is not None and found.families:
                out.kinds.add("expression")
                out.labels |= found.families
                if found.asks is not None:
                    out.asks.append(found.asks)
    if out.asks:
        out.labels.add(TERMS[max(out.asks)])
    return out


FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long"


def license_scan(docs: DataFrame) -> DataFrame:
    """``FOUND`` for each row of ``docs`` (doc_id, text); rows stay where they are.

    Null and empty texts have no words and no labels, and score 0. Repeated
    rows get equal results; a null doc_id stays null; other columns are
    ignored; empty tables give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for b in batches:
            found = [scan(common.raw_bytes(t)) for t in b.column(1)]
            listed = lambda labels: ",".join(sorted(labels))
            columns = [
                *(pa.array([getattr(s, c) for s in found], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")),
                pa.array([listed(s.base_labels) for s in found], pa.string()),
                pa.array([listed(s.labels) for s in found], pa.string()),
                pa.array([s.score() for s in found], pa.float64()),
                pa.array([s.n_tags for s in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans every row of ``documents``; see ``license_scan`` for the defined cases."""
    return license_scan(common.documents(spark, sf_dir))
