"""Token counts of a unigram tokenizer without its tokens.

The Viterbi search for the best segmentation keeps two numbers for each place:
the best score up to it and how many pieces that takes. An Aho-Corasick
automaton over the vocabulary finds the pieces that end at each place, longest
first. Tie rules are those of the tokenizers library's unigram model: a piece
that starts earlier keeps its place unless a later one scores strictly more; a
character that is no piece itself may be unknown, at the lowest score of the
vocabulary less ten, and counts its UTF-8 bytes.

The offered vocabularies have no unigram model, and tokenizers are not trained
here. So the pieces and scores of the sentencepiece file are read as they stand
and taken for a unigram vocabulary; the library's unigram model over the same
pieces is what the counts are held against."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, tokens

SPACE = "▁"
PENALTY = 10.0  # of an unknown character, below the lowest score
KEPT = 400_000  # units whose counts a worker keeps, some 150 bytes each
LONGEST_KEPT = 20
SLICE = 1 << 18  # characters that are counted together, about


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: number and value."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in order.

    Control, unknown and byte pieces are left out, as they never match text."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) not in (1, 4):
                continue
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0))
    return out


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], keep: int = KEPT):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.known: dict[str, int] = {}
        self.keep = keep
        inner = any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary)
        # no piece goes on over a space or holds a line end: texts fall into units there
        line = "" if any("\n" in p for p, _ in vocabulary) else "\n"
        self.units = (lambda t: [t]) if inner else re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+|\n").findall
        # a unit begins at the first space of a run
        self.cut = (lambda t, at: None) if inner else re.compile(f"(?<=[^ {SPACE}])[ {SPACE}]").search

    def viterbi(self, unit: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n = len(unit)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        single, unknown = self.single, self.unknown
        done = 0  # places below have their final values

        def alone(e: int, best: float | None, pieces: int) -> None:
            """Closes place e with the unknown character as a last choice."""
            c = unit[e - 1]
            if c not in single:
                s = score[e - 1] + unknown
                if best is None or s > best:
                    best, pieces = s, count[e - 1] + len(c.encode("utf-8", "surrogatepass"))
            score[e], count[e] = best, pieces

        end, best, pieces = 0, None, 0
        for last, (size, own) in self.automaton.iter(unit):
            e = last + 1
            if e != end:
                if end:
                    alone(end, best, pieces)
                    done = end
                for skipped in range(done + 1, e):
                    alone(skipped, None, 0)
                end, best = e, None
            s = score[e - size] + own
            if best is None or s > best:
                best, pieces = s, count[e - size] + 1
        if end:
            alone(end, best, pieces)
        for skipped in range(end + 1, n + 1):
            alone(skipped, None, 0)
        return count[n], score[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, at, before = 0, 0, SPACE  # the library puts a space before a text
        while at < len(text):
            cut = self.cut(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            total += self.slice(before + text[at:end])
            at, before = end, ""
        return total

    def slice(self, text: str) -> int:
        units = self.units(text.replace(" ", SPACE))
        got = list(map(self.known.get, units))
        if None not in got:
            return sum(got)
        total = 0
        for unit, n in zip(units, got, strict=True):
            if n is None:
                n = self.known.get(unit)
                if n is None:
                    n, _ = self.viterbi(unit)
                    if len(unit) <= LONGEST_KEPT:
                        if len(self.known) >= self.keep:
                            self.known.clear()
                        self.known[unit] = n
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


def counter(path: str) -> Counter:
    """At the start of a task: the counter that this worker keeps. Its counts go when another operator's task starts."""
    made = _counter(path)
    common.release(path)
    common.hold(path, made.known.clear)
    return made


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens for every row; null and empty texts have none.

    Repeated rows are counted alike; other columns are ignored."""
    path = path or tokens.tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in batches:
            n = np.array([count(t.as_py()) for t in b.column(1)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["doc_id", "n_tokens"])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, "doc_id long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole text of ``documents``.

    Null and empty texts have no tokens, repeated rows are counted alike, a
    null doc_id stays null, an empty table gives no rows."""
    return token_counts(common.documents(spark, sf_dir))
