"""Encoding whole texts with the tokenizers library, one library call per distinct piece.

Both vocabularies split a text at white space before any merge, so the ids of
a text are the ids of its pieces in order. Pieces recur, so their ids are kept
in a bounded table; only unknown pieces go to the library. Long texts are taken
in slices that end before a space between two other characters. A slice with a
string of the special tokens, which hold no space, goes to the library whole."""

from __future__ import annotations

import os
import re
from contextlib import suppress
from functools import lru_cache

import numpy as np

from quarry.llm import common

#: Unicode White_Space: what \s means to the library's patterns.
WHITE = "\t-\r \x85\xa0  -     　"
#: Latin letters; between one of them and a point or comma both vocabularies split.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PIECES = {
    # a run of white space leaves its last character to the next piece
    "byte": re.compile(f" ?[{LETTERS}]+(?=[.,])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]"),
    "word": re.compile(f"[{LETTERS}]+(?=[.,])|[^{WHITE}]+"),
}
KEPT_PIECES = 1_200_000  # some 200 bytes each, 240 MB in a worker
LONGEST_KEPT = 16  # longer ones seldom come again
LONGEST_TOGETHER = 48
SLICE = 1 << 18  # characters that are encoded together, about


class Encoder:
    """``encode(text)`` gives the bytes of the ids, unsigned 32 bit, little-endian.

    Unknown pieces of a text share a library call. What tells them apart in its
    ids: a byte-level piece starts with a space, or gets a line end put before
    it, and no other token starts with either. A word piece of letters ends
    with the one token of it that is marked as a word's end; any other gets a
    control character between spaces put before it. Where the count of marks
    is not that of the pieces, each goes to the library alone."""

    def __init__(self, path: str, kind: str, keep: int = KEPT_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.byte, self.keep = Tokenizer.from_file(path), kind == "byte", keep
        self.split = PIECES[kind].findall
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.cut = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])").search
        self.mark = os.path.commonprefix(special)
        self.known: dict[str, bytes] = {}
        self.before = "\n" if self.byte else " \x01 "
        (self.before_id,) = self.library.encode(self.before, add_special_tokens=False).ids
        size = self.library.get_vocab_size() + 1
        self.starts, self.ends = np.zeros(size, bool), np.zeros(size, bool)
        self.starts[self.before_id] = True
        vocabulary = self.library.get_vocab()
        if self.byte:
            self.starts[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # a space in the library's alphabet
        else:
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) <= SLICE:
            return self.slice(text)
        out, at = [], 0
        while at < len(text):
            cut = self.cut(text, at + SLICE)
            end = cut.start() if cut else len(text)
            out.append(self.slice(text[at:end]))
            at = end
        return b"".join(out)

    def slice(self, text: str) -> bytes:
        if self.mark in text and self.special.search(text):
            return self.whole(text)
        pieces = self.split(text)
        got = list(map(self.known.get, pieces))
        if None in got:
            at, i = [], -1
            with suppress(ValueError):  # the last one is past
                while True:
                    i = got.index(None, i + 1)
                    at.append(i)
            new = self.learn({pieces[i] for i in at})
            for i in at:
                got[i] = new[pieces[i]]
        return b"".join(got)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        odd = {p for p in pieces if len(p) > LONGEST_TOGETHER or "\x01" in p or p.isspace()}
        new = {p: self.whole(p) for p in odd}
        rest = list(pieces - odd) if odd else list(pieces)
        if not self.byte:
            letters = [p for p in rest if p.isalpha()]
            rest = [p for p in rest if not p.isalpha()]
            if letters:
                ids = self.ids(" ".join(letters))
                at = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
                raw = ids.tobytes()
                new.update(zip(letters, [raw[i:j] for i, j in zip(at, at[1:])]) if len(at) == len(letters) + 1 and at[-1] == len(raw) else [(p, self.whole(p)) for p in letters])  # noqa: B905
        if rest:
            before = self.before
            ids = self.ids("".join([p if p[0] == " " else before + p for p in rest]))
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(rest) and at[0] == 0:
                raw, first = ids.tobytes(), at + (ids[at] == self.before_id)
                new.update(zip(rest, [raw[i:j] for i, j in zip((4 * first).tolist(), [*(4 * at[1:]).tolist(), len(raw)])]))  # noqa: B905
            else:
                new.update((p, self.whole(p)) for p in rest)
        if len(self.known) + len(new) > self.keep:
            self.forget()
        self.known.update([x for x in new.items() if len(x[0]) <= LONGEST_KEPT])
        return new

    def forget(self) -> None:
        self.known.clear()


@lru_cache(maxsize=4)
def _encoder(path: str, kind: str) -> Encoder:
    return Encoder(path, kind)


def encoder(path: str, kind: str) -> Encoder:
    """At the start of a task: the encoder that this worker keeps. Its table of pieces goes when another operator's task starts."""
    owner, made = f"{kind} {path}", _encoder(path, kind)
    common.release(owner)
    common.hold(owner, made.forget)
    return made


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
