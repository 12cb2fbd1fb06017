"""Words of whole Arrow columns of lowered texts: the patterns of ``text`` by masks over their bytes.

A byte of a character beyond ASCII belongs to no word, as in the patterns. A
word's bytes are cut out of the column, so words are slices of one buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTES = 4 << 20  # of text that are looked at together, but for longer texts

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
_UNDERSCORED = _PLAIN.copy()
_UNDERSCORED[ord("_")] = True
_JOINING = np.zeros(256, bool)
_JOINING[[ord("."), ord("_")]] = True


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of ``BYTES`` of their text in ``column``, one row at least."""
    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(max(at + 1, int(np.searchsorted(ends, before + BYTES, "right"))), b.num_rows)
            yield b.slice(at, end - at)
            at = end


def _cut(texts: pa.Array, mask) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words one behind the other; ``mask(bytes, joins)`` says which bytes belong to words, ``joins`` which follow one of their own text."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    joins = np.ones(len(data) + 1, bool)
    joins[offsets] = False  # a text's first byte, and the end
    word = mask(data, joins)
    begins = word & ~(np.concatenate([[False], word[:-1]]) & joins[:-1])
    at = np.flatnonzero(begins)
    sizes = np.cumsum(word, dtype=np.int32)[np.append(at, len(data))[1:] - 1] if len(at) else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], sizes]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data[word]))
    return np.diff(np.searchsorted(at, offsets)), words


def bm25(texts: pa.Array) -> pa.Array:
    """The words of ``text.BM25_TOKEN`` of each lowered text, as lists; none of null."""

    def mask(data: np.ndarray, joins: np.ndarray) -> np.ndarray:
        plain = _PLAIN[data]
        inner = np.zeros(len(data), bool)
        inner[1:-1] = _JOINING[data[1:-1]] & plain[:-2] & plain[2:] & joins[1:-2] & joins[2:-1]
        return plain | inner

    n, words = _cut(texts, mask)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), words)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs of three words of ``text.TRIGRAM_TOKEN`` of lowered texts, joined by a space, and the text that each is in; repeated ones too."""
    n, words = _cut(texts, lambda data, _: _UNDERSCORED[data])
    of = np.repeat(np.arange(len(n)), n)
    if len(words) < 3:
        return of[:0], pa.array([], pa.string())
    inside = of[2:] == of[:-2]
    first, second, third = (words.slice(i, len(words) - 2) for i in range(3))
    made = pc.binary_join_element_wise(first, second, third, " ")
    return of[:-2][inside], made.filter(pa.array(inside))
