"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence is a few counts of the line and of the
lines before and after it; neighbouring labels hold each other. Forward-backward
gives every line's marginal, and a document's quality is the mean of the
marginals weighted by line length, put on the scale of the labels by a logistic
curve.

Labels exist for documents only, so lines are labelled in turns: at first all
lines of a bad document are bad; then those that the field takes for good are
good, and it is fitted again. It is fitted on a bounded sample of the labelled
rows: one text of each of ``SAMPLE`` documents at most, whole up to
``RUNS`` * ``RUN`` lines, and of a longer one so many runs of lines from all of
it; scores read every line of every text. Gradients are summed over groups of
documents, so that the driver holds 44 bytes for each line of the sample and
working space for one group. Labels, lang, source and doc_id are no evidence.

Scores need memory for a part of a text at a time. With two labels a message is
one number, the odds of good, and each line maps the odds before it to its own
by a fraction of linear terms. Many stretches of lines are gone through side by
side; a stretch starts from where the one before it ended, and all are gone
through again until no end changes. A long text is taken in parts of whole
lines: backwards for the odds at the edges of parts, then forwards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

SAMPLE = 2000
GROUP_LINES = 200_000  # lines that are worked on together, or one document
TURNS = 3
STEPS = 80
THRESHOLD = 0.3
BATCH_BYTES = 1 << 19  # of texts whose lines are measured together
PART_BYTES = 1 << 18  # of a part of a longer text, about
RUNS, RUN = 16, 128  # runs of lines that stand for a longer text in the sample
FAR = 300.0  # a line's score is held within this; beyond it marginals are 0 or 1 in double numbers

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&<>{}[]\\^~=_@", "pipe": b"|", "bang": b"!?"}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()} | {"more": (np.arange(256) & 0xC0) == 0x80, "space": np.isin(np.arange(256), [32, 9, 10, 11, 12, 13]), "tail": np.isin(np.arange(256), list(b'.!?:;"'))}
FEATURES = 10


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and length of every line of all texts, and how many lines each has (one at least)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])

    def count(hit: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(hit, out=total[1:])
        return (total[ends] - total[starts]).astype(np.float64)

    c = {k: count(t[data]) for k, t in _TABLES.items() if k not in ("space", "tail")}
    chars = ends - starts - c["more"]
    space = _TABLES["space"][data]
    edge = np.diff(space.view(np.int8), prepend=1)
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    last = last[len(last) - len(first) :] if len(first) else first
    line_of = np.searchsorted(ends, first)
    words = np.bincount(line_of, minlength=len(ends)).astype(np.float64)
    # a word equals the one before it: same length and, nearly always, same letters
    same = np.zeros(len(first), bool)
    if len(first):
        value = data.astype(np.int64)
        total = np.concatenate([[0], np.cumsum(value * (value + 31))])
        mark, size = total[last] - total[first], last - first
        same[1:] = (mark[1:] == mark[:-1]) & (size[1:] == size[:-1]) & (line_of[1:] == line_of[:-1])
    repeated = np.bincount(line_of[same], minlength=len(ends))
    per_word, letters = np.maximum(words, 1), np.maximum(c["upper"] + c["lower"], 1)
    x = np.empty((len(ends), FEATURES))
    x[:, 0] = 1
    x[:, 1] = np.log1p(chars) / 5
    x[:, 2] = c["upper"] / letters
    x[:, 3] = np.minimum(c["symbol"] / per_word, 4) / 2
    x[:, 4] = np.minimum(c["pipe"] / per_word, 2)
    x[:, 5] = np.minimum(c["bang"] / per_word, 2)
    x[:, 6] = c["digit"] / np.maximum(chars, 1)
    x[:, 7] = np.minimum(chars / per_word, 20) / 10
    x[:, 8] = repeated / per_word
    x[:, 9] = _TABLES["tail"][data[np.maximum(ends - 1, 0)]] & (ends > starts)
    per_text = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    return x, chars, per_text


def parts(raw: memoryview | bytes) -> list[tuple[int, int]]:
    """Where the parts of a text begin and end: whole lines, without the line end behind a part."""
    out, begin = [], 0
    for at in range(0, len(raw), PART_BYTES):
        cut = at + bytes(raw[at : at + PART_BYTES]).rfind(b"\n")
        if cut >= at:
            out.append((begin, cut))
            begin = cut + 1
    return [*out, (begin, len(raw))]


def part_features(raw: memoryview | bytes, cuts: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Features and lengths of the lines of part ``k``, and of the line before and behind it; how many lines these are at either end."""
    begin, end = cuts[k]
    if k:
        a, b = cuts[k - 1]
        begin = a + bytes(raw[a:b]).rfind(b"\n") + 1
    if k + 1 < len(cuts):
        a, b = cuts[k + 1]
        line = bytes(raw[a:b]).find(b"\n")
        end = b if line < 0 else a + line
    x, chars, _ = line_features([bytes(raw[begin:end])])
    return x, chars, int(k > 0), int(k + 1 < len(cuts))


def sample_features(raw: memoryview | bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of all lines of a text; of one with more than ``RUNS`` * ``RUN`` lines, those of ``RUNS`` runs chosen by hash."""
    cuts, xs, lengths, at = parts(raw), [], [], 0
    n = 1 + sum(bytes(raw[i : i + PART_BYTES]).count(b"\n") for i in range(0, len(raw), PART_BYTES))
    runs = np.arange(-(-n // RUN))
    if len(runs) > RUNS:
        runs = np.sort(np.argsort(common.mix64(runs + 1), kind="stable")[:RUNS])
    for k in range(len(cuts)):
        x, chars, before, after = part_features(raw, cuts, k)
        stop = len(x) - after
        wanted = np.isin((at + np.arange(stop - before)) // RUN, runs)
        xs.append(x[before:stop][wanted])
        lengths.append(chars[before:stop][wanted])
        at += stop - before
    return np.concatenate(xs), np.concatenate(lengths)


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and after it in its text."""
    first = np.cumsum(per_text) - per_text
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first] = 0
    after[first + per_text - 1] = 0
    return np.hstack([x, before[:, 1:], after[:, 1:]])


def forward_backward(good: np.ndarray, bond: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the good label, and the expected count of each pair of labels (2 x 2).

    ``good`` is a line's score for good (bad has 0). Texts run side by side,
    the longest first, so a step touches those that are still going."""
    order = np.argsort(-per_text, kind="stable")
    size, first = per_text[order], (np.cumsum(per_text) - per_text)[order]
    steps = int(size[0])
    going = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    forward = np.empty((len(good), 2))
    backward = np.zeros((len(good), 2))
    score = np.stack([np.zeros_like(good), good], 1)
    forward[first] = score[first]
    for t in range(1, steps):
        at = first[: going[t]] + t
        f = forward[at - 1]
        forward[at] = score[at] + np.stack([np.logaddexp(f[:, 0] + bond[0, y], f[:, 1] + bond[1, y]) for y in (0, 1)], 1)
    for t in range(steps - 2, -1, -1):
        at = first[: going[t + 1]] + t
        b = backward[at + 1] + score[at + 1]
        backward[at] = np.stack([np.logaddexp(b[:, 0] + bond[y, 0], b[:, 1] + bond[y, 1]) for y in (0, 1)], 1)
    both = forward + backward
    marginal = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(good), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    whole = np.logaddexp(both[at, 0], both[at, 1])
    pairs = np.array([[np.exp(np.clip(forward[at - 1, a] + bond[a, b] + score[at, b] + backward[at, b] - whole, -500, 0)).sum() for b in (0, 1)] for a in (0, 1)])
    return marginal, pairs


def odds(gain: np.ndarray, opens: np.ndarray, e: np.ndarray, before: float | None = None) -> np.ndarray:
    """r[t] = gain[t] * (e[0, 1] + e[1, 1] r[t - 1]) / (e[0, 0] + e[1, 0] r[t - 1]), and gain[t] where a chain opens.

    ``before`` is r[-1]; where it is none a chain opens at 0."""
    n = len(gain)
    steps = max(1, int(np.sqrt(n)))
    width = -(-n // steps)
    grid = np.ones(steps * width)
    grid[:n] = gain
    grid = np.ascontiguousarray(grid.reshape(width, steps).T)
    first = np.zeros(steps * width, bool)
    first[:n] = opens
    first[0] |= before is None
    first = np.ascontiguousarray(first.reshape(width, steps).T)
    some = first.any(1)
    out, start = np.empty((steps, width)), np.ones(width)
    start[0] = before or 1.0
    while True:
        r = start
        for t in range(steps):
            top = e[1, 1] * r
            top += e[0, 1]
            below = e[1, 0] * r
            below += e[0, 0]
            top /= below
            if some[t]:
                top[first[t]] = 1
            r = np.multiply(top, grid[t], out=out[t])
        new = np.concatenate([start[:1], r[:-1]])
        if (np.abs(new - start) <= 1e-13 * new).all():
            return out.T.ravel()[:n]
        start = new


@dataclass
class Model:
    weights: np.ndarray
    bond: np.ndarray
    slope: float
    shift: float

    def documents(self, x: np.ndarray, chars: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """The mean marginal of each text, weighted by length."""
        marginal, _ = forward_backward(with_neighbours(x, per_text) @ self.weights, self.bond, per_text)
        first, weight = np.cumsum(per_text) - per_text, chars + 1
        return np.add.reduceat(marginal * weight, first) / np.add.reduceat(weight, first)

    def line_scores(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """What speaks for good in each line and its neighbours."""
        own, before, after = np.split(self.weights, [FEATURES, 2 * FEATURES - 1])
        first = np.cumsum(per_text) - per_text
        s, b, a = x @ own, x[:, 1:] @ before, x[:, 1:] @ after
        b, a = np.roll(b, 1), np.roll(a, -1)
        b[first] = 0
        a[first + per_text - 1] = 0
        return np.clip(s + b + a, -FAR, FAR)

    def scores(self, texts: list) -> np.ndarray:
        """The score of each text, its bytes given; a long one by itself."""
        if len(texts) == 1 and len(texts[0]) > BATCH_BYTES:
            good = np.array([self._in_parts(texts[0])])
        else:
            x, chars, per_text = line_features([bytes(t) for t in texts])
            s, e = self.line_scores(x, per_text), np.exp(self.bond)
            gain, first = np.exp(s), np.cumsum(per_text) - per_text
            opens, closes = np.zeros(len(s), bool), np.zeros(len(s), bool)
            opens[first], closes[first + per_text - 1] = True, True
            both = odds(gain, opens, e) * odds(gain[::-1], closes[::-1], e.T)[::-1] / gain
            weight = chars + 1
            good = np.add.reduceat(both / (1 + both) * weight, first) / np.add.reduceat(weight, first)
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(good) + self.shift, -30, 30)))

    def _in_parts(self, raw: memoryview | bytes) -> float:
        """The mean marginal of a long text, weighted by length."""
        cuts, e = parts(raw), np.exp(self.bond)

        def part(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x, chars, before, after = part_features(raw, cuts, k)
            inner = slice(before, len(x) - after)
            gain = np.exp(self.line_scores(x, np.array([len(x)]))[inner])
            return gain, chars[inner], np.zeros(len(gain), bool)

        behind: list[float | None] = [None] * len(cuts)  # odds of the line behind each part
        for k in range(len(cuts) - 1, 0, -1):
            gain, _, none = part(k)
            behind[k - 1] = float(odds(gain[::-1], none, e.T, behind[k])[-1])
        before, good, total = None, 0.0, 0.0
        for k in range(len(cuts)):
            gain, chars, none = part(k)
            forward = odds(gain, none, e, before)
            both = forward * odds(gain[::-1], none, e.T, behind[k])[::-1] / gain
            good += float((both / (1 + both) * (chars + 1)).sum())
            total += float((chars + 1).sum())
            before = float(forward[-1])
        return good / total


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.001, 0.999)
    return np.log(p / (1 - p))


@dataclass
class Group:
    """Some documents of the sample: features, lengths and lines of each, and which lines are of bad ones."""

    x: np.ndarray
    chars: np.ndarray
    per_text: np.ndarray
    of_bad: np.ndarray
    y: np.ndarray

    def near(self) -> np.ndarray:
        return with_neighbours(self.x.astype(float), self.per_text)


def _groups(x: np.ndarray, chars: np.ndarray, per_text: np.ndarray, quality: np.ndarray) -> Iterator[Group]:
    """Documents in turn, ``GROUP_LINES`` lines at most unless one has more."""
    ends = np.cumsum(per_text)
    i = 0
    while i < len(per_text):
        begin = ends[i] - per_text[i]
        j = max(i + 1, int(np.searchsorted(ends, begin + GROUP_LINES, side="right")))
        of_bad = np.repeat(quality[i:j] == 0, per_text[i:j])
        yield Group(x[begin : ends[j - 1]], chars[begin : ends[j - 1]], per_text[i:j], of_bad, ~of_bad)
        i = j


def _ascend(groups: list[Group], weights: np.ndarray, bond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Penalised likelihood by gradient steps of adapted size."""
    seen = np.zeros((2, 2))
    for group in groups:
        inner = np.ones(len(group.y), bool)
        inner[np.cumsum(group.per_text) - group.per_text] = False
        at = np.flatnonzero(inner)
        seen += [[((group.y[at - 1] == a) & (group.y[at] == b)).sum() for b in (0, 1)] for a in (0, 1)]
    n = sum(len(group.y) for group in groups)
    # one group keeps what it is worked on with; several are set up in turn
    alone = groups[0].near() if len(groups) == 1 else None
    theta, m, v = np.concatenate([weights, bond.ravel()]), 0.0, 0.0
    for step in range(1, STEPS + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        slope, all_pairs = np.zeros(len(w)), np.zeros((2, 2))
        for group in groups:
            near = group.near() if alone is None else alone
            p, pairs = forward_backward(near @ w, t, group.per_text)
            slope += near.T @ (group.y - p)
            all_pairs += pairs
        g = np.concatenate([slope, (seen - all_pairs).ravel()]) / n - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit(x: np.ndarray, chars: np.ndarray, per_text: np.ndarray, quality: np.ndarray) -> Model:
    model = Model(np.zeros(3 * FEATURES - 2), np.zeros((2, 2)), 1.0, 0.0)
    if not len(quality):
        return model
    groups = list(_groups(x, chars, per_text, quality))
    for _ in range(TURNS):
        model.weights, model.bond = _ascend(groups, model.weights, model.bond)
        for group in groups:
            p, _ = forward_backward(group.near() @ model.weights, model.bond, group.per_text)
            group.y = ~(group.of_bad & (p < 0.5))
    z = _logit(np.concatenate([model.documents(group.x.astype(float), group.chars.astype(float), group.per_text) for group in groups]))
    a, b = 1.0, 0.0
    for _ in range(300):  # logistic curve by damped Newton steps, with a small penalty
        s = 1 / (1 + np.exp(-(a * z + b)))
        r, h = quality - s, s * (1 - s) + 1e-6
        g = np.array([(r * z).sum() - 0.1 * (a - 1), r.sum() - 0.1 * b])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, g), -0.5, 0.5)
    model.slope, model.shift = float(max(a, 0.05)), float(b)
    return model


def _batches(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, list]]:
    """First row and texts of batches of ``BATCH_BYTES`` at most, or of one text; the texts are not copied."""
    texts: list = []
    size = first = 0
    for i, t in enumerate(b.column(column)):
        raw = common.raw_bytes(t)
        if texts and size + len(raw) > BATCH_BYTES:
            yield first, texts
            texts, size, first = [], 0, i
        texts.append(raw)
        size += len(raw)
    if texts:
        yield first, texts


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the ``SAMPLE`` labelled documents with the smallest hash that are not held out; of rows with one doc_id on the greatest text."""
    spark = docs.sparkSession
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = [(r.doc_id, r.quality) for r in usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, quality int")), "doc_id")  # SAMPLE rows at most
    sample = sample.groupBy("doc_id", "quality").agg(F.max("text").alias("text"))  # one text of each, however often a doc_id is there

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for b in batches:
            rows = []
            for i, texts in _batches(b, 1):
                for k, t in enumerate(texts, i):
                    x, chars = sample_features(t)
                    rows.append((x.astype("<f4").tobytes(), chars.astype("<f4").tobytes(), b.column(2)[k].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.binary(), pa.binary(), pa.int32()])], names=["x", "chars", "quality"])

    rows = sorted((bytes(r.x), bytes(r.chars), r.quality) for r in sample.select("doc_id", "text", "quality").mapInArrow(features, "x binary, chars binary, quality int").collect())
    if not rows:
        return fit(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    if sum(len(c) for _, c, _ in rows) > 4 * GROUP_LINES:
        rows.sort(key=lambda r: len(r[1]))  # a group takes as many steps as its longest document has lines
    per_text, quality = np.array([len(c) // 4 for _, c, _ in rows]), np.array([q for _, _, q in rows], float)
    x, chars = (np.frombuffer(b"".join(r[k] for r in rows), "<f4") for k in (0, 1))
    del rows
    return fit(x.reshape(-1, FEATURES), chars, per_text, quality)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds the score as column ``name`` to all columns of ``docs``; null text is empty. Rows stay where they are."""
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for b in batches:
            out = [model.scores(texts) for _, texts in _batches(b, place)]
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*names, name])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{ddl}, `{name}` double")


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every row of ``documents``.

    Empty and null texts are one empty line and get the score that the field
    gives it. A null doc_id is not held out. Without labels all scores are 0.5.
    Repeated rows get equal scores; other columns are ignored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for b in batches:
            out = [model.scores(texts) for _, texts in _batches(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
