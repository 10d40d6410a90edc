"""Quality by Bradley-Terry pairwise ranking.

A document's worth is a linear function of counted features of its text. It is learned
from preference pairs, every good document over every bad one, by logistic loss on the
difference of their features. The cut is a quantile of the training scores: the share
of bad documents; a score is the logistic of the distance from it.

All labelled documents teach. The pairs are never written out: what a document pulls at the
weights depends on its own worth and on how the worths of the other label lie, so a pass
counts the documents and sums the features of each label by bins of worth, and the pairs are
those of bins. Means, spreads and the cut are exact ones of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.llm import _text as T
from lexigate.llm._session import cut, drop, prepare

#: Weight decay, length of the slope at which training ends, passes at most, and earlier steps that tell the curvature.
DECAY, FLAT, PASSES, MEMORY = 1e-3, 1e-4, 150, 10
#: Bins of worth to a unit at 0; they widen with the worth, so that it has no bound.
BINS = 64
#: Features are summed as whole numbers of this fraction, so that their order does not matter.
UNIT = 1 << 20

_UPPER, _LETTER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[0x41:0x5B] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = _DIGIT[0x30:0x3A] = True
#: Byte classes: one for each printable non-letter, then letters, upper case, high bytes, the rest.
_CLASS = np.full(256, 0, np.int64)
_PUNCTUATION = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
for _i, _b in enumerate(_PUNCTUATION):
    _CLASS[_b] = 5 + _i
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 4
CLASSES = 5 + len(_PUNCTUATION)
FEATURES = CLASSES + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of bounded features for each text of a block; all 0 for an empty text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    row = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, FEATURES))
    counts = np.bincount(row * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    out[:, :CLASSES] = np.sqrt(counts / size[:, None])
    w = T.words(data, offsets, T.SPACE_WORDS)
    words = np.maximum(np.diff(w.first), 1)
    some = np.diff(w.first) > 0
    h = T.span_hash(data, w.start, w.end)
    salt = w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def repeats(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Share of each row's keys that occurred before in the row."""
        first = np.zeros(len(keys), bool)
        first[np.unique(T.mix(keys + salt[at]), return_index=True)[1]] = True
        return np.bincount(w.row[at][~first], minlength=n) / words

    every = np.arange(len(h))
    two, three = (np.flatnonzero(w.row[k:] == w.row[:-k]) if len(h) > k else every[:0] for k in (1, 2))
    out[:, CLASSES] = np.where(some, repeats(h, every), 0)
    out[:, CLASSES + 1] = np.where(some, repeats(T.window_hash(h, 3)[three], three), 0) if len(three) else 0
    out[:, CLASSES + 2] = np.bincount(w.row[two][h[two] == h[two + 1]], minlength=n) / words if len(two) else 0
    length = np.bincount(w.row, w.end - w.start, n) / words
    out[:, CLASSES + 3] = np.minimum(length / 10, 2)
    out[:, CLASSES + 4] = np.minimum(np.log1p(words * some) / 10, 1)
    odd = ~_LETTER[data[w.end - 1]] & ~_DIGIT[data[w.end - 1]] if len(h) else np.zeros(0, bool)
    out[:, CLASSES + 5] = np.bincount(w.row[odd], minlength=n) / words
    shout = (w.end - w.start > 1) & _UPPER[data[w.start]] & _UPPER[data[np.minimum(w.start + 1, len(data) - 1)]] if len(h) else np.zeros(0, bool)
    out[:, CLASSES + 6] = np.bincount(w.row[shout], minlength=n) / words
    out[:, CLASSES + 7] = some
    return out


@dataclass
class Model:
    """Weights over scaled features, and the cut between bad and good."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        worth = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(worth, -40, 40)))


def _scaled(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled features of some rows of (label, x)."""
    x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES).astype(float)
    return np.clip((x - mean) / scale, -8, 8)


def _sums(values, bins):
    """(label, bin, n, s0, s1, ...) of a task's rows: sums of ``values`` in UNITs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            v = values(batch)
            keys, inverse = np.unique(np.stack([batch.column(0).to_numpy(), bins(v)]).astype(np.int64), axis=1, return_inverse=True)
            whole = np.column_stack([np.ones(len(v)), np.rint(v * UNIT)])
            total = np.zeros((keys.shape[1], whole.shape[1]), np.int64)
            np.add.at(total, inverse.reshape(-1), whole.astype(np.int64))
            for key, row in zip(map(tuple, keys.T.tolist()), total, strict=True):
                held[key] = held[key] + row if key in held else row
        if held:
            columns = np.column_stack([np.array(list(held)), np.stack(list(held.values()))])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.T], ["label", "bin", "n", *[f"s{i}" for i in range(columns.shape[1] - 3)]])

    return run


def _summed(rows: DataFrame, values, bins, width: int) -> np.ndarray:
    """The rows of ``_sums`` over all tasks, in order: a bounded number of bins."""
    names = ["n", *[f"s{i}" for i in range(width)]]
    parts = rows.mapInArrow(_sums(values, bins), ", ".join(f"{c} bigint" for c in ("label", "bin", *names)))
    found = parts.groupBy("label", "bin").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    table = np.stack([found.column(c).to_numpy() for c in ("label", "bin", *names)], axis=1).astype(float)
    table[:, 3:] /= UNIT
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def _loss(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of all pairs of a good and a bad row, with decay, and its slope; pairs are taken bin by bin."""
    table = _summed(rows, lambda batch: _scaled(batch, mean, scale), lambda z: np.rint(BINS * np.arcsinh(z @ w)), FEATURES)
    good, bad = table[table[:, 0] == 1], table[table[:, 0] == 0]
    (n, x), (m, y) = ((t[:, 2], t[:, 3:]) for t in (good, bad))
    d = (x @ w / n)[:, None] - (y @ w / m)[None, :]
    pairs = n.sum() * m.sum()
    pull = 1 / (1 + np.exp(np.clip(d, -700, 700)))
    slope = (pull.T @ n) @ y - (pull @ m) @ x
    return float(n @ np.logaddexp(0, -d) @ m / pairs + DECAY / 2 * w @ w), slope / pairs + DECAY * w


def _weights(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The weights of least loss, by limited-memory BFGS (Nocedal 1980); a pass over the rows for each slope."""
    w, steps = np.zeros(FEATURES), []
    loss, slope = _loss(rows, mean, scale, w)
    passes = 1
    while passes < PASSES and np.linalg.norm(slope) > FLAT:
        way, back = slope.copy(), []
        for s, y in reversed(steps):
            back.append(s @ way / (s @ y))
            way -= back[-1] * y
        if steps:
            way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1])
        for (s, y), k in zip(steps, reversed(back), strict=True):
            way += (k - y @ way / (s @ y)) * s
        size = 1.0
        while passes < PASSES:
            new_loss, new_slope = _loss(rows, mean, scale, w - size * way)
            passes += 1
            if new_loss <= loss - 1e-4 * size * (slope @ way):
                break
            size /= 2
        else:
            break
        s, y = -size * way, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        w, loss, slope = w + s, new_loss, new_slope
    return w


def _cut(worth: DataFrame, k: int) -> float:
    """The middle between the k-th and the next of all values of column worth (k from 1, below their number)."""
    low, high, below = None, None, 0
    while True:
        some = worth if low is None else worth.where(F.col("worth").between(low, high))
        ends = (low, high) if low is not None else some.agg(F.min("worth"), F.max("worth")).first()
        low, high = ends
        if low == high:
            return low
        place = F.floor((F.col("worth") - F.lit(low)) / F.lit(high - low) * F.lit(1024.0)).alias("bin")
        found = sorted(map(tuple, some.groupBy(place).agg(F.count("*"), F.min("worth"), F.max("worth")).collect()))
        for i, (_, n, first, last) in enumerate(found):
            if below + n == k and i + 1 < len(found):
                return (last + found[i + 1][2]) / 2
            if below + n > k:
                break
            below += n
        low, high = first, last


def train(rows: DataFrame) -> Model:
    """Fit on all rows of (label of 0 or 1, x array<float>); with one label only, every document scores 1/2."""
    plain, once = np.zeros(FEATURES), np.ones(FEATURES)
    values = lambda batch: (lambda x: np.column_stack([x, x * x]))(_scaled(batch, plain, once))
    table = _summed(rows, values, lambda v: np.zeros(len(v)), 2 * FEATURES)
    if not len(table):
        return Model(plain, once, np.zeros(FEATURES), 0.0)
    n = table[:, 2].sum()
    mean, square = table[:, 3 : 3 + FEATURES].sum(axis=0) / n, table[:, 3 + FEATURES :].sum(axis=0) / n
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 0.02
    if len(table) < 2:
        return Model(mean, scale, np.zeros(FEATURES), 0.0)
    w = _weights(rows, mean, scale)

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_scaled(batch, mean, scale) @ w)], ["worth"])

    return Model(mean, scale, w, _cut(rows.mapInArrow(worth, "worth double"), int(table[0, 2])))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in T.blocks(batch):
            x = features(data, offsets).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * FEATURES, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat], ["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on all labelled documents (labels: doc_id, label of 0 or 1).

    An id with both labels teaches both, and each of its texts teaches; null labels, null ids and
    null texts teach nothing. Features are computed before labels are joined, so no text is shuffled,
    and written once; training passes over them and brings sums of a bounded number of bins to the driver.
    """
    prepare(docs.sparkSession)
    known = labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("bigint").alias("label")).distinct()
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = cut(texts.mapInArrow(_features, f"doc_id {kind}, x array<float>").join(known.hint("merge"), "doc_id").select("label", "x"))
    model = train(rows)
    drop(rows)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each whole text: 0 to 1, higher where the good label is likelier.

    Null texts count as empty, and empty ones are scored as such. Rows are returned one for
    one, repeated ones too; an empty table gives an empty result. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.blocks(batch):
                p = model.probability(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], ["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {kind}, score double")
