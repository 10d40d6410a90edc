"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on a bounded
number of labelled documents. It reads a text in windows of ``WINDOW`` bytes, labels
every byte position, and a document's probabilities are the mean over its positions.
The weights are a few kilobytes and travel with the task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigate.llm import _text as T
from lexigate.llm._sample import bounded
from lexigate.llm._session import prepare

#: Bytes that one run of the recurrence reads; states start anew in each window.
WINDOW = 48
HIDDEN = 6
#: Labelled documents of each language that the network is fitted on, about, at most.
SAMPLE = 600
#: Windows taken from each of them, at most.
WINDOWS_EACH = 12
#: Windows that advance together.
LANES = 2048
STEPS, BATCH, RATE = 420, 192, 0.02
#: Label of texts without a letter.
UNKNOWN = "und"

_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[0x41:0x5B] = _LETTER_BYTE[0x61:0x7B] = True


def _squash(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Softsign x / (1 + |x|) in place: the bounded activation of gates and candidates."""
    d = np.abs(x, out=room)
    d += np.float32(1)
    x /= d
    return x


@dataclass
class Network:
    """Weights of both directions: input tables (256, 3H), recurrent (H, 3H), and the output layer.

    The three parts of a gate matrix are update, reset and candidate.
    """

    languages: list[str]
    weights: dict[str, np.ndarray]

    def _direction(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (T, B, H) of one direction for bytes x (T, B), and what its gradient needs."""
        table, u, hidden = self.weights[f"in_{d}"], self.weights[f"rec_{d}"], HIDDEN
        steps, size = x.shape
        h, states, trace = np.zeros((size, hidden), np.float32), np.empty((steps, size, hidden), np.float32), []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            a = table[x[t]]
            zr = 0.5 + 0.5 * _squash(a[:, : 2 * hidden] + h @ u[:, : 2 * hidden])
            z, r = zr[:, :hidden], zr[:, hidden:]
            rh = r * h
            c = _squash(a[:, 2 * hidden :] + rh @ u[:, 2 * hidden :])
            new = h + z * (c - h)
            trace.append((t, h, z, r, rh, c))
            h = states[t] = new
        return states, trace

    def fit_step(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the live positions and its gradient, by backpropagation through time."""
        w, n = self.weights, live.sum()
        both = {d: self._direction(x, d) for d in "fb"}
        states = np.concatenate([both["f"][0], both["b"][0]], axis=2)
        logits = states @ w["out"] + w["bias"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        target = np.eye(len(self.languages), dtype=np.float32)[y][None]
        loss = float(-(np.log(p + 1e-9) * target * live[:, :, None]).sum() / n)
        d_logits = (p - target) * live[:, :, None] / n
        grad = {"out": np.einsum("tbh,tbk->hk", states, d_logits), "bias": d_logits.sum(axis=(0, 1))}
        d_states = d_logits @ w["out"].T
        for i, d in enumerate("fb"):
            u = w[f"rec_{d}"]
            g_in, g_rec = np.zeros_like(w[f"in_{d}"]), np.zeros_like(u)
            carry = np.zeros_like(both[d][0][0])
            for t, h, z, r, rh, c in reversed(both[d][1]):
                dh = d_states[t][:, i * HIDDEN : (i + 1) * HIDDEN] + carry
                dc = dh * z * (1 - np.abs(c)) ** 2  # the slope of softsign, from its value
                dz = dh * (c - h) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                d_gates = np.concatenate([dz, dr, dc], axis=1)
                np.add.at(g_in, x[t], d_gates)
                g_rec[:, : 2 * HIDDEN] += h.T @ d_gates[:, : 2 * HIDDEN]
                g_rec[:, 2 * HIDDEN :] += rh.T @ dc
                carry = dh * (1 - z) + drh * r + d_gates[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
            grad[f"in_{d}"], grad[f"rec_{d}"] = g_in, g_rec
        return loss, grad

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (K, T, B) of every position of bytes x (T, B).

        Both directions advance together: one step reads byte t forwards and byte
        T - 1 - t backwards, with the recurrent matrices as blocks of one.
        """
        w, n = self.weights, HIDDEN
        steps, size = x.shape
        u_gate, u_cand = np.zeros((2 * n, 4 * n), np.float32), np.zeros((2 * n, 2 * n), np.float32)
        table = [np.zeros((256, 6 * n), np.float32) for _ in "fb"]
        for i, d in enumerate("fb"):
            rows = slice(i * n, (i + 1) * n)
            for part in range(3):  # update gates of both directions, then reset gates, then candidates
                at = slice((2 * part + i) * n, (2 * part + i + 1) * n)
                table[i][:, at] = w[f"in_{d}"][:, part * n : (part + 1) * n]
                if part < 2:
                    u_gate[rows, at] = w[f"rec_{d}"][:, part * n : (part + 1) * n]
            u_cand[rows, rows] = w[f"rec_{d}"][:, 2 * n :]
        h = np.zeros((size, 2 * n), np.float32)
        a, back = np.empty((size, 6 * n), np.float32), np.empty((size, 6 * n), np.float32)
        zr, c, rh = np.empty((size, 4 * n), np.float32), np.empty((size, 2 * n), np.float32), np.empty((size, 2 * n), np.float32)
        room, half = np.empty_like(zr), np.empty_like(c)
        states = np.empty((steps, size, 2 * n), np.float32)
        for t in range(steps):
            np.take(table[0], x[t], axis=0, out=a, mode="clip")
            np.take(table[1], x[steps - 1 - t], axis=0, out=back, mode="clip")
            a += back
            np.matmul(h, u_gate, out=zr)
            zr += a[:, : 4 * n]
            _squash(zr, room)
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            np.multiply(zr[:, 2 * n :], h, out=rh)
            np.matmul(rh, u_cand, out=c)
            c += a[:, 4 * n :]
            _squash(c, half)
            c -= h
            c *= zr[:, : 2 * n]
            h += c
            states[t, :, :n] = h[:, :n]
            states[steps - 1 - t, :, n:] = h[:, n:]
        p = w["out"].T @ states.reshape(-1, 2 * n).T
        p += w["bias"][:, None]
        np.exp(p, out=p)  # states lie in -1 to 1, so the sums are bounded
        p /= p.sum(axis=0)
        return p.reshape(-1, steps, size)

    def document(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pooled probabilities of each row of a block, 0 where the row is empty."""
        size = np.diff(offsets)
        each = -(-size // WINDOW)
        total = int(each.sum())
        out = np.zeros((len(size), len(self.languages)))
        if not total:
            return out
        row = np.repeat(np.arange(len(size)), each)
        k = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
        begin = offsets[row] + k * WINDOW
        length = np.minimum(WINDOW, offsets[row + 1] - begin)
        for i in range(0, total, LANES):
            part = slice(i, i + LANES)
            at = begin[part][None, :] + np.arange(WINDOW)[:, None]
            live = np.arange(WINDOW)[:, None] < length[part][None, :]
            x = np.where(live, data[np.minimum(at, len(data) - 1)], 0x20)
            p = self.label(x)
            p *= live
            for k_, pooled in enumerate(p.sum(axis=1)):
                out[:, k_] += np.bincount(row[part], pooled, len(size))
        return out / np.maximum(size, 1)[:, None]


def windows_of(raw: bytes, seed: int) -> list[bytes]:
    """Up to WINDOWS_EACH of a text's windows, chosen by the seed."""
    n = max(1, -(-len(raw) // WINDOW))
    chosen = np.random.default_rng(seed).choice(n, min(n, WINDOWS_EACH), replace=False)
    return [raw[i * WINDOW : (i + 1) * WINDOW] for i in chosen.tolist()]


def train(texts: list[str], labels: list[str]) -> Network:
    """Fit the network on labelled texts."""
    cut = [(w, label) for i, (text, label) in enumerate(zip(texts, labels, strict=True)) for w in windows_of(text.encode(), i)]
    return train_windows([w for w, _ in cut], [label for _, label in cut])


def train_windows(windows: list[bytes], labels: list[str], seed: int = 11) -> Network:
    """Fit the network on labelled windows with Adam; the labels weigh equally."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    h3, k = 3 * HIDDEN, len(languages)
    w: dict[str, np.ndarray] = {"out": rng.normal(0, 0.3, (2 * HIDDEN, k)), "bias": np.zeros(k)}
    for d in "fb":
        w[f"in_{d}"], w[f"rec_{d}"] = rng.normal(0, 0.4, (256, h3)), rng.normal(0, 0.3, (HIDDEN, h3))
        w[f"in_{d}"][:, :HIDDEN] -= 1.0  # remember at first
    net = Network(languages, {name: v.astype(np.float32) for name, v in w.items()})
    pool: list[list[bytes]] = [[] for _ in languages]
    for window, label in zip(windows, labels, strict=True):
        pool[languages.index(label)].append(window)
    if k < 2:
        return net
    mean = {n: np.zeros_like(v) for n, v in net.weights.items()}
    square = {n: np.zeros_like(v) for n, v in net.weights.items()}
    for step in range(1, STEPS + 1):
        y = rng.integers(0, k, BATCH)
        rows = [pool[c][rng.integers(len(pool[c]))] for c in y.tolist()]
        x = np.frombuffer(b"".join(r.ljust(WINDOW) for r in rows), np.uint8).reshape(BATCH, WINDOW).T
        live = (np.arange(WINDOW)[:, None] < np.array([len(r) for r in rows])[None, :]).astype(np.float32)
        _, grad = net.fit_step(np.ascontiguousarray(x), y, live)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, step / 20) * (0.1 ** (step / STEPS))
        for name, g in grad.items():
            g = g / max(1.0, norm)
            mean[name] = 0.9 * mean[name] + 0.1 * g
            square[name] = 0.99 * square[name] + 0.01 * g * g
            net.weights[name] -= (rate * mean[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, train_rows: Column, lang: str = "lang") -> Network:
    """Train on at most SAMPLE documents of each language among ``train_rows``.

    The choice follows a hash of the text, so it is the same at each run. Documents
    without a letter or a language teach nothing. Windows are cut in the tasks, so that the
    driver gets WINDOWS_EACH of WINDOW bytes for a document, however long its text.
    """
    prepare(docs.sparkSession)
    pick = docs.where(train_rows & F.col(lang).isNotNull() & F.col("text").rlike(r"\p{L}"))
    pick = pick.select(F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    chosen = F.broadcast(bounded(pick, "lang", SAMPLE))  # SAMPLE rows for each language
    texts = pick.withColumn("h", F.xxhash64("text")).join(chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    rows = texts.select("lang", "h", "text").mapInArrow(_cut_windows, "lang string, h bigint, window binary").toArrow().sort_by([("h", "ascending"), ("lang", "ascending"), ("window", "ascending")])
    return train_windows(rows.column("window").to_pylist(), rows.column("lang").to_pylist())


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, h, cut = [], [], []
        for name, value, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for w in windows_of(text.encode(), value & 0xFFFFFFFF):
                lang.append(name)
                h.append(value)
                cut.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h, pa.int64()), pa.array(cut, pa.binary())], ["lang", "h", "window"])


def _letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in set(text))


def _predict(net: Network):
    names = np.array([*net.languages, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for a, b, data, offsets in T.blocks(batch):
                p = net.document(data, offsets)
                count = np.concatenate([[0], np.cumsum(_LETTER_BYTE[data])])
                letter = count[offsets[1:]] > count[offsets[:-1]]
                for i in np.flatnonzero(~letter):
                    letter[i] = _letter(data[offsets[i] : offsets[i + 1]].tobytes().decode())
                best = p.argmax(axis=1) if len(net.languages) else np.zeros(b - a, int)
                lang.append(np.where(letter & (len(net.languages) > 0), best, len(net.languages)))
                score.append(np.where(letter & (len(net.languages) > 0), p[np.arange(b - a), best] if len(net.languages) else 0.0, 0.0))
            flat = np.concatenate(lang) if lang else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[flat].tolist(), pa.string()), pa.array(np.clip(np.concatenate(score), 0, 1) if score else [], pa.float64())], ["carry", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network, carry: Column) -> DataFrame:
    """(carry, lang_pred, score) of each row by the network; reads the text and nothing else.

    Texts that are null, empty or without a letter are UNKNOWN with score 0. Rows are
    returned one for one, repeated ones too; an empty table gives an empty result, and a
    network that has learned no language calls everything UNKNOWN.
    """
    prepare(docs.sparkSession)
    source = docs.select(carry.alias("carry"), F.col("text").cast("string").alias("text"))
    kind = source.schema["carry"].dataType.simpleString()
    return source.mapInArrow(_predict(net), f"carry {kind}, lang_pred string, score double")
