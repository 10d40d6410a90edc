"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is one Arrow batch of documents. Its words become codes of the benchmark's own
vocabulary; only runs of such words that are long enough to hold a window are indexed,
since no occurrence can lie elsewhere. The index keeps the Burrows-Wheeler transform in
a wavelet matrix with cumulative ranks, and every ``SAMPLE``-th suffix position. All
windows are searched backwards at once; occurrences are located by stepping to the next
sampled suffix, and their spans are merged.

The benchmark is sent to the executors in slices of a checked size, so it may grow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.llm import _text as T
from lexigate.llm._session import cut, prepare

WINDOW = 10
SAMPLE = 16
#: Most bytes of benchmark text in one broadcast slice.
SLICE_BYTES = 8 << 20


class WaveletMatrix:
    """Access and rank over a code sequence, one level for each bit of a code."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        cur = codes
        for k in reversed(range(bits)):
            bit = (cur >> k) & 1
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each code occurs before position i."""
        lo, hi = np.zeros_like(i), i
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (code >> (self.bits - 1 - level)) & 1
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + lo1, lo - lo1), np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code at each position, and its rank there."""
        code, lo, hi = np.zeros_like(i), np.zeros_like(i), i
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[hi + 1] - ones[hi]
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + lo1, lo - lo1), np.where(bit, zeros + hi1, hi - hi1)
            code = (code << 1) | bit
        return code, hi - lo


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. The last code is the least and single."""
    n = len(codes)
    rank = codes.astype(np.int64)
    k = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(np.diff(key[order]) != 0)
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if k >= n:
            k = n - 1


class FMIndex:
    """Codes from 1 up; 0 is the end mark that the index adds."""

    def __init__(self, codes: np.ndarray, sigma: int):
        codes = np.append(codes, 0).astype(np.int64)
        order = suffix_array(codes)
        bwt = codes[order - 1]
        self.n = len(codes)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma + 1))]).astype(np.int64)
        self.matrix = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        marked = order % SAMPLE == 0
        self.mark = np.concatenate([[0], np.cumsum(marked)])
        self.sample = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end suffix of each phrase (a row of codes)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            c = phrases[live, j]
            lo[live] = self.start[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.start[c] + self.matrix.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, by steps back to a sampled one."""
        out, left, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            hit = self.mark[row + 1] > self.mark[row]
            out[left[hit]] = self.sample[self.mark[row[hit]]] + steps
            left, row = left[~hit], row[~hit]
            if len(left):
                code, rank = self.matrix.access(row)
                row = self.start[code] + rank
            steps += 1
        return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[T.Words, np.ndarray]:
    data = T.LOWER[data]
    w = T.words(data, offsets, T.ALNUM_WORDS)
    return w, T.span_hash(data, w.start, w.end)


class Phrases:
    """The windows of some benchmark items as codes of their own vocabulary."""

    def __init__(self, texts: list[str], window: int):
        raw = [x.encode() for x in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        w, h = _words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.vocabulary, code = np.unique(h, return_inverse=True)
        self.flag = np.zeros(1 << 20, bool)
        self.flag[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, (i, j) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            k = min(window, j - i)
            for s in range(i, j - k + 1) if k else ():
                found.setdefault(k, []).append((code[s : s + k] + 2, item))  # 1 separates runs
        #: length -> (distinct windows, item of each pair, window of each pair)
        self.by_length = {}
        for k, rows in found.items():
            grid, of = np.unique(np.array([r[0] for r in rows]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([of.reshape(-1), np.array([r[1] for r in rows])], axis=1), axis=0)
            self.by_length[k] = (grid, pairs, np.searchsorted(pairs[:, 0], np.arange(len(grid) + 1)))
        self.shortest = min(found, default=0)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Code of each word, 0 where the benchmark has no such word."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.flag[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, h[maybe])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == h[maybe]
        out[maybe[same]] = at[same] + 2
        return out


def _search(text: np.ndarray, own: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(hit flag of each code, distinct (owner row, item) pairs) for a shard's runs of codes."""
    index = FMIndex(text, len(phrases.vocabulary) + 2)
    cover, pairs = np.zeros(len(text) + 1, np.int64), [np.zeros((0, 2), np.int64)]
    for k, (grid, items, first) in phrases.by_length.items():
        lo, hi = index.search(grid)
        count = hi - lo
        which = np.repeat(np.arange(len(grid)), count)
        if not len(which):
            continue
        ends = np.cumsum(count)
        at = index.locate(np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(lo, count))
        cover += np.bincount(at, minlength=len(cover)) - np.bincount(at + k, minlength=len(cover))
        seen = np.unique(np.stack([own[at], which], axis=1), axis=0)
        n = first[seen[:, 1] + 1] - first[seen[:, 1]]
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[seen[:, 1]], n)
        pairs.append(np.stack([np.repeat(seen[:, 0], n), items[flat, 1]], axis=1))
    return np.cumsum(cover[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _merge(old: list[int] | None, new: list[int]) -> list[int]:
    """Union of spans, each (start byte, end byte, first word, end word)."""
    spans = sorted(tuple(x[i : i + 4]) for x in (old or [], new) for i in range(0, len(x), 4))
    spans.sort(key=lambda s: s[2])
    out: list[list[int]] = []
    for s in spans:
        if out and s[2] <= out[-1][3]:
            if s[3] > out[-1][3]:
                out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return [x for s in out for x in s]


def _without(text: str, spans: list[int]) -> str:
    raw, out, at = text.encode(), [], 0
    for i in range(0, len(spans), 4):
        out.append(raw[at : spans[i]])
        at = spans[i + 1]
    return b"".join([*out, raw[at:]]).decode()


def _scan(phrases: Phrases, ids: list[str | None], keep: str):
    """Search one slice of the benchmark; keep: "" (no text), "text" or "clean" (spans removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words = np.zeros(n, np.int64)
            gap = np.array([[1, -1, -1, -1, -1]])  # separates runs: code, row, start byte, end byte, word
            parts = [gap]
            for a, b, data, offsets in T.blocks(batch):
                w, h = _words(data, offsets)
                n_words[a:b] = np.diff(w.first)
                c = phrases.codes(h)
                inside = np.flatnonzero(c)
                if not len(inside):
                    continue
                row = w.row[inside]
                fresh = np.concatenate([[True], (np.diff(inside) > 1) | (np.diff(row) > 0)])
                keep_run = np.bincount(np.cumsum(fresh) - 1) >= phrases.shortest
                kept = keep_run[np.cumsum(fresh) - 1]
                inside, row, fresh = inside[kept], row[kept], fresh[kept]
                if len(inside):
                    rows = np.stack([c[inside], row + a, w.start[inside] - offsets[row], w.end[inside] - offsets[row], inside - w.first[row]], axis=1)
                    parts += [np.insert(rows, np.flatnonzero(fresh)[1:], gap, axis=0), gap]
            spans: list[list[int]] = [x or [] for x in batch.column(batch.schema.get_field_index("spans")).to_pylist()]
            items: list[list] = [x or [] for x in batch.column(batch.schema.get_field_index("items")).to_pylist()]
            fresh_spans: dict[int, list[int]] = {}
            if len(parts) > 1:
                text = np.concatenate(parts)
                hit, pairs = _search(text[:, 0], text[:, 1], phrases)
                hit &= text[:, 1] >= 0
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    fresh_spans.setdefault(int(text[i, 1]), []).extend((int(text[i, 2]), int(text[j - 1, 3]), int(text[i, 4]), int(text[j - 1, 4]) + 1))
                for row, item in pairs.tolist():
                    items[row].append(ids[item])
            for row, new in fresh_spans.items():
                spans[row] = _merge(spans[row], new)
            n_hit = [sum(s[3::4]) - sum(s[2::4]) for s in spans]
            names = ["carry", "n_words", "n_hit", "spans", "items"]
            columns = [batch.column(0), pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            if keep:
                column = batch.column(1).to_pylist() if keep == "clean" else batch.column(1)
                if keep == "clean":
                    column = pa.array([x if not spans[i] else _without(x, spans[i]) for i, x in enumerate(column)], pa.string())
                names, columns = [names[0], "text", *names[1:]], [columns[0], column, *columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _slices(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about SLICE_BYTES of text at most."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / SLICE_BYTES))
    return [benchmark.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [benchmark]


def _annotate(docs: DataFrame, carry, benchmark: DataFrame, window: int, keep: str) -> DataFrame:
    """carry, (text,) n_words, n_hit, spans, items for each row, slice after slice of the benchmark."""
    prepare(docs.sparkSession)
    source = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    parts = _slices(source)
    df = docs.select(carry.alias("carry"), F.col("text").cast("string").alias("text"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    kind = df.schema["carry"].dataType.simpleString()
    for i, part in enumerate(parts):
        rows = part.orderBy("item_id", "text").collect()  # one slice: about SLICE_BYTES at most
        last = i + 1 == len(parts)
        kept = keep if last else "text"
        schema = f"carry {kind}, " + ("text string, " if kept else "") + "n_words bigint, n_hit bigint, spans array<bigint>, items array<string>"
        df = df.mapInArrow(_scan(Phrases([r["text"] for r in rows], window), [r["item_id"] for r in rows], kept), schema)
        if not last:
            df = cut(df.select("carry", "text", "spans", "items"))
    return df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    Words are runs of bytes 0-9, a-z (A-Z lower-cased) and 80-FF. A window is ``window``
    consecutive words of an item; an item with fewer, but not none, is one window.
    Null texts and items have no words; an empty benchmark hits nothing. Rows are
    returned one for one, repeated ones too. Item ids are compared as strings; null ids
    are left out of ``items`` while their hits count. Other columns are ignored.

    Returns doc_id, n_words, n_hit, items (distinct ids in string order) and spans (the
    merged hits, flat: start byte, end byte, first word, end word).
    """
    found = _annotate(docs, F.col("doc_id"), benchmark, window, "").withColumnRenamed("carry", "doc_id")
    return found.withColumn("items", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with the merged spans of benchmark passages cut out of their texts.

    A document that keeps no word is dropped if the cut took its last one. Others, those
    without words among them, stay. All columns are returned as they are.
    """
    found = _annotate(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), benchmark, window, "clean")
    left = found.where("n_hit = 0 or n_hit < n_words")
    return left.select(*[(F.col("text") if c == "text" else F.col(f"carry.`{c}`")).alias(c) for c in docs.columns])
