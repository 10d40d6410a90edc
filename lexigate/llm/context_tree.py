"""Language-model scores by context-tree weighting, beside a unigram base.

A text is a sequence of words, each coded as its bytes and a closing space, and one end
mark. Every byte is coded by its eight bits; a bit's context is the bits before it and
the last 0 to ``DEPTH`` bytes of the text, over the borders of words (spaces before its
first byte), or those of its word alone. At each node of
the context tree a Krichevsky-Trofimov estimate of the node is mixed, half and half, with
the product of its children, over all depths down to the leaves; a child that training
has not seen gives every bit 1/2.

The tree holds every context of the training texts and lies in no one place: grams (context
and byte) are dealt out by the last two bytes of their context, so that a task has whole
subtrees, weighs them bottom-up and hands up what depth 2 comes to; the top of two depths is
one small array; then the tasks go down their subtrees again and give the probability of
every gram that any text has. A text's code length is the sum over its grams. Most grams are
looked up in a broadcast table of fixed size; the others are joined with the full table. Where
contexts are those of a word, its code length depends on the word alone and is looked up or
joined with the word's count, as the unigram base needs anyway.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigate.llm import _text as T
from lexigate.llm._session import cut, drop, prepare

DEPTH = 5
#: Depth of the contexts that a task has whole, and grams that it weighs at a time (one larger subtree makes its own chunk).
ROOT, CHUNK = 2, 1 << 18
#: Words, and grams, in the broadcast tables of counts and code lengths, at most.
TABLE = 1 << 18
#: Distinct words that a task holds before it passes them on.
HELD = 1 << 18
SPACE, END = 0x20, 0x0A


def _coded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, byte, word) of every coded byte of some words: the last DEPTH bytes packed, latest lowest."""
    size = end - start + DEPTH + 1
    first = np.cumsum(size) - size
    flat = np.full(int(size.sum()), SPACE, np.int64)
    length = end - start
    word = np.repeat(np.arange(len(start)), length)
    place = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    flat[np.repeat(first + DEPTH, length) + place] = data[np.repeat(start, length) + place]
    context = np.zeros(len(flat), np.int64)
    for k in range(1, DEPTH + 1):
        context[DEPTH:] |= flat[DEPTH - k : len(flat) - k] << (8 * (k - 1))
    owner = np.repeat(np.arange(len(start)), size)
    live = np.arange(len(flat)) - np.repeat(first, size) >= DEPTH
    return context[live], flat[live], owner[live]


def _text_grams(data: np.ndarray, w: T.Words, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, gram, row from the first) of every coded byte of some rows, about BLOCK bytes at a time."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + T.BLOCK, "right")) - 1)
        p, q = w.first[a], w.first[b]
        start, row, length = w.start[p:q], w.row[p:q] - a, w.end[p:q] - w.start[p:q]
        size = np.bincount(row, length + 1, b - a).astype(np.int64) + DEPTH + 1
        first = np.cumsum(size) - size
        before = np.cumsum(np.append(0, length + 1))
        at = (first - before[w.first[a:b] - p])[row] + DEPTH + before[:-1]
        flat = np.full(int(size.sum()), SPACE, np.int64)
        word = np.repeat(np.arange(len(start)), length)
        place = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
        flat[at[word] + place] = data[start[word] + place]
        flat[first + size - 1] = END
        gram = flat.copy()
        for k in range(1, DEPTH + 1):
            gram[DEPTH:] |= flat[DEPTH - k : len(flat) - k] << (8 * k)
        live = np.arange(len(flat)) - np.repeat(first, size) >= DEPTH
        yield a, b, gram[live], np.repeat(np.arange(b - a), size)[live]
        a = b


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of the grams of whole texts, about HELD at a time; n counts training rows (column 0) only."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        gram, n = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held[:] = [(gram, n)]
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    for batch in batches:
        learn = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
        for a, _, data, offsets in T.blocks(batch):
            data = T.LOWER[data]
            for i, j, gram, row in _text_grams(data, T.words(data, offsets, T.SPACE_WORDS), offsets):
                held.append(_merged(gram, learn[a + i : a + j][row]))
        if sum(len(x) for x, _ in held) > 4 * HELD:
            rows = out()
            if len(rows) > 2 * HELD:
                held.clear()
                yield rows
    if held:
        yield out()


_BOUNDARY = int.from_bytes(bytes([SPACE] * DEPTH), "little")


def _distinct(batch: pa.RecordBatch):
    """Distinct words of a block of rows: (rows, bytes, offsets, words, hashes, one start and end, inverse)."""
    for a, b, data, offsets in T.blocks(batch, size=1 << 21):
        data = T.LOWER[data]
        w = T.words(data, offsets, T.SPACE_WORDS)
        h = np.concatenate([T.span_hash(data[i:j], w.start[p:q] - i, w.end[p:q] - i) for i, j, p, q in _pieces(w, offsets)] or [np.zeros(0, np.uint64)]).view(np.int64)
        keys, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        yield a, b, data, offsets, w, keys, w.start[index], w.end[index], inverse


def _pieces(w: T.Words, offsets: np.ndarray):
    """Runs of rows of about BLOCK bytes, so that hashing works in cached memory."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + T.BLOCK, "right")) - 1)
        yield offsets[a], offsets[b], w.first[a], w.first[b]
        a = b


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, word): the distinct words of some texts; n counts training rows (column 0) only."""
    held: dict[int, list] = {}

    def out() -> pa.RecordBatch:
        columns = [pa.array(held.keys(), pa.int64()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "n", "word"])

    for batch in batches:
        learn = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for a, b, data, _, w, keys, start, end, inverse in _distinct(batch):
            count = np.bincount(inverse, learn[a:b][w.row], len(keys)).astype(np.int64).tolist()
            raw = data.tobytes()
            for key, n, i, j in zip(keys.tolist(), count, start.tolist(), end.tolist(), strict=True):
                if (have := held.get(key)) is None:
                    held[key] = [n, raw[i:j]]
                else:
                    have[0] += n
            if len(held) > HELD:
                yield out()
    yield out()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, times, n) of the grams of words: a gram packs DEPTH context bytes and the coded byte."""
    for batch in batches:
        words = batch.column(2).to_pylist()
        size = np.array([len(x) for x in words], np.int64)
        end = np.cumsum(size)
        context, byte, owner = _coded(np.frombuffer(b"".join(words), np.uint8), end - size, end)
        order = np.lexsort((context << 8 | byte, owner))
        gram, owner = (context << 8 | byte)[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])) if len(gram) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(gram)))
        n = batch.column(1).to_numpy()[owner[new]] * times
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[new])), pa.array(gram[new]), pa.array(times), pa.array(n)], ["key", "gram", "times", "n"])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers: Stirling's series after a shift by 6."""
    shift = np.ones_like(x)
    for k in range(6):
        shift *= x + k
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability; 0 where nothing was counted."""
    out = np.zeros(zeros.shape)
    some = zeros + ones > 0
    a, b = zeros[some], ones[some]
    out[some] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - math.log(math.pi)
    return out


def _merged(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of values over each."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return (distinct, *[np.bincount(inverse, v, len(distinct)) for v in values])


def _paths(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | bit node, bit) of the eight bits of every gram, level by level."""
    byte, level = gram & 255, np.arange(8)[:, None]
    return (gram >> 8) << 8 | ((1 << level) + (byte >> (8 - level))), (byte >> (7 - level)) & 1


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """Nodes of the same bits under contexts of ``depth`` bytes."""
    return keys & ((1 << (8 * (depth + 1))) - 1)


def _mix(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    top = np.maximum(own, below)
    return top + np.log(0.5 * np.exp(own - top) + 0.5 * np.exp(below - top))


def _weigh(gram: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From depth DEPTH down to ROOT, (nodes, zeros, ones, log of the mixture, weight of the node's own estimate)."""
    path, bit = _paths(gram)
    keys, zeros, ones = _merged(path.reshape(-1), (n * (1 - bit)).reshape(-1), (n * bit).reshape(-1))
    mixed = _log_kt(zeros, ones)
    out = [(keys, zeros, ones, mixed, np.ones(len(keys)))]
    for d in range(DEPTH - 1, ROOT - 1, -1):
        keys, zeros, ones, below = _merged(_shorter(keys, d), zeros, ones, mixed)
        own = _log_kt(zeros, ones)
        mixed = _mix(own, below)
        out.append((keys, zeros, ones, mixed, 0.5 * np.exp(own - mixed)))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, n) of whole subtrees, of a partition that is sorted by them (column 0), about CHUNK grams at a time."""
    root, gram, n = (np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        root, gram, n = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((root, gram, n)))
        if len(root) >= CHUNK and (at := int(np.searchsorted(root, root[-1]))):
            yield gram[:at], n[:at]
            root, gram, n = root[at:], gram[at:], n[at:]
    if len(root):
        yield gram, n


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, zeros, ones, mixed) under contexts of ROOT bytes."""
    for gram, n in _chunks(batches):
        keys, zeros, ones, mixed, _ = _weigh(gram[n > 0], n[n > 0].astype(float))[-1]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(zeros), pa.array(ones), pa.array(mixed)], ["node", "zeros", "ones", "mixed"])


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def _top(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sums, rest) of every node under contexts of ROOT - 1 = 1 byte: [context, bit node].

    ``sums`` is the weighted part of P(1) that depths 0 and 1 give, ``rest`` the weight
    that is left to longer contexts; a node that is not known leaves 1/2 to what is left.
    """
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    node = rows.column("node").to_numpy()
    for name, into in (("zeros", zeros), ("ones", ones), ("mixed", below)):
        into[node >> 8, node & 255] = rows.column(name).to_numpy()
    own = _log_kt(zeros, ones)
    mixed = _mix(own, below)
    weight = 0.5 * np.exp(own - mixed)
    zeros0, ones0 = zeros.sum(axis=0), ones.sum(axis=0)
    own0 = _log_kt(zeros0, ones0)
    weight0 = 0.5 * np.exp(own0 - _mix(own0, mixed.sum(axis=0)))
    sums0, rest0 = weight0 * _estimate(zeros0, ones0), 1 - weight0
    return sums0 + rest0 * weight * _estimate(zeros, ones), rest0 * (1 - weight)


def _down(top: tuple[np.ndarray, np.ndarray]):
    """(gram, log10p) of every gram: P of each bit at the deepest node that training knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _chunks(batches):
            path, bit = _paths(gram)
            path, bit = path.reshape(-1), bit.reshape(-1)
            levels = _weigh(gram[n > 0], n[n > 0].astype(float))[::-1]
            near = _shorter(path, ROOT - 1)
            one = top[0][near >> 8, near & 255] + 0.5 * top[1][near >> 8, near & 255]
            before = None
            for d, (keys, zeros, ones, _, weight) in enumerate(levels, ROOT):
                if not len(keys):
                    break
                parent = _shorter(keys, d - 1)
                if before is None:
                    sums, rest = (x[parent >> 8, parent & 255] for x in top)
                else:
                    at = np.searchsorted(before[0], parent)
                    sums, rest = before[1][at], before[2][at]
                sums, rest = sums + rest * weight * _estimate(zeros, ones), rest * (1 - weight)
                before = keys, sums, rest
                asked = _shorter(path, d)
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                one = np.where(keys[at] == asked, sums[at] + 0.5 * rest[at], one)
            one = np.clip(one, 1e-12, 1 - 1e-12)
            log10 = np.log10(np.where(bit == 1, one, 1 - one)).reshape(8, -1).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(log10)], ["gram", "log10p"])

    return run


def gram_lengths(grams: DataFrame) -> DataFrame:
    """(gram, log10p) of (gram, n) rows, one for each gram; those of n = 0 teach nothing."""
    root = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * ROOT)) - 1)).alias("root")
    dealt = grams.select(root, "gram", "n").repartition("root").sortWithinPartitions("root")
    tree = dealt.mapInArrow(_up, "node bigint, zeros double, ones double, mixed double")
    node = F.col("node").bitwiseAND(F.lit((1 << (8 * ROOT)) - 1)).alias("node")
    top = _top(tree.groupBy(node).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "mixed")]).toArrow())  # 65,536 rows at most
    return dealt.mapInArrow(_down(top), "gram bigint, log10p double")


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain, length, end, grams, log10p = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, ends, w, keys, _, _, inverse in _distinct(batch):
                n = b - a
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                found = hit[inverse]
                part = np.bincount(w.row[found], gain[at[inverse[found]]], n)
                seen = np.bincount(w.row[found], gain[at[inverse[found]]] > 0, n).astype(np.int64)
                missing = ~found
                pair, times = _pairs(w.row[missing], inverse[missing], len(keys))
                offsets = np.searchsorted(pair // max(len(keys), 1), np.arange(n + 1))
                if grams is None:
                    score = np.bincount(w.row[found], length[at[inverse[found]]], n) + end
                    lost = [pa.nulls(n, pa.list_(pa.int64()))] * 2
                else:
                    score, *lost = _gram_score(data, w, ends, grams, log10p)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        batch.column(0).slice(a, n),
                        pa.array(np.diff(w.first) + 1),
                        pa.array(seen, pa.int64()),
                        pa.array(part, pa.float64()),
                        pa.array(score),
                        T.int_lists(keys[pair % max(len(keys), 1)], offsets),
                        T.int_lists(times, offsets),
                        *lost,
                    ],
                    ["row", "doc_id", "n_tokens", "seen", "part", "score", "missing", "times", "lost", "lost_times"],
                )
                row += n

    return run


def _gram_score(data: np.ndarray, w: T.Words, offsets: np.ndarray, grams: np.ndarray, log10p: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each text, what the grams of the table come to, and the others with their times."""
    score, lost, often, count = np.zeros(len(offsets) - 1), [], [], []
    for a, b, gram, row in _text_grams(data, w, offsets):
        at = np.searchsorted(grams, gram)
        at[at == len(grams)] = 0
        found = grams[at] == gram if len(grams) else np.zeros(len(gram), bool)
        score[a:b] = np.bincount(row[found], log10p[at[found]], b - a)
        order = np.lexsort((gram[~found], row[~found]))
        g, r = gram[~found][order], row[~found][order]
        new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1]))[: len(g)])
        lost.append(g[new])
        often.append(np.diff(np.append(new, len(g))))
        count.append(np.bincount(r[new], minlength=b - a))
    places = np.cumsum(np.concatenate([[0], *count]))
    return score, T.int_lists(np.concatenate(lost), places), T.int_lists(np.concatenate(often), places)


def _pairs(row: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(row * size + word, return_counts=True)


def _least(counts: DataFrame) -> int:
    """The exponent of the count, by powers of two, from which on TABLE rows at most have it in column n."""
    sizes = {r["k"]: r["c"] for r in counts.where("n > 0").groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("k")).agg(F.count("*").alias("c")).collect()}
    least, room = 64, TABLE
    while least and (room := room - sizes.get(least - 1, 0)) >= 0:
        least -= 1
    return least


def code_lengths(docs: DataFrame, learn: Column, across: bool = False) -> DataFrame:
    """Score every whole text; the rows where ``learn`` holds teach counts and tree.

    Words are runs of bytes other than space and 09-0D, A-Z lower-cased; null texts count
    as empty, and every text has one end mark, counted as a token. Rows are returned one
    for one, repeated ones too; an empty table gives an empty result. With no training
    rows every bit has probability 1/2. Words are counted by a 64-bit hash. Other columns
    are ignored. A null ``learn`` teaches nothing. With ``across`` contexts reach over the
    borders of words, as in the tree of a whole text; without it they start anew at each word.

    Returns doc_id, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (add-one unigram, log10), score (the tree's log10 probability of the text).
    """
    spark = prepare(docs.sparkSession)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    kind = source.schema["doc_id"].dataType.simpleString()
    seen = source.select("learn", "text").mapInArrow(_learn, "key bigint, n bigint, word binary")
    words = cut(seen.groupBy("key").agg(F.sum("n").alias("n"), F.max("word").alias("word")))
    texts = source.where("learn").count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_tokens, distinct = total["n"] + texts, total["v"] + (texts > 0)

    if across:
        held = source.select("learn", "text").mapInArrow(_count_grams, "gram bigint, n bigint")
        grams = cut(held.groupBy("gram").agg(F.sum("n").alias("n")))
        lengths = cut(gram_lengths(grams))
        known, end = words.select("key", "n", F.lit(0.0).alias("length")), 0.0
    else:
        held = words.mapInArrow(_grams, "key bigint, gram bigint, times bigint, n bigint")
        mark = spark.createDataFrame([(_BOUNDARY << 8 | END, texts)], "gram bigint, n bigint")
        grams = cut(held.select("gram", "n").unionByName(mark).groupBy("gram").agg(F.sum("n").alias("n")))
        lengths = cut(gram_lengths(grams))
        end = lengths.where(F.col("gram") == (_BOUNDARY << 8 | END)).first()["log10p"]
        coded = held.select("key", "gram", "times").join(lengths.hint("merge"), "gram").groupBy("key").agg(F.sum(F.col("times") * F.col("log10p")).alias("length"))
        known = cut(words.select("key", "n").join(coded.hint("merge"), "key"))
        drop(words, lengths)

    often = known.where(F.col("n") >= F.lit(2.0) ** _least(known)).toArrow().sort_by("key")
    table = (None, None)
    if across:
        chosen = grams.where(F.col("n") >= F.lit(2.0) ** _least(grams)).select("gram")
        most = lengths.join(F.broadcast(chosen), "gram").toArrow().sort_by("gram")  # TABLE rows at most
        table = tuple(most.column(c).to_numpy() for c in ("gram", "log10p"))
    drop(grams)
    shared = spark.sparkContext.broadcast((often.column("key").to_numpy(), np.log10(often.column("n").to_numpy() + 1.0), often.column("length").to_numpy(), end, *table))
    schema = f"row bigint, doc_id {kind}, n_tokens bigint, seen bigint, part double, score double, missing array<bigint>, times array<bigint>, lost array<bigint>, lost_times array<bigint>"
    rows = cut(source.select("doc_id", "text").mapInArrow(_score(shared), schema))

    lost = rows.select("row", F.explode(F.arrays_zip("missing", "times")).alias("x")).select("row", F.col("x.missing").alias("key"), F.col("x.times").alias("times"))
    gained = F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain")
    found = lost.join(known.hint("merge"), "key").groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), gained, F.sum(F.col("times") * F.col("length")).alias("rest"))
    end_gain, norm = math.log10(texts + 1), math.log10(n_tokens + distinct + 1)
    out = rows.drop("missing", "times", "lost", "lost_times").join(found.hint("merge"), "row", "left")
    if across:
        rare = rows.select("row", F.explode(F.arrays_zip("lost", "lost_times")).alias("x")).select("row", F.col("x.lost").alias("gram"), F.col("x.lost_times").alias("times"))
        rare = rare.join(lengths.hint("merge"), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log10p")).alias("rare"))
        out = out.join(rare.hint("merge"), "row", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)) + F.coalesce("rare", F.lit(0.0)))
    base = F.col("part") + F.coalesce("gain", F.lit(0.0)) + F.lit(end_gain) - F.col("n_tokens") * F.lit(norm)
    n_known = F.col("seen") + F.coalesce("more", F.lit(0)) + F.lit(int(texts > 0))
    score = F.col("score") + F.coalesce("rest", F.lit(0.0))
    return out.select("doc_id", "n_tokens", n_known.cast("bigint").alias("n_known"), F.lit(n_tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
