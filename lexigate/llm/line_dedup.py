"""Fuzzy line deduplication over the whole corpus.

Lines are normalised (words of letters and digits, A-Z lower-cased, digits to 0), and equal
ones are one node. A node has BLOCKS keys, each of several MinHashes of its set of words (in
scripts without spaces, of its letters): LONG_DEPTH of them in lines of many words, where
unrelated lines share some words too, SHORT_DEPTH in short ones. Lines of a number of words
between have both sorts, so that a word more or less keeps no pair apart. Nodes that meet in a key
are confirmed by edit similarity alone, and each connected group keeps its first occurrence.
Lengths and counted letters spare comparisons that cannot succeed.

Members of a bucket are compared with its most connected one (see ``_buckets``), and what that leaves
apart in blocks of members, so that pairs are never rows. That last step still compares every two of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigate.llm import _text as T
from lexigate.llm._buckets import Side, bucket_components, met_buckets, packed_keys
from lexigate.llm._edits import distances
from lexigate.llm._filter import bit_filter, bit_words, marked, passes
from lexigate.llm._session import cut, drop, prepare

#: Lines with fewer words say too little to be called repeats; they always stay. In scripts
#: that are written without spaces each letter counts as a word.
MIN_WORDS = 5
#: Keys of a node of each sort, and MinHashes in a key.
BLOCKS, SHORT_DEPTH, LONG_DEPTH = 8, 3, 6
#: Words from which a line has keys of LONG_DEPTH, and up to which of SHORT_DEPTH.
LONG_FROM, SHORT_TO = 10, 11
#: Bits that two signatures may differ in: all, for edit similarity alone decides.
DISTANCE = 64
#: Edit similarity: 1 - distance / longer length.
SIMILARITY = 0.9
#: Parts of the keys for each partition of a shuffle.
PARTS = 4
#: Words of the ring codes of a line's letters.
RINGS = ["r0", "r1", "r2", "r3"]
#: Rounds of comparing the members of a bucket with some of them, and with how many.
ROUNDS, PICKS = 1, 4

_ZERO_DIGITS = T.LOWER.copy()
_ZERO_DIGITS[0x30:0x3A] = 0x30
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F
_FACTORS = np.random.default_rng(20240611).integers(1, 1 << 63, (BLOCKS, LONG_DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Words and lines of a block: (words, word hashes, line begin, stop, row, number, first word)."""
    norm = np.frombuffer(data.tobytes().translate(_ZERO_DIGITS.tobytes()), np.uint8)
    w = T.words(norm, offsets, T.ALNUM_WORDS)
    cut_at = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], cut_at + 1]), kind="stable")
    stop = np.sort(np.concatenate([cut_at, offsets[1:]]), kind="stable")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(cut_at, offsets)) + 1)
    number = np.arange(len(begin)) - np.searchsorted(row, row)
    first = np.append(np.searchsorted(w.start, begin), len(w.start))
    return norm, w, begin, stop, row, number, first


def _ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each line's sequence of word hashes."""
    p, q = T._power(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return T.mix((total[first[1:]] - total[first[:-1]]) * q[first[:-1]] + np.diff(first).astype(np.uint64) * _ODD)


def _tally(norm: np.ndarray, begin: np.ndarray, bins: int) -> np.ndarray:
    """Counts of letters for each line, modulo 16: an edit moves two of them by one at most.

    A letter counts by the last byte of its code point; spaces do not count.
    """
    last = np.append((norm[1:] & 0xC0) != 0x80, True) & T.ALNUM_WORDS[norm]
    line = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(norm))))
    return np.bincount(line[last] * bins + (norm[last] & (bins - 1)), minlength=bins * len(begin)).reshape(-1, bins) & 15


#: A code of 8 bits for each count: two codes differ in as many bits as the counts differ modulo 16.
_RING = np.array([(1 << i) - 1 if i <= 8 else 0xFF ^ ((1 << (i - 8)) - 1) for i in range(16)], np.uint8)


def _min_keys(h: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the kept lines from the hashes of their words: flat, and where each line's begin and end."""
    edges = np.stack([first[keep], first[keep + 1]], axis=1).reshape(-1)
    if edges[-1] == len(h):
        edges = edges[:-1]
    turned, least = np.empty(len(h), np.uint64), np.empty((BLOCKS, LONG_DEPTH, len(edges)), np.uint64)
    for f, out in zip(_FACTORS.reshape(-1), least.reshape(-1, len(edges)), strict=True):
        np.minimum.reduceat(np.multiply(h, f, out=turned), edges, out=out)
    least = T.mix(least[:, :, ::2])
    keys, total = np.empty((len(keep), 2, BLOCKS), np.uint64), np.arange(BLOCKS, dtype=np.uint64)[:, None]
    for depth in range(LONG_DEPTH):
        total = total * _ODD + least[:, depth]
        if depth + 1 == SHORT_DEPTH:
            keys[:, 0] = T.mix(total).T
    keys[:, 1] = T.mix(total).T
    size = first[keep + 1] - first[keep]
    has = np.stack([size <= SHORT_TO, size >= LONG_FROM], axis=1)
    return keys[has].reshape(-1), np.concatenate([[0], np.cumsum(has.sum(axis=1) * BLOCKS)])


def _unspaced(norm: np.ndarray) -> np.ndarray:
    """True at the first byte of each letter of a script that is written without spaces.

    Thai, Lao, Tibetan, Myanmar and Khmer; kana, bopomofo and Han with its extensions;
    half-width kana.
    """
    out = np.zeros(len(norm), bool)
    at = np.flatnonzero(norm >= 0xE0)
    at = at[at + 2 < len(norm)]
    x, y = norm[at], norm[at + 1]
    z = norm[at + 2]
    asia = ((x == 0xE3) & (y >= 0x81)) | ((x >= 0xE4) & (x <= 0xE9)) | ((x == 0xF0) & (y >= 0xA0) & (y <= 0xB3))
    south = ((x == 0xE0) & (y >= 0xB8)) | ((x == 0xE1) & ((y <= 0x82) | (y == 0x9E) | (y == 0x9F)))
    forms = (x == 0xEF) & (((y >= 0xA4) & (y <= 0xAB)) | ((y == 0xBD) & (z >= 0xA6)) | ((y == 0xBE) & (z <= 0x9F)))
    out[at[asia | south | forms]] = True
    return out


def _units(norm: np.ndarray, w: T.Words, begin: np.ndarray, first: np.ndarray):
    """Start and end of each word, or of each letter of a script without spaces; and the first of each line."""
    alone = _unspaced(norm)
    if not alone.any():
        return w.start, w.end, first
    inside = np.zeros(len(norm) + 1, np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    lead = (norm & 0xC0) != 0x80
    of = np.maximum.accumulate(np.where(lead, np.arange(len(norm)), 0))  # the first byte of each byte's letter
    after = np.zeros(len(norm), bool)
    after[1:] = lead[1:] & alone[of[:-1]]
    opens = (alone | after) & inside
    opens[w.start] = True
    start = np.flatnonzero(opens)
    word = np.searchsorted(w.start, start, "right") - 1
    end = w.end[word]
    same = word[1:] == word[:-1]
    end[:-1][same] = start[1:][same]
    return start, end, np.append(np.searchsorted(start, begin), len(start))


class _Judged:
    """The judged lines of a block: row, number and node of each; text, counted letters and keys of those asked for, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_words: int):
        self.norm, self.words, self.begin, self.stop, row, number, first = _lines(data, offsets)
        self.start, self.end, self.unit = _units(self.norm, self.words, self.begin, first)
        self.keep = np.flatnonzero(np.diff(self.unit) >= min_words)
        self.hashes = T.span_hash(self.norm, self.words.start, self.words.end)
        self.row, self.number, self.node = row[self.keep], number[self.keep], _ids(self.hashes, first)[self.keep].view(np.int64)

    def texts(self, chosen: np.ndarray) -> list[bytes]:
        spaced = np.where(T.ALNUM_WORDS[self.norm], self.norm, np.uint8(0x20)).tobytes() if len(chosen) else b""
        return [b" ".join(spaced[self.begin[i] : self.stop[i]].split()) for i in self.keep[chosen].tolist()]

    def lines(self, chosen: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The texts as one array, and their ring codes."""
        line = self.keep[chosen]
        inside = np.zeros(len(self.begin), bool)
        inside[line] = True
        first, last = np.searchsorted(self.words.start, self.begin), np.searchsorted(self.words.start, self.stop)
        word = np.repeat(inside, last - first)  # lines follow one another, and so do their words
        start, end = self.words.start[word], self.words.end[word]
        size = (last - first)[line]
        length = end - start + 1  # with a space after each word
        at = np.cumsum(length) - length
        data = self.norm.take(np.arange(length.sum()) + np.repeat(start - at, length), mode="clip")
        data[at + length - 1] = 0x20
        final = np.cumsum(size) - 1
        stays = np.ones(len(data), bool)
        stays[(at + length - 1)[final]] = False  # but for the last
        data = data[stays]
        bytes_ = np.add.reduceat(length, final - size + 1) - 1 if len(line) else np.zeros(0, np.int64)
        edges = np.concatenate([[0], np.cumsum(bytes_)])
        texts = pa.Array.from_buffers(pa.string(), len(line), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
        return texts, _ring_codes(data, edges[:-1])

    def keys(self, chosen: np.ndarray) -> pa.Array:
        if not len(chosen):
            return T.int_lists(np.zeros(0, np.int64), np.zeros(1, np.int64))
        h = self.hashes if self.start is self.words.start else T.span_hash(self.norm, self.start, self.end)
        return T.int_lists(*_min_keys(h, self.unit, self.keep[chosen]))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *[len(t) for t in texts]])[:-1]


def _letters(texts: list[bytes]) -> np.ndarray:
    """16 counts of letters of each normalised line, of 4 bits."""
    counts = _tally(*_joined(texts), 16).astype(np.uint64) if texts else np.zeros((0, 16), np.uint64)
    return (counts << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _ring_codes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """32 counts of letters of each normalised line as ring codes: RINGS words."""
    return _RING[_tally(data, begin, 32)].view(np.int64).T if len(begin) else np.zeros((len(RINGS), 0), np.int64)


def _rings(texts: list[bytes]) -> np.ndarray:
    return _ring_codes(*_joined(texts))


def _sign(min_words: int, keys: bool = False):
    """doc_id, line_no, node, signature, length (and keys) of the judged lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in T.blocks(batch):
                x = _Judged(data, offsets, min_words)
                every = np.arange(len(x.node))
                texts = x.texts(every)
                columns = [batch.column(0).take(pa.array(x.row + a)), pa.array(x.number), pa.array(x.node), pa.array(_letters(texts)), pa.array([len(t.decode()) for t in texts], pa.int32())]
                if len(every):
                    yield pa.RecordBatch.from_arrays([*columns, *([x.keys(every)] if keys else [])], ["doc_id", "line_no", "node", "sim", "n", *(["mins"] if keys else [])])

    return run


def _index(min_words: int, parts: int):
    """Keys and nodes of the judged lines, packed by parts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for _, _, data, offsets in T.blocks(batch):
                x = _Judged(data, offsets, min_words)
                once = np.sort(np.unique(x.node, return_index=True)[1])
                keys = x.keys(once)
                yield keys.flatten().to_numpy(), np.repeat(x.node[once], np.diff(keys.offsets.to_numpy()))

    return lambda batches: packed_keys(found(batches), parts)


def _rows(min_words: int, bits: np.ndarray):
    """Judged lines; once a block those whose node is in the filter have text, signature and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in T.blocks(batch):
                x = _Judged(data, offsets, min_words)
                once = np.unique(x.node, return_index=True)[1]
                wanted = np.sort(once[passes(bits, x.node[once])])
                at = np.full(len(x.node), -1)
                at[wanted] = np.arange(len(wanted))
                place = pa.array(at, mask=at < 0)
                texts, rings = x.lines(wanted)
                found = [texts, *map(pa.array, rings), pc.utf8_length(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x.row + a)), pa.array(x.number), pa.array(x.node), *[c.take(place) for c in found]], ["row", "line_no", "node", "line", *RINGS, "n"])

    return run


#: Edits up to which two lines are compared along diagonals.
FEW_EDITS = 6


def _alike(a: str, b: str, i: int, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:]: blocks that grow, then the halves of the one that differs."""
    at, step, left = 0, 16, min(len(a) - i, len(b) - j)
    while at < left and a[i + at : i + at + step] == b[j + at : j + at + step]:
        at, step = at + step, 2 * step
    if at >= left:
        return left
    differs = min(step, left - at)
    while differs > 1:
        half = differs // 2
        if a[i + at : i + at + half] == b[j + at : j + at + half]:
            at, differs = at + half, differs - half
        else:
            differs = half
    return at + (differs == 1 and a[i + at] == b[j + at])


def _few_edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance along diagonals (Landau and Vishkin 1989); over ``most``, most + 1."""
    aim, far = len(b) - len(a), {0: _alike(a, b, 0, 0)}
    if not aim and far[0] == len(a):
        return 0
    for e in range(1, most + 1):
        reached = {}
        for k in range(max(-e, -len(a)), min(e, len(b)) + 1):
            i = max(far.get(k - 1, -1), far.get(k, -2) + 1, far.get(k + 1, -2) + 1)
            i = min(i, len(a), len(b) - k)
            if i >= 0 and i + k >= 0:
                reached[k] = i + _alike(a, b, i, i + k)
        if reached.get(aim, -1) == len(a):
            return e
        far = reached
    return most + 1


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, over ``most``: most + 1.

    Few edits are found along diagonals, more by bit-parallel columns (Myers 1999, Hyyro 2003).
    """
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i, n = 0, min(len(a), len(b))
    while i < n and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if abs(len(a) - len(b)) > most:
        return most + 1
    if (few := _few_edits(a, b, min(most, FEW_EDITS))) <= FEW_EDITS or most <= FEW_EDITS:
        return few
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = mask, 0, len(a), len(b)
    for c in b:
        same = where.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus, minus = down | (mask & ~(horizontal | up)), up & horizontal
        left -= 1
        score += 1 if plus & high else -1 if minus & high else 0
        if score - left > most:
            return most + 1
        plus = plus << 1 | 1
        up, down = (minus << 1 | (mask & ~(vertical | plus))) & mask, plus & vertical & mask
    return score


#: Pairs and letters that are compared together.
TOGETHER, LETTERS = 8000, 1 << 22


def within(a: list[str], b: list[str]) -> np.ndarray:
    """Whether each pair of lines has enough edit similarity."""
    most = np.array([int((1 - SIMILARITY) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)], np.int64)
    found = distances(a, b, most)
    for i in np.flatnonzero(found < 0).tolist():
        found[i] = edit_distance(a[i], b[i], int(most[i]))
    return found <= most


def _linked(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
    """u, v of the pairs (u, v, line of u, line of v) with enough edit similarity, many pairs at a time."""
    held: list[pa.RecordBatch] = []
    lines: tuple[list[str], list[str]] = ([], [])
    letters = 0
    for part in itertools.chain(parts, [None]):
        if part is not None:
            held.append(pa.RecordBatch.from_arrays(list(part[:2]), ["u", "v"]))
            for x, column in zip(lines, part[2:], strict=True):
                x.extend(column.to_pylist())
                letters += pc.sum(pc.utf8_length(column)).as_py() or 0
        if held and (part is None or len(lines[0]) >= TOGETHER or letters >= LETTERS):
            pairs = pa.Table.from_batches(held).combine_chunks()
            yield from pairs.filter(pa.array(within(*lines), pa.bool_())).to_batches()
            held, lines, letters = [], ([], []), 0


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of lines with enough edit similarity; columns: a, b, la, lb."""
    return _linked(tuple(batch.columns) for batch in batches)


#: Members of a bucket in a block on average, and pairs of members that are looked at together.
BLOCK, LOOKED_AT = 64, 1 << 19
#: Lengths of a band differ by less than this factor: linked lines lie in one band or in adjacent ones.
BAND = 1.12


def _members(column: pa.Array) -> dict[str, pa.Array]:
    flat = column.flatten()
    return {flat.type.field(i).name: flat.field(i) for i in range(flat.type.num_fields)}


def _padded(lists: pa.Array, fill: int) -> np.ndarray:
    """Lists of keys as rows of one width."""
    out = np.full((len(lists), 2 * BLOCKS), fill, np.int64)
    size = pc.list_value_length(lists).to_numpy()
    out[np.arange(2 * BLOCKS) < size[:, None]] = lists.flatten().to_numpy()
    return out


def _meeting(batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]:
    """Pairs of members of two blocks of a bucket, or of one block, that are in different components, may be linked and share no lesser key.

    Columns: key, x (and y unless ``same``).
    """
    for batch in batches:
        key, sides = batch.column(0).to_numpy(), [batch.column(1), batch.column(1 if same else 2)]
        size = [pc.list_value_length(c).to_numpy().astype(np.int64) for c in sides]
        start = [np.cumsum(s) - s for s in size]
        x, y = map(_members, sides)
        number = lambda c: (x[c].to_numpy(), y[c].to_numpy())  # noqa: B023, E731
        many = np.cumsum(size[0] * size[1])
        at = 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(many, LOOKED_AT + (many[at - 1] if at else 0), "right")))
            each = size[0][at:to] * size[1][at:to]
            row = np.repeat(np.arange(at, to), each)
            place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            i, j = start[0][row] + place // size[1][row], start[1][row] + place % size[1][row]
            at = to
            comp, n = number("comp"), number("n")
            ok = comp[0][i] != comp[1][j]
            if same:
                ok &= i < j
            row, i, j = row[ok], i[ok], j[ok]
            longer, differ = np.maximum(n[0][i], n[1][j]), np.abs(n[0][i] - n[1][j])
            most = np.floor((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)
            apart = sum(np.bitwise_count((a[i] ^ b[j]).view(np.uint64)).astype(np.int64) for a, b in map(number, RINGS))
            ok = (differ <= most) & (apart <= 2 * most - differ)
            row, i, j = row[ok], i[ok], j[ok]
            if len(i):
                a, b = _padded(x["mins"].take(pa.array(i)), 0), _padded(y["mins"].take(pa.array(j)), 0)
                top = np.iinfo(np.int64).max
                least = np.full(len(i), top)
                for column in a.T:
                    least = np.minimum(least, np.where((column != 0) & (b == column[:, None]).any(axis=1), column, top))
                ok = least == key[row]
                i, j = pa.array(i[ok]), pa.array(j[ok])
                if len(i):
                    yield x["node"].take(i), y["node"].take(j), x["line"].take(i), y["line"].take(j)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _linked(_meeting(batches, True))


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _linked(_meeting(batches, False))


def _block_links(found: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The last comparison of ``bucket_components``: members of a bucket meet in blocks, and pairs are never rows.

    A bucket falls into bands of lengths and, by a hash, into blocks of about BLOCK members. Every block is compared
    with itself and with the others of its band and the next, each two of them in the task that they are dealt to.
    """

    def last(labelled: DataFrame) -> DataFrame:
        band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int").alias("band")
        sized = labelled.join(found.select("node", "n").hint("merge"), "node").groupBy("key", band).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        member = F.struct("node", "comp", "n", *RINGS, "mins", "line").alias("member")
        full = labelled.join(found.hint("merge"), "node").select("key", band, "node", "comp", member).join(sized.hint("merge"), ["key", "band"])
        full = full.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
        blocks = cut(full.groupBy("key", "band", "part").agg(F.collect_list("member").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")))
        inside = blocks.where("lo <> hi").select("key", "members").mapInArrow(_inside, "u bigint, v bigint")

        def side(x: str, *more: str) -> DataFrame:
            return blocks.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("band", "part", *more)])

        order = (F.col("band_y") == F.col("band_x") + 1) | ((F.col("band_y") == F.col("band_x")) & (F.col("part_x") < F.col("part_y")))
        apart = F.least("lo_x", "lo_y") < F.greatest("hi_x", "hi_y")
        two = side("x", "lo", "hi").join(side("y", "lo", "hi").hint("merge"), "key").where(order & apart).select("key", "band_x", "part_x", "band_y", "part_y")
        for x in "xy":
            two = two.join(side(x, "members").hint("merge"), ["key", f"band_{x}", f"part_{x}"])
        between = two.select("key", "members_x", "members_y").mapInArrow(_between, "u bigint, v bigint")
        links = cut(inside.unionByName(between))
        drop(blocks)
        return links

    return last


def _near(x: Side, y: Side) -> Column:
    """False only where lengths or counted letters rule the edit similarity out.

    A changed letter moves two counts, one put in or taken out moves one count at most, and there are
    as many of the latter as the lengths differ by.
    """
    longer, shorter = F.greatest(x("n"), y("n")), F.least(x("n"), y("n"))
    most = F.floor((1 - SIMILARITY) * longer + 1e-9)
    apart = sum((F.bit_count(x(r).bitwiseXOR(y(r))) for r in RINGS), F.lit(0))
    return (longer - shorter <= most) & (apart <= 2 * most - (longer - shorter))


def line_groups(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, line_no, first): every judged line, and whether it is the one its group keeps.

    The version is the hash of the row's text: it tells apart rows that share a doc_id.
    """
    prepare(docs.sparkSession)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = met_buckets(source.select("text").mapInArrow(_index(min_words, parts), "part int, keys binary, nodes binary"))

    bits = bit_filter(buckets.select("node"))
    signed = source.select(F.struct("doc_id", F.xxhash64("text").alias("version")).alias("row"), "text")
    rows = cut(signed.mapInArrow(_rows(min_words, bits), f"row struct<doc_id: {kind}, version: bigint>, line_no bigint, node bigint, line string, " + ", ".join(f"{r} bigint" for r in RINGS) + ", n int"))
    members = buckets.groupBy("node").agg(F.collect_list("key").alias("mins"))
    found = rows.where("line is not null").join(members.hint("merge"), "node")
    found = cut(found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("line", *RINGS, "n", "mins")]))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(found.select(F.col("node").alias("a"), F.col("line").alias("la")).hint("merge"), "a").join(found.select(F.col("node").alias("b"), F.col("line").alias("lb")).hint("merge"), "b")
        return both.select("a", "b", "la", "lb").mapInArrow(_confirm, "u bigint, v bigint")

    comp = bucket_components(buckets, found.drop("line").withColumnRenamed("mins", "keys"), _near, confirm, ROUNDS, picks=PICKS, last=_block_links(found))
    drop(buckets, found)
    own = rows.groupBy("node").agg(F.min(F.struct("row.doc_id", "line_no")).alias("at"), F.count("*").alias("times"))
    grouped = comp.unionByName(comp.select(F.col("component").alias("node"), "component").distinct())
    grouped = own.join(grouped.hint("merge"), "node", "left").where("times > 1 or component is not null").select("node", "at", F.coalesce("component", "node").alias("component"))
    grouped = cut(grouped)
    least = grouped.groupBy("component").agg(F.min("at").alias("kept"))
    kept = cut(grouped.join(least.hint("merge"), "component").select("node", "kept"))
    drop(grouped)
    words = cut(bit_words(kept.select("node")))
    places = rows.select("row.doc_id", "row.version", "line_no", "node")
    judged = marked(places, words, "node")
    several = judged.where("hit_").join(kept.hint("merge"), "node", "left")
    first = F.col("kept").isNull() | F.struct("doc_id", "line_no").eqNullSafe(F.col("kept"))
    return several.select("doc_id", "version", "line_no", first.alias("first")).unionByName(judged.where("not hit_").select("doc_id", "version", "line_no", F.lit(True).alias("first")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "n_removed") -> DataFrame:
    """Texts without the lines that fuzzily repeat an earlier line of the corpus.

    Lines end at a newline. Those with fewer than ``min_words`` words always stay; a letter of
    a script that is written without spaces counts as a word there. Of each
    group of lines that meet in a key and are linked by edit similarity the occurrence with the
    least (doc_id, line number) stays; a null doc_id comes first. Rows that share a doc_id
    count as one document: a line kept in one is kept in the other, and what is cut from one
    is cut from the others only where they have the same text. Null texts stay null, empty
    ones empty. An empty table gives an empty result. Nodes are 64-bit hashes.

    Returns all columns of docs with the new text, and ``removed`` (lines taken out; a column of
    that name in docs is replaced).
    """
    owner = F.struct(F.col("row_.doc_id").alias("doc_id"), F.xxhash64(F.col("row_.text").cast("string")).alias("version"))
    gone = line_groups(docs, min_words).where("not first").groupBy(F.struct("doc_id", "version").alias("owner_")).agg(F.collect_set("line_no").alias("gone_"))
    gone = cut(gone)
    words = bit_words(gone.select(F.xxhash64("owner_").alias("h")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")).withColumn("owner_", owner).withColumn("h_", F.xxhash64("owner_"))
    packed = marked(packed, cut(words), "h_")
    same = packed.where("hit_").join(gone, "owner_", "left").select("row_", "gone_")
    out = same.unionByName(packed.where("not hit_").select("row_", F.lit(None).cast("array<bigint>").alias("gone_")))
    lines = F.filter(F.split(F.col("row_.text"), "\n", -1), lambda _, i: ~F.array_contains("gone_", i.cast("bigint")))
    text = F.when(F.col("gone_").isNull(), F.col("row_.text")).otherwise(F.array_join(lines, "\n"))
    return out.select(*[(text if c == "text" else F.col(f"row_.`{c}`")).alias(c) for c in docs.columns if c != removed], F.coalesce(F.array_size("gone_"), F.lit(0)).cast("bigint").alias(removed))
