"""MinHash near-duplicate detection by a multi-index Hamming join.

Each distinct shingle set gets a signature of ``CHUNKS * WIDTH`` MinHash symbols of
``BITS`` bits. By the pigeonhole principle two signatures with at most ``RADIUS`` differing
symbols differ in at most ``ERRORS`` symbols of some chunk, so each chunk is indexed once
for every choice of ``ERRORS`` symbols to leave out: such a pair is sure to meet under an
equal key. Pairs that meet further apart are compared too, up to the distance that sets as
similar as the threshold do not pass. A longer sketch of the members of shared buckets
spares the confirmation of pairs that are clearly less similar; the others are confirmed on
the full sets.

Copies (equal sets) are one class from the start. Buckets are never expanded into all
their pairs: see ``_buckets``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigate.llm import _text as T
from lexigate.llm._buckets import Side, bucket_components, shared_buckets
from lexigate.llm._filter import bit_filter, passes
from lexigate.llm._session import cut, drop, prepare

SHINGLE = 5
#: Chunks of a signature, symbols in a chunk (one 64-bit word holds a chunk), bits of a symbol, and errors that a chunk may have.
CHUNKS, WIDTH, BITS, ERRORS = 8, 5, 12, 1
SYMBOLS = CHUNKS * WIDTH
#: Symbols of 4 bits in a sketch.
SKETCH = 1536
#: Differing symbols up to which two signatures are sure to share a key.
RADIUS = CHUNKS * (ERRORS + 1) - 1
ROUNDS = 3

_rng = np.random.default_rng(7)
_A = _rng.integers(1 << 16, 1 << 31, SYMBOLS + SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SYMBOLS + SKETCH, dtype=np.uint64).astype(np.uint32)
_SIG = [f"s{c}" for c in range(CHUNKS)]
_KEPT = [[c * WIDTH + i for i in range(WIDTH) if i not in out] for c in range(CHUNKS) for out in itertools.combinations(range(WIDTH), ERRORS)]


def max_distance(threshold: int) -> int:
    """Differing symbols up to which a pair that meets is compared: RADIUS at least.

    At the similarity threshold a symbol differs with probability 1 - t; 4.5 standard
    deviations above that mean rule out about five such pairs in a million.
    """
    p = 1 - threshold / 100
    return max(RADIUS, int(np.ceil(SYMBOLS * p + 4.5 * np.sqrt(SYMBOLS * p * (1 - p)))))


def max_sketch_distance(threshold: int) -> int:
    """Differing sketch symbols up to which a pair is confirmed: 4.75 deviations above the mean at the threshold, one in a million."""
    p = (1 - threshold / 100) * (1 - 1 / 16)
    return int(np.ceil(SKETCH * p + 4.75 * np.sqrt(SKETCH * p * (1 - p))))


def _symbols(flat: np.ndarray, offsets: np.ndarray, which: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """MinHashes of the sets that have members: (their rows, mixed minima) for each hash function."""
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        x = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
        at = offsets[:-1][some]
        for k in which:
            low = np.minimum.reduceat(x * _A[k] + _B[k], at)
            yield some, (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


def _sets(batch: pa.RecordBatch, shingle: int):
    """(first row, end row, flat distinct shingle hashes, offsets) block by block."""
    for a, b, data, offsets in T.blocks(batch):
        data = T.LOWER[data]
        w = T.words(data, offsets, T.SPACE_WORDS)
        h = T.span_hash(data, w.start, w.end)
        s = T.window_hash(h, shingle)
        parts = []
        for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if j - i >= shingle:
                parts.append(np.unique(s[i : j - shingle + 1]))
            else:
                parts.append(np.array([T.fold_hash(h[i:j])] if j > i else [], np.uint64))
        yield a, b, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _set_ids(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A 128-bit digest of each set, the same whatever the order of its members."""
    total = np.zeros((2, len(flat) + 1), np.uint64)
    np.cumsum(flat, out=total[0, 1:])
    np.cumsum(T.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1, 1:])
    return T.id16(total[0, offsets[1:]] - total[0, offsets[:-1]], total[1, offsets[1:]] - total[1, offsets[:-1]])


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, flat, offsets in _sets(batch, shingle):
                size = np.diff(offsets)
                sig = np.zeros((b - a, CHUNKS), np.int64)
                for k, (some, low) in enumerate(_symbols(flat, offsets, range(SYMBOLS))):
                    sig[some, k // WIDTH] |= (low >> np.uint32(32 - BITS)).astype(np.int64) << (BITS * (k % WIDTH))
                n = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(size, pa.int64()), _set_ids(flat, offsets), *[pa.array(sig[:, c]) for c in range(CHUNKS)]], ["doc_id", "n_shingles", "cid", *_SIG])

    return run


def _texts(bits: np.ndarray, shingle: int):
    """(cid, text, sketch) of the rows whose hash (column 0) is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = batch.take(pa.array(passes(bits, batch.column(0).to_numpy())))
            for a, b, flat, offsets in _sets(picked, shingle):
                sym = np.zeros((b - a, SKETCH), np.uint8)
                for k, (some, low) in enumerate(_symbols(flat, offsets, range(SYMBOLS, SYMBOLS + SKETCH))):
                    sym[some, k] = low >> np.uint32(28)
                sketch = (sym[:, 0::2] | (sym[:, 1::2] << 4)).view(np.int64).reshape(-1)
                yield pa.RecordBatch.from_arrays([_set_ids(flat, offsets), picked.column(1).slice(a, b - a), T.int_lists(sketch, np.arange(b - a + 1) * (SKETCH // 16))], ["cid", "text", "sketch"])

    return run


def _confirm(threshold: int, shingle: int):
    """Pairs (a, b, ta, tb) of texts whose full sets are as similar as the threshold; returns (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, sets = [], []
            for side in (0, 1):
                ids = batch.column(side).dictionary_encode()
                _, first = np.unique(ids.indices.to_numpy(), return_index=True)
                own = []
                for a, b, flat, offsets in _sets(pa.RecordBatch.from_arrays([batch.column(side + 2).take(pa.array(first))], ["text"]), shingle):
                    own += [flat[offsets[i] : offsets[i + 1]] for i in range(b - a)]
                sides.append(ids.indices.to_numpy())
                sets.append(own)
            good = []
            for i, j in zip(*sides, strict=True):
                x, y = sets[0][i], sets[1][j]
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * common >= threshold * (len(both) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return run


def _errors(x: Side, y: Side) -> list[Column]:
    """Symbols that differ in each chunk: fold the bits of each symbol of the XOR into its lowest and count."""
    low = F.lit(sum(1 << (BITS * i) for i in range(WIDTH)))
    out = []
    for c in range(CHUNKS):
        z = x(f"s{c}").bitwiseXOR(y(f"s{c}"))
        for k in (6, 3):
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        out.append(F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(low)))
    return out


def _sketch_distance(x: Column, y: Column) -> Column:
    """Sketch symbols that differ: fold each 4 bits of the XOR into the lowest and count."""

    def word(p: Column, q: Column) -> Column:
        z = p.bitwiseXOR(q)
        for k in (2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(x, y, word), F.lit(0), lambda n, m: n + m)


def _first(key: Column, x: Side, y: Side) -> Column:
    """Whether a key is the first that two signatures share: of their first chunk with few errors, the symbol that errs left out."""
    left = F.shiftrightunsigned(key, 60).cast("int")
    chunk = F.call_function("shiftrightunsigned", key, left * BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    out = F.when(F.lit(False), F.lit(True))
    for c in range(CHUNKS):
        differ = x(f"s{c}").bitwiseXOR(y(f"s{c}"))
        out = out.when(chunk == c, (differ != 0) | (left == 0))
        shared = F.lit(False)
        for i in range(WIDTH):
            shared = shared | (differ.bitwiseAND(F.lit(((1 << (BITS * WIDTH)) - 1) ^ (((1 << BITS) - 1) << (BITS * i)))) == 0)
        out = out.when(shared, F.lit(False))
    return F.coalesce(out, F.lit(False))


def _keys() -> Column:
    """One key for each chunk and symbol to leave out: in that symbol's place stands the chunk's number."""
    out = []
    for kept in _KEPT:
        c = kept[0] // WIDTH
        (left,) = set(range(c * WIDTH, (c + 1) * WIDTH)) - set(kept)
        i = left % WIDTH
        mask = sum(((1 << BITS) - 1) << (BITS * (k % WIDTH)) for k in kept)
        out.append(F.col(f"s{c}").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(i << 60 | c << (BITS * i)).cast("bigint")))
    return F.array(*out)


def near_duplicates(docs: DataFrame, threshold: int = 85, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Group documents whose word-shingle sets have a Jaccard similarity of threshold per cent.

    Words are runs of bytes other than space and 09-0D, A-Z lower-cased; a set holds the
    distinct windows of ``shingle`` words, or the whole sequence where it is shorter.
    Texts that are null or have no word have an empty set and are linked with nothing.
    Repeated rows are copies of one another and each returned. An empty table gives an
    empty result. Other columns are ignored.

    Returns doc_id, n_shingles, component_id (least doc_id of the group), kept.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    rows = cut(source.mapInArrow(_sign(shingle), f"doc_id {id_type}, n_shingles bigint, cid binary, " + ", ".join(f"{x} bigint" for x in _SIG)))

    classes = cut(rows.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *[F.first(x).alias(x) for x in _SIG]))
    buckets = cut(shared_buckets(classes.select(F.col("cid").alias("node"), *_SIG), _keys()))
    members = buckets.groupBy("node").agg(F.count("*").alias("keys"))
    needed = cut(classes.join(members.withColumnRenamed("node", "cid").hint("merge"), "cid", "left_semi"))

    bits = bit_filter(needed.select(F.xxhash64("rep").alias("h")))
    picked = source.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(_texts(bits, shingle), "cid binary, text string, sketch array<bigint>")
    texts = cut(picked.join(needed.select("cid").hint("merge"), "cid", "left_semi").dropDuplicates(["cid"]))

    far, apart = max_distance(threshold), max_sketch_distance(threshold)

    def near(x: Side, y: Side) -> Column:
        return (100 * F.least(x("n"), y("n")) >= threshold * F.greatest(x("n"), y("n"))) & (sum(_errors(x, y), F.lit(0)) <= far)

    def close(x: Side, y: Side) -> Column:
        return _sketch_distance(x("sketch"), y("sketch")) <= apart

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(_confirm(threshold, shingle), "u binary, v binary")

    nodes = cut(needed.join(texts.select("cid", "sketch").hint("merge"), "cid").select(F.col("cid").alias("node"), "n", *_SIG, "sketch"))
    comp = bucket_components(buckets, nodes, near, confirm, ROUNDS, _first, close, among=4)
    drop(buckets, needed, texts, nodes)

    nodes = classes.select("cid", "rep").join(comp.select(F.col("node").alias("cid"), "component").hint("merge"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    ids = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    member_of = nodes.join(ids.hint("merge"), "component").select("cid", "component_id")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cid")).alias("cid")).join(member_of.hint("merge"), "cid", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """Keep one document of each near-duplicate group: one row with its least doc_id.

    Rows that repeat both id and text keep one row; rows without an id are kept.
    """
    kept = near_duplicates(docs, threshold).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
