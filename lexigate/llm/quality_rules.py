"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word unigrams and bigrams: one from a
trusted target (documents labelled good), one from the raw corpus (all documents). Both
are fixed-size count vectors: partitions add up their own, and buckets are summed by
Spark. A document's score is the mean log ratio of its n-grams; it is compared with one
fixed threshold, the same for every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.llm import _text as T
from lexigate.llm._session import prepare

#: Hash buckets: the broadcast ratio table has this many floats at any corpus size.
BUCKETS = 1 << 16
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.25

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _grams(h: np.ndarray, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the hashed unigrams and bigrams of a block."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    two = T.window_hash(h, 2)
    same = w.row[1:] == w.row[:-1]
    return np.concatenate([h >> shift, two[same] >> shift]).astype(np.int64), np.concatenate([w.row, w.row[1:][same]])


def _hashed(batch: pa.RecordBatch):
    for a, b, data, offsets in T.blocks(batch):
        lower = T.LOWER[data]
        w = T.words(lower, offsets, T.SPACE_WORDS)
        yield a, b, data, offsets, w, T.span_hash(lower, w.start, w.end)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a partition's rows."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, _, _, w, h in _hashed(batch):
            total += np.bincount(_grams(h, w)[0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def _counts(docs: DataFrame) -> np.ndarray:
    rows = docs.select("text").mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | raw) for each bucket (BUCKETS floats).

    ``trusted`` holds the doc_ids of good documents; all of them make up the target, and
    without any of them the ratios are 0. The raw side counts every document.
    """
    raw, good = _counts(docs), _counts(docs.join(trusted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))
    if not good.sum():
        return np.zeros(BUCKETS)
    # the target is smoothed towards the raw corpus, so buckets it never saw stay near 0
    p = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    weight = SMOOTHING * BUCKETS
    q = (good + weight * p) / (good.sum() + weight)
    return np.log(q / p)


def _distinct_repeats(keys: np.ndarray) -> np.ndarray:
    """True at each element whose value occurs more than once."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def _judge(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets, w, _ in _hashed(batch):
                n = b - a
                h = T.span_hash(data, w.start, w.end)
                n_words = np.diff(w.first)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                chars = np.bincount(w.row, lead[w.end] - lead[w.start], n).astype(np.int64)
                symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
                n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]

                # lines: between newlines, not across rows; only those with a word
                cut = np.flatnonzero(data == 10)
                begin = np.sort(np.concatenate([offsets[:-1], cut + 1]))
                stop = np.sort(np.concatenate([cut, offsets[1:]]))
                line_row = np.searchsorted(offsets, begin, "right") - 1
                has = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
                begin, stop, line_row = begin[has], stop[has], line_row[has]
                lines = T.mix(T.span_hash(data, begin, stop) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                first = np.zeros(len(lines), bool)
                first[np.unique(lines, return_index=True)[1]] = True
                n_dup_lines = np.bincount(line_row[~first], minlength=n)

                repeat = np.zeros(len(h), bool)
                three = T.window_hash(h, 3)
                at = np.flatnonzero(w.row[2:] == w.row[:-2])
                if len(at):
                    again = at[_distinct_repeats(T.mix(three[at] + w.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
                    for k in range(3):
                        repeat[again + k] = True
                n_repeat = np.bincount(w.row[repeat], minlength=n)

                lower = T.LOWER[data]
                bucket, row = _grams(T.span_hash(lower, w.start, w.end), w)
                total, grams = np.bincount(row, ratio[bucket], n), np.bincount(row, minlength=n)
                score = total / np.maximum(grams, 1)
                failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), *[pa.array(x, pa.int64()) for x in (n_words, chars, n_symbols, n_dup_lines, n_repeat)], pa.array(failed), pa.array(score)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"],
                )

    return run


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base rules and log-likelihood-ratio verdict of each document.

    Words are runs of bytes other than space and 09-0D. Null and empty texts have no words,
    score 0 and fail the base rules. Repeated rows are each judged. Empty tables give
    empty results. Other columns are ignored.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score (mean log ratio of the hashed n-grams).
    """
    spark = prepare(docs.sparkSession)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    ratio = log_ratios(source, trusted)
    schema = f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double"
    judged = source.mapInArrow(_judge(ratio), schema)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
