"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the corpus's most frequent pre-tokens and the number of
tokens that each gives; tier two is a bounded cache in each Python worker, filled by
encoding what the table misses. No pre-token is shuffled in the counting pass. The table
only saves work: its size is a fixed parameter, and a count never depends on it.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.llm import _text as T
from lexigate.llm._session import prepare

#: Pre-tokens in the broadcast table, and pre-tokens that a partition proposes for it.
TABLE = 50_000
#: Documents that propose entries of the table, and tasks that they are dealt to.
PROPOSERS, TASKS = 20_000, 8
PROPOSED = 20_000
#: Distinct pre-tokens that a worker remembers, or counts, before it forgets the rare ones.
CACHE = 300_000
#: Length of a pre-token with a code point that is unassigned here: whether it is a letter
#: depends on a library's Unicode version, so its text goes to the tokenizer as a whole.
UNSURE = -1


class PreTokenizer:
    """The pre-tokens of a text as the tokenizer file defines them, and the length of each.

    A text is first split at the added special strings, which count as one token each;
    then comes the file's normaliser, and its split pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lowers = steps == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1]["content"] == " "
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {}
        for b in range(128):
            self.letters[b] = letters.pre_tokenize_str(chr(b))[0][0]
        self.map = letters.pre_tokenize_str
        self.ascii = str.maketrans({chr(k): v for k, v in self.letters.items()})

    def normal(self, text: str) -> str:
        """The text as the file's normaliser (NFC, spaces, lower case) would give it to the pattern.

        The pattern passes over spaces, so only letters matter: where NFC changes nothing, lower
        case is enough, but for sigma, whose form depends on its place in Python alone.
        """
        if self.lowers and (text.isascii() or "\u03a3" not in text and unicodedata.is_normalized("NFC", text)):
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def __call__(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of special strings) of a text."""
        normal = self.normal
        if "<|" in text and self.at_special is not None and (n := len(self.at_special.findall(text))):
            out: list[str] = []
            for part in self.at_special.split(text):
                out += self.find(normal(part))
            return out, n
        return self.find(normal(text)), 0

    def length(self, word: str) -> int:
        """Tokens of one pre-token, by the file's merges; UNSURE where tables of letters may differ."""
        if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
            return UNSURE
        mapped = word.translate(self.ascii) if word.isascii() else self.map(word)[0][0]
        return len(self.tokenizer.model.tokenize(mapped))


def _proposals(path: str):
    """The most frequent pre-tokens of a partition; rare ones are forgotten when there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = PreTokenizer(path), Counter()
        for batch in batches:
            for text in T.texts(batch).to_pylist():
                seen.update(split(text)[0])
                if len(seen) > CACHE:
                    seen = Counter(dict(seen.most_common(CACHE // 3)))
        top = [x for x in seen.most_common(PROPOSED) if x[1] > 1]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.int64())], ["word", "n"])

    return run


def frequent_lengths(docs: DataFrame, path: str, size: int = TABLE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about PROPOSERS documents: ``size`` entries at most.

    The table only saves work: a pre-token that it lacks is encoded where it is met. A few
    tasks propose PROPOSED entries each and the driver merges them, so no pre-token is shuffled.
    """
    text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    share = PROPOSERS / max(1, docs.count())
    some = text.where(F.rand(17) < share) if share < 1 else text
    rows = some.repartition(TASKS).mapInArrow(_proposals(path), "word string, n bigint").toArrow()
    seen = Counter()
    for word, n in zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True):
        seen[word] += n
    split = PreTokenizer(path)
    lengths = {word: split.length(word) for word, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]}
    return {word: n for word, n in lengths.items() if n != UNSURE}


def _count(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, table, cache = PreTokenizer(path), shared.value, {}
        for batch in batches:
            n_tokens = []
            for text in T.texts(batch).to_pylist():
                pre, n = split(text)
                for word, k in Counter(pre).items():
                    size = table.get(word)
                    if size is None and (size := cache.get(word)) is None:
                        if len(cache) >= CACHE:
                            cache.clear()
                        size = cache[word] = split.length(word)
                    if size == UNSURE:
                        n = len(split.tokenizer.encode(text, add_special_tokens=False).ids)
                        break
                    n += size * k
                n_tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048, table: int = TABLE) -> DataFrame:
    """Tokens of each whole text under the tokenizer file at ``path``.

    No begin, end or added special tokens; special strings inside a text are one token
    each. Null texts count as empty: 0 bytes, 0 tokens. Rows are returned one for one,
    repeated ones too; an empty table gives an empty result; other columns are ignored.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).
    """
    spark = prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    source = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, path, table))
    counted = source.mapInArrow(_count(path, shared), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
