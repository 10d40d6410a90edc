"""Byte-level BPE through a sentencepiece model that is written straight from the ranks.

Each byte is mapped to one character, each vocabulary entry to the piece of its bytes'
characters with the score -rank; normalisation is the identity and nothing is escaped or
prefixed. Sentencepiece then merges the best-scored neighbours first, leftmost among
equals, which is the merge order of the ranks. A pre-token that is an entry is that entry.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.llm import _text as T
from lexigate.llm._session import prepare

#: First of 256 characters that stand for the bytes: letters that no normaliser or space rule touches.
FIRST = 0x4E00
#: Distinct pre-tokens that a worker remembers.
CACHE = 300_000
#: Rows of one output batch.
ROWS = 200


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in rank order (ranks count from 0 without gaps)."""
    with open(path, "rb") as f:
        entries = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [entries[i] for i in range(len(entries))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol-buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TABLE)


_TABLE = {b: chr(FIRST + b) for b in range(256)}


def model_bytes(entries: list[bytes]) -> bytes:
    """The serialised sentencepiece model: piece i is entry i; one unknown piece follows."""
    pieces = [_field(1, _field(1, _letters(x).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, x in enumerate(entries)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(entries) + 1) + _field(40, len(entries)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encode pre-tokens with a bounded cache; decode by the inverse mapping."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.entries = read_ranks(path)
        self.whole = {x: i for i, x in enumerate(self.entries)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.entries))
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def piece(self, word: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        raw = word.encode()
        one = self.whole.get(raw)
        ids = [one] if one is not None else self.model.encode(_letters(raw))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        cache, out = self.cache, []
        for word in self.find(text):
            ids = cache.get(word)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = cache[word] = self.piece(word)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _code(path: str, pattern: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            texts = T.texts(batch)
            for at in range(0, len(texts), ROWS):
                n, ids, back = [], [], []
                for text in texts.slice(at, ROWS).to_pylist():
                    coded = codec.encode(text)
                    raw = codec.decode(coded)
                    n.append(len(coded) // 4)
                    ids.append(hashlib.sha256(coded).hexdigest() if digest else np.frombuffer(coded, "<u4").astype(np.int32))
                    back.append(hashlib.sha256(raw).hexdigest() if digest else raw)
                kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(ids, kinds[0]), pa.array(back, kinds[1])], ["carry", "n_tokens", "ids", "decoded"])

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """Encode each whole text, and decode the ids again.

    Null texts are empty: no ids, no bytes. Rows are returned one for one, repeated ones
    too; an empty table gives an empty result.

    Returns doc_id, n_tokens, ids (array<int>) and decoded (binary); with
    ``digest`` the SHA-256 of either instead, ids as little-endian unsigned 32-bit integers.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").alias("carry"), F.col("text").cast("string").alias("text"))
    kind = source.schema["carry"].dataType.simpleString()
    types = "ids string, decoded string" if digest else "ids array<int>, decoded binary"
    return source.mapInArrow(_code(path, pattern, digest), f"carry {kind}, n_tokens bigint, {types}").withColumnRenamed("carry", "doc_id")
