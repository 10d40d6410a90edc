"""SentencePiece BPE in vectorised merge rounds.

The words of a block lie one after another in a flat array of symbols. A round takes the least
pair rank of each word, merges its occurrences from the left in all words at once, looks the
changed pairs up, and lays aside the words that have no pair left.

All occurrences of a word's least pair may be merged in one round where every piece ranks after
the two pieces that it is made of: what a merge brings up comes later than what is merged. This
is tested when the vocabulary is read. Pieces that share the last rank (runs of spaces) are merged by
one pass from the left, once nothing else is left in their word. A vocabulary that is not ordered
like this is merged one leftmost pair a word and round, which is right for any vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.llm import _text as T
from lexigate.llm._session import prepare

SPACE = "▁"
#: Distinct words that a worker remembers, and the letters of the longest of them.
CACHE, LONGEST = 300_000, 64
#: Characters of a text that are split into words at a time; a longer word makes its own chunk.
CHUNK = 1 << 19
#: Rows of one output batch.
ROWS = 200
#: Rank of a pair that makes no piece.
NONE = np.int32(2**31 - 1)

_WORD = re.compile(" *[^ ]+| +")
_CUT = re.compile("[^ ](?= )")


class Codec:
    """Encodes words with the pieces of a model file; decodes by the inverse table.

    Only models that normalise by identity, put a space in front, and fall back to bytes are
    read; others, and those with pieces given by a user, are refused.
    """

    def __init__(self, path: str, steady: bool | None = None):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or not train.byte_fallback or train.model_type != 2:
            raise ValueError("only byte-fallback BPE models with identity normalisation are read")
        kinds = [p.type for p in model.pieces]
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("pieces given by a user, or left out of use, are not read")
        self.names = [str(i) for i in range(len(kinds))]
        self.raw = [_raw(p.piece, p.type) for p in model.pieces]
        self.byte = {self.raw[i][0]: i for i, k in enumerate(kinds) if k == 6}
        self.size = len(kinds)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        scores = -np.array([p.score for p in model.pieces])
        self.rank = np.full(self.size + 1, NONE, np.int32)  # the last one stands for no piece
        own = np.array(list(normal.values()))
        self.rank[own] = np.unique(scores[own], return_inverse=True)[1]
        self.letter = np.full(0x110000, -1, np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.letter[ord(piece)] = i
        self.letter[0x20] = self.letter[ord(SPACE)]
        splits = [(normal[p[:k]], normal[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        left, right, made = np.array(splits).T
        order = np.argsort(left * self.size + right)
        self.keys, self.made = (left * self.size + right)[order], made[order].astype(np.int32)
        near = {(p[k], p[k + 1]) for p in normal for k in range(len(p) - 1)}
        known = [(self.letter[ord(a)], self.letter[ord(b)]) for a, b in near]
        self.near = np.sort(np.array([a * self.size + b for a, b in known if a >= 0 and b >= 0]))
        self.whole = any(b == SPACE != a for a, b in near)  # a piece goes on beyond a space: texts are one word
        self.last = self.rank[own].max() if (self.rank[own] == self.rank[own].max()).sum() > 1 else NONE
        self.tied = {(a, b): z for a, b, z in splits if self.rank[z] == self.last}
        self.steady = False
        self.steady = self._in_order(list(normal)) if steady is None else steady
        self.cache: dict[str, bytes] = {}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or the one that stands for none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], self.size)

    def _in_order(self, pieces: list[str]) -> bool:
        """Whether every piece ranks after the two that it is made of.

        Its last two parts are found by merging the piece as a word, one pair at a time: what a
        word holds between two places is merged alike wherever it stands, so no other two parts
        of it ever come to stand side by side.
        """
        pieces = [p for p in pieces if len(p) > 1]
        first = np.cumsum([0, *map(len, pieces)])
        sym = self.letter[np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)]
        start = np.zeros(len(sym), bool)
        start[first[:-1]] = True
        ids, place = self._rounds(sym, start, least=2)
        bounds = np.searchsorted(place, first)
        two = bounds[:-1][np.diff(bounds) == 2]
        made = self.pairs(ids[two], ids[two + 1])
        rank, before = self.rank[made], np.maximum(*(np.where(np.isin(x, self.letter), -1, self.rank[x]) for x in (ids[two], ids[two + 1])))
        unique = rank[(rank < self.last) & (made < self.size)]
        return bool(np.all((rank > before) | (rank == self.last)) and np.unique(unique).size == np.unique(made[(rank < self.last) & (made < self.size)]).size)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        first = np.cumsum([0, *map(len, words)])
        sym = self.letter[letters]
        key = sym[:-1].astype(np.int64) * self.size + sym[1:]
        at = np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)
        start = np.ones(len(sym), bool)
        start[1:] = (self.near[at] != key) | (sym[:-1] < 0) | (sym[1:] < 0)  # no piece holds these two letters
        start[first[:-1]] = True
        sym = np.where(sym < 0, -1 - letters.astype(np.int32), sym)
        ids, place = self._rounds(sym, start)
        if (odd := ids < 0).any():  # letters of no piece become bytes
            raw = [[self.byte[b] for b in chr(-1 - x).encode()] for x in ids[odd].tolist()]
            n = np.ones(len(ids), np.int64)
            n[odd] = [len(x) for x in raw]
            place, ids = np.repeat(place, n), np.repeat(ids, n)
            ids[ids < 0] = [b for x in raw for b in x]
        bounds = np.searchsorted(place, first)
        flat = ids.astype("<i4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _rounds(self, sym: np.ndarray, start: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The symbols when no pair, or no more than ``least`` symbols, are left, and the letter at which each begins."""
        place = np.arange(len(sym))
        made = np.full(len(sym), self.size, np.int32)
        made[:-1] = np.where(start[1:], self.size, self.pairs(sym[:-1], sym[1:]))
        rank = self.rank[made]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            bounds = np.flatnonzero(start)
            sizes = np.diff(bounds, append=len(sym))
            low = np.minimum.reduceat(rank, bounds)
            over = (low == NONE) | ((low == self.last) & self.steady) | (sizes <= least)
            if over.any():  # compaction: only words with a pair stay
                off, stay = np.repeat(over, sizes), np.repeat(~over, sizes)
                tied = np.repeat(low == self.last, sizes)[off] & self.steady & (self.last != NONE)
                done.append(self._from_left(sym[off], place[off], start[off], tied))
                sym, place, start, made, rank = sym[stay], place[stay], start[stay], made[stay], rank[stay]
                low, sizes = low[~over], sizes[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            if self.steady:  # of pairs that overlap, every other one from the left
                new = np.diff(at, prepend=-2) != 1
                run = np.arange(len(at))
                at = at[(run - np.maximum.accumulate(np.where(new, run, 0))) % 2 == 0]
            else:
                word = np.cumsum(start)[at]
                at = at[np.diff(word, prepend=-1) > 0]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, place, start, made, rank = sym[keep], place[keep], start[keep], made[keep], rank[keep]
            at -= np.arange(len(at))
            at = np.union1d(at, at[~start[at]] - 1)
            right = np.minimum(at + 1, len(sym) - 1)
            made[at] = np.where((at == right) | start[right], self.size, self.pairs(sym[at], sym[right]))
            rank[at] = self.rank[made[at]]
        if not done:
            return sym, place
        ids, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return ids[order], place[order]

    def _from_left(self, sym: np.ndarray, place: np.ndarray, start: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the pairs of the last rank, all of one rank: each symbol joins what stands left of it, as long as it can."""
        if not tied.any():
            return sym, place
        ids, at = [], []
        for s, p, new in zip(sym[tied].tolist(), place[tied].tolist(), start[tied].tolist(), strict=True):
            bottom = len(ids) if new else bottom
            ids.append(s)
            at.append(p)
            while len(ids) > bottom + 1 and (z := self.tied.get((ids[-2], ids[-1]))) is not None:
                ids[-2:] = [z]
                at.pop()
        return np.concatenate([sym[~tied], np.array(ids, np.int32)]), np.concatenate([place[~tied], np.array(at)])

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a text with a space in front, chunk by chunk; an empty text has none."""
        text, a = text and " " + text.replace(SPACE, " "), 0
        while a < len(text):
            cut = _CUT.search(text, a + CHUNK) if a + CHUNK < len(text) and not self.whole else None
            b = cut.end() if cut else len(text)
            yield [text] if self.whole else _WORD.findall(text[a:b])
            a = b

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; new words of all texts go through the same rounds."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for words in self.split(text):
                held.append((i, words))
                size += len(words)
                if size > CHUNK // 4:
                    self._flush(held, out)
                    size = 0
        self._flush(held, out)
        return [b"".join(x) for x in out]

    def _flush(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.cache) > CACHE:
            self.cache.clear()
        fresh = list({w for _, words in held for w in words if w not in self.cache})
        if fresh:
            self.cache.update(zip(fresh, self.encode_words(fresh), strict=True))
        for i, words in held:
            out[i].append(b"".join(map(self.cache.__getitem__, words)))
        for w in fresh:
            if len(w) > LONGEST:
                del self.cache[w]
        held.clear()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a byte that is no part of a letter becomes U+FFFD, control pieces nothing."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        if raw[:1] == b" " and next((self.raw[i] for i in ids if self.raw[i]), b"")[:1] == b" " and not (ids and self.byte.get(0x20) == ids[0]):
            raw = raw[1:]  # the space that encoding put in front
        return re.sub("[\ud800-\udfff]", "�", raw.decode("utf-8", "surrogateescape"))


def _raw(piece: str, kind: int) -> bytes:
    """What a piece stands for: one byte, a mark for the unknown one, nothing for control pieces."""
    if kind == 6:
        return bytes([int(piece[1:-1], 16)])
    return {2: " ⁇ ".encode(), 3: b""}.get(kind, piece.replace(SPACE, " ").encode())


def _code(path: str, digest: bool):
    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            texts = T.texts(batch)
            for at in range(0, len(texts), ROWS):
                n, ids, back = [], [], []
                for raw in codec.encode(texts.slice(at, ROWS).to_pylist()):
                    coded = np.frombuffer(raw, "<i4")
                    flat = coded.tolist()
                    decoded = codec.decode(flat)
                    n.append(len(flat))
                    ids.append(sha(",".join(map(codec.names.__getitem__, flat))) if digest else coded)
                    back.append(sha(decoded) if digest else decoded)
                kind = pa.string() if digest else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(back, pa.string())], ["carry", "n_tokens", "ids", "decoded"])

    return run


def encode_pieces(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Encode each whole text with a sentencepiece BPE model, and decode the ids again.

    Null texts are empty: no ids, no letters. Rows are returned one for one, repeated ones
    too; an empty table gives an empty result; other columns are not carried.

    Returns doc_id, n_tokens, ids (array<int>) and decoded (string); with ``digest``
    the SHA-256 of either instead, ids as decimals joined by commas.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").alias("carry"), F.col("text").cast("string").alias("text"))
    kind = source.schema["carry"].dataType.simpleString()
    types = f"ids {'string' if digest else 'array<int>'}, decoded string"
    return source.mapInArrow(_code(path, digest), f"carry {kind}, n_tokens bigint, {types}").withColumnRenamed("carry", "doc_id")
