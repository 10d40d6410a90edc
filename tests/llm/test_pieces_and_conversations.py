"""Piece encoding against the library; repair and trie of conversations against brute force and SQL."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigate.llm import conversation_repair, piece_bpe, prefix_trie, queries
from lexigate.llm.vocabularies import vocabulary
from tests.conftest import SMALL
from tests.llm.test_operators import EDGES
from tests.oracle import connect, difference

MODEL = "piece_bpe_32k.model"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# 11: pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.Codec(vocabulary(MODEL))


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<i4").tolist()


def strings(n: int) -> list[str]:
    random.seed(11)
    odd = [chr(c) for c in range(0x250)] + list("İͅΣ  　‍\U0001f600一ẞﬁ▁▁  日本語のです") + ["<s>", "<0x0A>", "</s>", "<unk>", "     ", "aaaa", "the", "  "]
    pools = [odd, list("etaoinsrhl  "), list("a ▁")]
    return ["".join(random.choice(pools[i % 3]) for _ in range(random.randrange(40))) for i in range(n)]


def test_pieces_of_documents_are_the_library_s(spark, library):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.op11_piece_bpe(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        want = library.encode(x)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(want), sha(",".join(map(str, want))), sha(library.decode(want)))


def test_pieces_of_edge_rows(spark, library):
    docs = spark.createDataFrame(EDGES, "doc_id bigint, text string").select("*", F.lit(1).alias("carry"), F.lit("x").alias("ids"), F.lit("y").alias("decoded"))
    found = piece_bpe.encode_pieces(docs, vocabulary(MODEL)).collect()
    want = collections.Counter((i, tuple(library.encode(x or "")), library.decode(library.encode(x or ""))) for i, x in EDGES)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in found) == want
    assert piece_bpe.encode_pieces(docs.limit(0), vocabulary(MODEL)).count() == 0


def test_merge_rounds_agree_with_the_library(library, codec):
    """Also one pair a round, which any vocabulary may need, and words of one letter or of spaces alone."""
    assert codec.steady
    texts = strings(3000) + [x * n for x in " a▁x" for n in (1, 2, 15, 16, 17, 31, 33, 500)]
    want = library.encode(texts)
    assert [ids(x) for x in codec.encode(texts)] == want
    assert [ids(x) for x in piece_bpe.Codec(vocabulary(MODEL), steady=False).encode(texts)] == want
    assert all(codec.decode(i) == library.decode(i) for i in want)


def test_any_ids_decode_as_the_library_does(library, codec):
    random.seed(12)
    for _ in range(3000):
        some = [random.choice([random.randrange(3, 259), random.randrange(32000), random.randrange(259, 300)]) for _ in range(random.randrange(8))]
        assert codec.decode(some) == library.decode(some), some


def test_long_texts_in_chunks_and_long_words(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CHUNK", 50)
    small = piece_bpe.Codec(vocabulary(MODEL))
    texts = [" ".join(strings(40)), "  ".join("the end of it" for _ in range(200)), "\n".join(strings(30))]
    assert [ids(x) for x in small.encode(texts)] == library.encode(texts)
    monkeypatch.setattr(piece_bpe, "CHUNK", 1 << 19)
    monkeypatch.setattr(piece_bpe, "CACHE", 3)
    for long in ["a" * (1 << 20), "x y" * (1 << 18), " " * (1 << 18), "中" * (1 << 18)]:
        assert small.decode(ids(small.encode([long])[0])) == long


# 12: repair


CODES = [0, 1, 2, 3, 1, 2, 1, 2, 5, 6, 9, 10, 12, 13, 14, 15]


def exhaustive(codes: bytes) -> tuple[int, str]:
    """Every edit script with at most two insertions in a row."""
    accepted, best = re.compile(r"(s?(ua)+)?"), [(10**9, "")]

    def go(i: int, out: str, cost: int, audit: str, inserted: int) -> None:
        if cost > best[0][0]:
            return
        if i == len(codes):
            if accepted.fullmatch(out):
                best[0] = min(best[0], (cost, audit))
        else:
            role, fault = codes[i] & 3, codes[i] >> 2
            more = 3 * (fault == conversation_repair.CUT)
            go(i + 1, out, cost + 4, audit + "D", 0)
            if fault in (0, conversation_repair.CUT):
                for x in "ua":
                    go(i + 1, out + x, cost + 3 + more, audit + "R", 0)
                if role < 3:
                    go(i + 1, out + "sua"[role], cost + more, audit + "K", 0)
        if inserted < 2:
            for x in "ua":
                go(i, out + x, cost + 3, audit + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return best[0]


def along(codes: bytes) -> tuple[int, str]:
    """From the left, the least (cost, audit) of each last role."""
    states = {"": (0, "")}

    def step(cost: int, edit: str, roles: str, given: dict) -> dict:
        out: dict = {}
        for last, (c, a) in given.items():
            for x in roles or [""]:
                if not x or (x == "s" and not last) or (x == "u" and last != "u") or (x == "a" and last == "u"):
                    v = (c + cost, a + edit)
                    out[x or last] = min(out.get(x or last, v), v)
        return out

    def least(*many: dict) -> dict:
        out: dict = {}
        for d in many:
            for k, v in d.items():
                out[k] = min(out.get(k, v), v)
        return out

    def close(given: dict) -> dict:
        for _ in range(3):
            given = least(given, step(3, "I", "ua", given))
        return given

    for code in codes:
        role, fault = code & 3, code >> 2
        more = 3 * (fault == conversation_repair.CUT)
        given = close(states)
        states = step(4, "D", "", given)
        if fault in (0, conversation_repair.CUT):
            states = least(states, step(3 + more, "R", "ua", given), step(more, "K", "sua"[role], given) if role < 3 else {})
    return min(v for k, v in close(states).items() if k in ("", "a"))


def test_cells_hold_the_cheapest_repairs():
    random.seed(13)
    short = [bytes(random.choice(CODES) for _ in range(random.randrange(5))) for _ in range(300)]
    assert [(c, conversation_repair.audit(t)) for c, t in conversation_repair.parse(short)] == [exhaustive(x) for x in short]
    long = [bytes(random.choice(CODES) for _ in range(random.randrange(90))) for _ in range(600)]
    assert [(c, conversation_repair.audit(t)) for c, t in conversation_repair.parse(long)] == [along(x) for x in long]


def test_rules_are_the_products_of_words():
    for x, y, z in conversation_repair.RULES:
        a, b = conversation_repair.SYMBOLS[y], conversation_repair.SYMBOLS[z]
        assert re.fullmatch("(s?(ua)*u?)|((a|(ua)+|a(ua)*)u?)|", a + b) or re.fullmatch("a?(ua)*u?", a + b)
        assert conversation_repair.symbol(a + b) == x
    assert len(conversation_repair.RULES) == 29


def by_hand(rows: list[tuple]) -> tuple:
    """Counts, repair and repaired lines of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes, faults = set(), [], [0] * 4
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
        seen.add((role, text))
        faults[fault] += 1
        codes.append(("sua".find(role[0]) % 4 if role else 3) + 4 * fault)
    cost, audit = along(bytes(codes))
    out, rest, before = [], iter(rows), ""
    for e in audit:
        row = next(rest) if e != "I" else (None, "", "")
        if e != "D":
            role = row[1] if e == "K" else "assistant" if before == "u" else "user"
            before = role[0]
            out.append(f"{role}:{row[2]}")
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *faults[1:], illegal, cost, audit, sha("\n".join(out))), out


#: Nulls in every column, ties, repeated rows, roles of other initials, gaps, an empty text, and one long conversation.
TURNS = [
    (1, 0, "user", "Fine."), (1, 1, "assistant", "Good."), (2, None, "user", "No turn."), (2, 5, None, "No role?"), (2, 5, "assistant", None), (2, 9, "assistant", "end"),
    (3, 1, "user", "A."), (3, 1, "user", "A."), (3, 1, "assistant", "B."), (None, 1, "user", "null id."), (None, 2, "assistant", "yes."),
    (4, 0, "system", "Be kind."), (4, 1, "tool", "x."), (4, 2, "", "no role."), (5, 3, "assistant", ""), (6, 7, "system", "Alone."), (7, 1, "user", "Ünï\n  x!\t\x0b "),
]
LONG = [(8, i, random.Random(i).choice(["user", "assistant", "system"]), f"turn {i % 700}{'.' if i % 3 else ''}") for i in range(2500)]


def test_repair_of_edge_rows(spark):
    given = TURNS + LONG
    convs = spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string").select("*", *[F.lit(c).alias(c) for c in ("carry", "pos", "code", "h", "again", "present", "phase", "x")])
    groups = collections.defaultdict(list)
    for c, t, r, x in given:
        groups[c].append((t, " " if r is None else r, " " if x is None else x))
    want = {c: by_hand(v) for c, v in groups.items()}
    found = conversation_repair.audit_repairs(convs).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == {c: w[0] for c, w in want.items()} and len(found) == len(want)
    turns = collections.defaultdict(list)
    for r in conversation_repair.repaired_turns(convs).orderBy("conv_id", "seq").collect():
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: v for c, (_, v) in want.items() if v} == turns
    assert conversation_repair.audit_repairs(convs.limit(0)).count() == 0
    gone = conversation_repair.audit_repairs(convs, F.lit(None).cast("boolean")).collect()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", sha(""))} and len(gone) == len(want)


def test_repair_in_batches_of_any_size(spark):
    """A conversation's codes and rows may end anywhere in a batch."""
    convs = spark.createDataFrame(TURNS + LONG[:40], "conv_id bigint, turn bigint, role string, text string").coalesce(1)
    want = sorted(map(repr, conversation_repair.audit_repairs(convs).collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 2, 3, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            assert sorted(map(repr, conversation_repair.audit_repairs(convs).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_prefix_trie"])
def test_conversation_queries_match_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], connect(SMALL)) == ""


# 13: prefix trie


def trie_by_hand(given: list[tuple], rebuilt: bool) -> list[tuple]:
    convs = collections.defaultdict(list)
    for c, t, r, x in given:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    for v in convs.values():
        v.sort()
    words = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuilt else 0
        first = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        words[c] = tuple([x[3:] for x in convs.get(first, [])[:h]] + [x[3:] for x in v[h:]])
    nodes = collections.defaultdict(list)
    for c in sorted(words):
        for d in range(len(words[c]) + 1):
            nodes[words[c][:d]].append(c)
    below = {k: [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k] for k in nodes}
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below[k]) or 1
        saved[k] = sum(saved[x] for x in below[k]) + (len(nodes[k]) - 1) * len(k[-1][1].encode()) * bool(k) if k else sum(saved[x] for x in below[k])
    return [(m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), len(below[k]), leaves[k], saved[k], sha(",".join(str(c) for c in m if words[c] == k))) for k, m in nodes.items()]


def digests(trie: prefix_trie.Trie) -> list[str]:
    nodes = trie.nodes.join(prefix_trie.end_digests(trie.ends), "node_id", "left").fillna({"ends_sha256": sha("")})
    return sorted(map(repr, map(tuple, nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256").collect())))


def test_trie_of_edge_rows(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, negative ids, conversations without turns of their own, identical and prefix conversations."""
    random.seed(14)
    given = TURNS + [(c, t, random.choice(["user", "assistant"]), random.choice(["a", "b", "é", None])) for c in [*range(-12, 0), *range(10, 60)] for t in range(random.randrange(1, 12))]
    given += [(c, t, "user", "same") for c in range(3000, 3300) for t in range(3)]
    convs = spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string").select("*", *[F.lit(c).alias(c) for c in ("pos", "turn_id", "n_bytes", "depth", "node_id", "c", "weight")])
    rows = prefix_trie.turns(convs)
    assert digests(prefix_trie.prefix_trie(prefix_trie.rebuild(rows))) == sorted(map(repr, trie_by_hand(given, True)))
    trie = prefix_trie.prefix_trie(prefix_trie.named(rows))
    assert digests(trie) == sorted(map(repr, trie_by_hand(given, False)))
    assert trie.ends.selectExpr("sum(size(conv_ids))").first()[0] == len({c for c, *_ in given if c is not None})
    nothing = prefix_trie.prefix_trie(prefix_trie.rebuild(prefix_trie.turns(convs.limit(0))))
    assert nothing.nodes.count() == nothing.ends.count() == 0


def test_trie_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(repr, map(tuple, queries.op13_prefix_trie(spark, SMALL).collect()))) == sorted(map(repr, trie_by_hand(rows, True)))
