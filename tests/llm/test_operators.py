"""The operators against brute force, on the small tables and on planted edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigate.llm import _buckets, byte_bpe, context_tree, decontaminate, language_id, line_dedup, near_dedup, pairwise_quality, pii, quality_rules, queries, token_counts
from lexigate.llm._buckets import bucket_components
from lexigate.llm._edits import distances
from lexigate.llm.vocabularies import PATTERN, vocabulary
from tests.conftest import SMALL

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: doc_id, text: null, empty, blank, ties, repeated rows, null and repeated ids, odd bytes.
EDGES = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "a null id has words too"),
    (6, "ÀÉ ñ 日本語 \x00   end"), (7, "x" * 3000), (8, "1234 " * 400), (9, "<|endoftext|> it's fine"), (10, "A-B\na-b\nA-B\n"),
]


def words(text, pattern=WORD):
    return pattern.findall((text or "").encode().translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def edges(spark):
    """The edge rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(EDGES, "doc_id bigint, text string").select("doc_id", "text", *[F.lit(c).alias(c) for c in ("carry", "n", "keys", "key", "node", "spans", "row", "cid", "n_removed", "row_", "gone_", "owner_", "h", "h_", "hit_", "label", "one", "learn", "meets", "window", "sketch", "line", "kept")])


@pytest.fixture(scope="module")
def empty(edges):
    return edges.limit(0)


def held_out(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


# 1 and 6: token counts, byte-level BPE


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_token_counts(spark, rows, edges, empty):
    t = _tokenizer()
    got = {r["doc_id"]: r for r in queries.op1_token_counts(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(x.encode()), n, n > 2048)
    found = token_counts.token_counts(edges, vocabulary("word_bpe_49k.json"), table=3).select("doc_id", "n_tokens").collect()
    want = [(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in EDGES]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert token_counts.token_counts(empty, vocabulary("word_bpe_49k.json")).count() == 0


def _strings(n=3000):
    random.seed(3)
    pool = [chr(c) for c in range(0x250)] + list("İͅΣ  　‍\U0001f600一ẞﬁ꟏") + ["<|endoftext|>", "'re", "don't", "  "]
    return ["".join(random.choice(pool) for _ in range(random.randrange(14))) for _ in range(n)]


def test_pre_tokens_agree_with_the_library():
    t, split = _tokenizer(), token_counts.PreTokenizer(vocabulary("word_bpe_49k.json"))
    for s in _strings():
        pre, n = split(s)
        lengths = [split.length(w) for w in pre]
        if token_counts.UNSURE not in lengths:
            assert n + sum(lengths) == len(t.encode(s, add_special_tokens=False).ids), s


def _tiktoken():
    import tiktoken

    with open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, rows, edges, empty):
    encoding = _tiktoken()
    got = {r["doc_id"]: r for r in queries.op6_byte_bpe(spark, SMALL).collect()}
    for i, x in rows:
        ids = encoding.encode_ordinary(x)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest()
    found = byte_bpe.encode_texts(edges, vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in found) == collections.Counter((i, tuple(encoding.encode_ordinary(x or "")), (x or "").encode()) for i, x in EDGES)
    assert byte_bpe.encode_texts(empty, vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN).count() == 0


def test_codec_agrees_with_the_library():
    encoding, codec = _tiktoken(), byte_bpe.Codec(vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN)
    for s in _strings():
        ids = codec.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(s) and codec.decode(ids) == s.encode()


# 2: near duplicates


def _groups(items, threshold):
    sets = []
    for _, x in items:
        w = words(x)
        sets.append(frozenset({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sets, [find(i) for i in range(len(items))]


def test_near_duplicates(spark, rows):
    items = sorted(rows)
    sets, root = _groups(items, 85)
    got = {r["doc_id"]: r for r in queries.op2_near_duplicates(spark, SMALL).collect()}
    for k, (i, _) in enumerate(items):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[k]), items[root[k]][0], root[k] == k)


def test_near_duplicates_of_a_large_family(spark, edges, empty):
    """Hundreds of variants of one text at many distances, and copies of each."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(140)]
    items = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(140)] = f"v{rng.randrange(10**6)}"
        items.append((2 * i, " ".join(text)))
        if i % 3 == 0:
            items.append((2 * i + 1, " ".join(text).upper()))
    items.sort()
    _, root = _groups(items, 85)
    df = spark.createDataFrame(items, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, 85).collect()}
    assert got == {i: items[root[k]][0] for k, (i, _) in enumerate(items)}
    found = near_dedup.near_duplicates(edges, 85).collect()
    assert len(found) == len(EDGES) and {(r["doc_id"], r["component_id"]) for r in found if r["doc_id"] in (4, 5)} == {(4, 4), (5, 4)}
    assert all(r["kept"] and r["n_shingles"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    assert near_dedup.near_duplicates(empty, 85).count() == 0


def test_signature_guarantee():
    """Signatures that differ in at most the guaranteed number of indexed symbols share a key."""
    rng = np.random.default_rng(0)
    n = near_dedup.CHUNKS * near_dedup.WIDTH
    for _ in range(300):
        a = rng.integers(0, 256, n)
        b = a.copy()
        b[rng.choice(n, near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1, replace=False)] ^= 1
        assert any(all(a[i] == b[i] for i in kept) for kept in near_dedup._KEPT)


# 3: languages


def test_language_id(spark):
    got = queries.op3_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert out and all(r["held_out"] == held_out(r["doc_id"], 4, 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    net = language_id.train(["aaa bb", "zzz yy"], ["a", "z"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y, live = rng.integers(97, 105, (5, 3)), np.array([0, 1, 0]), np.ones((5, 3))
    _, grad = net.fit_step(x, y, live)
    for name in ("in_f", "rec_b", "rec_f", "out", "bias"):
        flat, g = net.weights[name].reshape(-1), grad[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            keep, step = flat[i], 1e-3
            flat[i] = keep + step
            up = net.fit_step(x, y, live)[0]
            flat[i] = keep - step
            down = net.fit_step(x, y, live)[0]
            flat[i] = keep
            assert abs((up - down) / (2 * step) - g[i]) < 1e-2 * max(0.05, abs(g[i]))


def test_language_edges(edges, empty):
    net = language_id.train(["the cat and the dog", "der Hund und die Katze"] * 5, ["en", "de"] * 5)
    got = {r["carry"]: r for r in language_id.identify(edges, net, F.col("doc_id")).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert got[4]["lang_pred"] in ("en", "de") and 0 <= got[4]["score"] <= 1
    assert language_id.identify(empty, net, F.col("doc_id")).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(edges, language_id.train([], []), F.col("doc_id")).collect()} == {"und"}


# 4: language model


def test_context_tree_base_and_score(spark, rows):
    count, tokens = collections.Counter(), {}
    for i, x in rows:
        tokens[i] = [*words(x), None]
        if not held_out(i, 7, 2):
            count.update(tokens[i])
    n, v = sum(count.values()), len(count)
    for r in queries.op4_context_tree(spark, SMALL).collect():
        t = tokens[r["doc_id"]]
        base = sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(r["doc_id"], 7, 2), len(t), sum(w in count for w in t), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def _tree_by_hand(history, coded, bit_prefix, training, depth):
    """P(next bit = 1) by recursive context-tree weighting over all training symbols."""

    def kt(a, b):
        return math.exp(math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi))

    def node(context, data):
        bits = [(s >> (7 - len(bit_prefix))) & 1 for c, s in data if [(s >> (7 - k)) & 1 for k in range(len(bit_prefix))] == bit_prefix]
        a, b = bits.count(0), bits.count(1)
        own = kt(a, b), (b + 0.5) / (a + b + 1)
        if len(context) == depth:
            return own
        nxt = {c[-len(context) - 1] for c, _ in data}
        product, predicted = 1.0, 0.5
        for s in nxt:
            p, q = node((s, *context), [(c, y) for c, y in data if c[-len(context) - 1] == s])
            product *= p
            if s == history[-len(context) - 1]:
                predicted = q
        weighted = 0.5 * own[0] + 0.5 * product
        w = 0.5 * own[0] / weighted
        return weighted, w * own[1] + (1 - w) * predicted

    return node((), training)[1]


def test_context_tree_weighting_by_hand(spark):
    text = "abab ab ba"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    d = context_tree.DEPTH
    training = []
    for w in text.split():
        line = " " * d + w + " "
        training += [(tuple(line[k - d : k].encode()), ord(line[k])) for k in range(d, len(line))]
    training.append((tuple(b" " * d), context_tree.END))
    want = 0.0
    for c, s in training:
        for k in range(8):
            p = _tree_by_hand(c, s, [(s >> (7 - i)) & 1 for i in range(k)], training, d)
            want += math.log10(p if (s >> (7 - k)) & 1 else 1 - p)
    got = context_tree.code_lengths(df, F.lit(True)).first()
    assert got["score"] == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("table", [0, 8, 1 << 18])
def test_context_tree_reaches_over_words(spark, monkeypatch, table):
    """The contexts of a whole text by hand, whatever part of its grams the table holds; a text that teaches nothing too."""
    monkeypatch.setattr(context_tree, "TABLE", table)
    d = context_tree.DEPTH
    texts = [(1, "Abab ab\n ba", True), (2, "ba ab zab", False), (3, None, True), (4, " ", False)]

    def coded(text):
        line = " " * d + "".join(f"{w} " for w in (text or "").lower().split()) + "\n"
        return [(tuple(line[k - d : k].encode()), ord(line[k])) for k in range(d, len(line))]

    training = [x for _, t, learn in texts if learn for x in coded(t)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, learn boolean")
    got = {r["doc_id"]: r["score"] for r in context_tree.code_lengths(df, F.col("learn"), across=True).collect()}
    for i, t, _ in texts:
        want = 0.0
        for c, s in coded(t):
            for k in range(8):
                p = _tree_by_hand(c, s, [(s >> (7 - j)) & 1 for j in range(k)], training, d)
                want += math.log10(p if (s >> (7 - k)) & 1 else 1 - p)
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_context_tree_edges(edges, empty):
    got = context_tree.code_lengths(edges, F.col("doc_id") != 7).collect()
    assert len(got) == len(EDGES) and all(r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert context_tree.code_lengths(empty, F.lit(True)).count() == 0
    untaught = context_tree.code_lengths(edges, F.lit(False)).where("doc_id = 2").first()
    assert untaught["score"] == pytest.approx(8 * math.log10(0.5)) and untaught["base_score"] == 0


# 5: personal data

KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def _base(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and luhn) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_personal_data(spark, rows, edges, empty):
    rng = random.Random(9)
    pieces = ["a.b@c.de", "x@y.z_q@r.st", "@", "a@b", "1.2.3.4", "256.1.1.1", "0001.02.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "12", " ", "-", ".", "é", "😀", "word", "\n", "49927398716", "+49 30 1234567."]
    made = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))) for i in range(600)]
    for items in (rows, made):
        df = spark.createDataFrame(items, "doc_id bigint, text string")
        for r in pii.span_digest(pii.personal_data(df)).collect():
            want = _base(dict(items)[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (dict(items)[r["doc_id"]], want, r["spans"])
            assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert pii.personal_data(edges).count() == len(EDGES) and pii.personal_data(empty).count() == 0
    long = spark.createDataFrame([(1, "7" * 200_000), (2, "a" * 200_000 + "@"), (3, "1 " * 50_000)], "doc_id bigint, text string")
    assert {r["spans"] for r in pii.span_digest(pii.personal_data(long)).collect()} == {""}


def test_personal_data_of_one_long_text_with_many_spans(spark):
    """Two megabytes with fifty thousand spans, close together and far apart; the work must not grow with their square."""
    far = "write to abc.def@example.com or call +49 30 1234567 now, thank you all; nothing else stands here é\n" * 12_500
    near = "a@b.co 1.2.3.4 " * 12_500
    df = spark.createDataFrame([(1, far + near), (2, near + far)], "doc_id bigint, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r for r in pii.span_digest(pii.personal_data(df)).collect()}
    assert time.monotonic() - began < 120
    for i, x in ((1, far + near), (2, near + far)):
        assert got[i]["base_sha256"] == hashlib.sha256(_base(x).encode()).hexdigest()
        assert got[i]["n_email"] + got[i]["n_ip"] + got[i]["n_phone"] == 50_000


def test_added_kinds(spark):
    items = [(1, "my iban GB82 WEST 1234 5698 7654 32 ok"), (2, "iban GB82WEST12345698765433"), (3, "ssn 123-45-6789"), (4, "number 123-45-6789"), (5, "call my phone 555-123-4567")]
    got = {r["doc_id"]: r["spans"].split(":")[0] for r in pii.span_digest(pii.personal_data(spark.createDataFrame(items, "doc_id bigint, text string"))).collect()}
    assert got == {1: "iban", 2: "", 3: "ssn", 4: "", 5: "local_phone"}


# 7 and 8: quality


def test_pairwise_quality(spark, edges, empty):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = queries.op7_pairwise_quality(spark, SMALL).collect()
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) and (r["score"] >= 0.5) == r["predicted"] for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in out) >= 0.9 * len(out)
    model = pairwise_quality.fit(edges, edges.limit(0).select("doc_id", F.lit(1).alias("label")))
    assert {r["score"] for r in pairwise_quality.score(edges, model).collect()} == {0.5}
    assert pairwise_quality.score(empty, model).count() == 0


def test_pairwise_quality_learns_from_every_labelled_document(spark):
    """Means, loss and cut against all pairs by hand, with more labelled documents than any sample held."""
    rng = np.random.default_rng(3)
    text = lambda i: " ".join("".join(rng.choice(list("abcDE#1,"), rng.integers(1, 9 if i % 3 else 6))) for _ in range(rng.integers(1, 12)))
    items = [(i, text(i), int(i % 3 > 0)) for i in range(9000)]
    table = spark.createDataFrame(items, "doc_id bigint, text string, label int")
    model = pairwise_quality.fit(table.select("doc_id", "text"), table.select("doc_id", "label"))
    raw = [t.encode() for _, t, _ in items]
    x = pairwise_quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])).astype(np.float32).astype(float)
    y = np.array([z for *_, z in items])
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-6) and np.allclose(model.scale, x.std(axis=0) + 0.02, atol=1e-5)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    worth = z @ model.weights
    good, bad = z[y == 1], z[y == 0]
    pull = 1 / (1 + np.exp(worth[y == 1][:, None] - worth[y == 0][None, :]))
    slope = (pull.sum(axis=0) @ bad - pull.sum(axis=1) @ good) / pull.size + pairwise_quality.DECAY * model.weights
    assert np.linalg.norm(model.weights) > 0.1 and np.linalg.norm(slope) < 1e-3
    ordered = np.sort(worth)
    assert model.cut == pytest.approx((ordered[2999] + ordered[3000]) / 2, abs=1e-9)


def test_quality_rules(spark, rows, edges, empty):
    def want(text):
        w = WORD.findall((text or "").encode())
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        repeated = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line.encode()):
                dup += line in seen
                seen.add(line)
        return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w))

    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in queries.op8_quality_rules(spark, SMALL).collect():
        assert tuple(r[c] for c in columns) == want(dict(rows)[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    got = quality_rules.quality_rules(edges, edges.where("doc_id = 4")).select("doc_id", *columns).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((i, *want(x)) for i, x in EDGES)
    assert quality_rules.quality_rules(empty, empty).count() == 0


def test_quality_target_counts_every_trusted_document(spark):
    """Score and verdict against counts by hand, with more trusted documents than any sample held."""
    text = lambda i: " ".join(f"w{i % 7}x{j}" for j in range(60)) if i < 70 else f"V{i % 1000} end"
    good = lambda i: i % 4 != 3 and i % 7 != 5
    items = [(i, text(i)) for i in range(40_000)]
    docs = spark.createDataFrame(items, "doc_id bigint, text string")
    trusted = spark.createDataFrame([(i,) for i, _ in items if good(i)] + [(None,), (1,)], "doc_id bigint")

    def grams(x):
        w = x.lower().split()
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    def bucket(gram):
        data = np.frombuffer(gram.encode(), np.uint8)
        w = quality_rules.T.words(data, np.array([0, len(data)]), quality_rules.T.SPACE_WORDS)
        return int(quality_rules._grams(quality_rules.T.span_hash(data, w.start, w.end), w)[0][-1])

    of = {g: bucket(g) for g in {g for i in range(1070) for g in grams(text(i))}}
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i, x in items:
        for g in grams(x):
            raw[of[g]] += 1
            target[of[g]] += good(i)
    p = (raw + 1) / (raw.sum() + quality_rules.BUCKETS)
    ratio = np.log((target + quality_rules.BUCKETS * p) / (target.sum() + quality_rules.BUCKETS) / p)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, trusted, -0.001).where("doc_id < 2000").collect()}
    kept = set()
    for i, r in got.items():
        score = np.mean([ratio[of[g]] for g in grams(text(i))])
        assert math.isclose(r["score"], score, rel_tol=1e-9, abs_tol=1e-12)
        assert r["kept"] == (i < 70 and score >= -0.001)
        kept.add(r["kept"])
    assert len(got) == 2000 and kept == {True, False}


# 9: lines


def test_line_dedup(spark, edges, empty):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    other = " ".join(f"word{c}{c}" for c in "abcdefghijklmnopqrst")
    items = [(1, f"{long}\n{other}"), (2, f"intro stays here always now\n{long.upper()}!"), (3, f"{long}s\nshort line"), (4, f"short line\n{other.replace('wordcc', 'wordcx')}"), (5, None), (6, "")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(items, "doc_id bigint, text string")).collect()}
    assert got[1]["text"] == items[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"] == "intro stays here always now"
    assert got[5]["text"] is None and got[6]["text"] == ""
    assert "short line" in got[3]["text"] and "short line" in got[4]["text"]
    out = line_dedup.dedup_lines(edges)
    assert out.columns[:2] == ["doc_id", "text"] and out.count() == len(EDGES)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    """A repeat in one row takes nothing from another row of the same, or of no, doc_id."""
    first, second, third = ("one two three four five six", "red green blue black white grey", "north south east west up down")
    items = [(None, f"{second}\n{first}"), (None, f"{second}\n{third}"), (1, first), (1, f"alone {third} too"), (2, f"{second}\n{third}"), (2, f"{third} again here\n{first}"), (2, f"{second}\n{third}")]
    out = line_dedup.dedup_lines(spark.createDataFrame(items, "doc_id bigint, text string")).collect()
    want = [(None, items[0][1], 0), (None, items[1][1], 0), (1, "", 1), (1, items[3][1], 0), (2, "", 2), (2, f"{third} again here", 1), (2, "", 2)]
    assert collections.Counter(map(tuple, out)) == collections.Counter(want)


def test_line_links_match_brute_force(spark, rows):
    """Groups over all lines: every pair within the SimHash distance, confirmed by edit similarity."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([x for _, x in rows])], ["doc_id", "text"])
    nodes = {}
    for b in line_dedup._sign(line_dedup.MIN_WORDS)(iter([batch])):
        for i, k, node, sim, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
            at, _, _ = nodes.get(node, ((i, k), sim, n))
            nodes[node] = (min(at, (i, k)), sim, n)
    texts = dict(rows)

    def norm(at):
        line = texts[at[0]].split("\n")[at[1]].encode().translate(LOWER)
        return b" ".join(ALNUM.findall(re.sub(rb"[0-9]", b"0", line))).decode()

    keys = sorted(nodes, key=lambda k: nodes[k][0])
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sims = np.array([nodes[k][1] for k in keys]).view(np.uint64)
    for p, k in enumerate(keys):
        near = np.flatnonzero(np.bitwise_count(sims[p + 1 :] ^ sims[p]) <= line_dedup.DISTANCE) + p + 1
        for q in near.tolist():
            x, y = norm(nodes[k][0]), norm(nodes[keys[q]][0])
            most = int((1 - line_dedup.SIMILARITY) * max(len(x), len(y)) + 1e-9)
            if line_dedup.edit_distance(x, y, most) <= most:
                a, b = sorted((find(k), find(keys[q])), key=lambda z: nodes[z][0])
                parent[b] = a
    kept = {nodes[find(k)][0] for k in keys}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.line_groups(df).where("first").collect()}
    assert got == kept


def test_lines_of_scripts_without_spaces(spark):
    """Copies and near copies of Chinese, Japanese and Thai lines go; lines of under five letters stay."""
    zh, ja, th = "今天天气很好我们一起去公园散步吧然后回家吃晚饭再看一会儿书", "昨日は友達と一緒に映画を見に行きました、とても楽しかったです", "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะกันเถอะ"
    near, mixed = zh.replace("公园", "花园"), "使用 abc 方法 x"
    items = [(1, f"{zh}\n{ja}\n{th}\n很好"), (2, f"{ja}\n{near}\n{th}\n很好"), (3, f"{mixed}\n{zh[::-1]}"), (4, f"{mixed}\nonly three words")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(items, "doc_id bigint, text string")).collect()}
    assert got == {1: items[0][1], 2: "很好", 3: items[2][1], 4: "only three words"}
    norm = np.frombuffer("ab你好c é 日x".encode(), np.uint8)
    w = line_dedup.T.words(norm, np.array([0, len(norm)]), line_dedup.T.ALNUM_WORDS)
    start, end, unit = line_dedup._units(norm, w, np.array([0]), np.array([0, len(w.start)]))
    assert [norm[i:j].tobytes().decode() for i, j in zip(start, end, strict=True)] == ["ab", "你", "好", "c", "é", "日", "x"] and unit.tolist() == [0, 7]


@pytest.mark.parametrize("size", [6, 10, 20, 30, 60])
def test_lines_with_one_changed_word_meet(size):
    """At least 95 of 100 lines share a key with their variant, and no variant is ruled out by counted letters."""
    import pyarrow as pa

    rng = random.Random(size)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(k))
    lines = [[word(rng.randrange(3, 10)) for _ in range(size)] for _ in range(400)]
    pairs = []
    for x in lines:
        i = rng.randrange(size)
        k = int(0.1 * len(" ".join(x)) + 1e-9)
        y = [*x[:i], word(min(k, len(x[i]))) + x[i][min(k, len(x[i])) :], *x[i + 1 :]]
        assert line_dedup.edit_distance(" ".join(x), " ".join(y), k) <= k
        pairs += [" ".join(x), " ".join(y)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(pairs)], ["doc_id", "text"])
    b = pa.Table.from_batches(list(line_dedup._sign(line_dedup.MIN_WORDS, True)(iter([batch]))))
    mins, sim = np.array(b["mins"].to_pylist()), b["sim"].to_pylist()
    assert (mins[::2] == mins[1::2]).any(axis=1).mean() >= 0.95
    for p in range(0, 800, 2):
        d = [(sim[p] >> 4 * j & 15) - (sim[p + 1] >> 4 * j & 15) for j in range(16)]
        assert sum(min(v & 15, -v & 15) for v in d) <= 2 * int(0.1 * max(len(pairs[p]), len(pairs[p + 1])) + 1e-9)


def test_line_links_of_one_round_match_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "ROUNDS", 1)
    test_line_links_match_brute_force(spark, rows)


def test_large_bucket_links_nodes_of_more_and_fewer_keys(spark):
    """Nodes 1 and 2 meet in one key only, at different places of their lists; node 3 is the centre."""
    keys = {1: [10, 11, 20, 21, 30, 31, 40, 41], 2: [12, 22, 31, 42], 3: [31, 50], 4: [50]}
    nodes = spark.createDataFrame([(k, k > 2, v) for k, v in keys.items()], "node bigint, kind boolean, keys array<bigint>")
    buckets = nodes.select(F.explode("keys").alias("key"), "node").where("key in (31, 50)")
    comp = bucket_components(buckets, nodes, lambda x, y: x("kind") == y("kind"), lambda pairs: pairs.toDF("u", "v"), 1)
    assert {r["node"]: r["component"] for r in comp.collect()} == {2: 1, 4: 3}


def test_ring_codes_differ_as_counts_do():
    for a in range(16):
        for b in range(16):
            assert int(line_dedup._RING[a] ^ line_dedup._RING[b]).bit_count() == min((a - b) % 16, (b - a) % 16)


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(0)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in "ab")
        most = rng.randrange(13)
        assert line_dedup.edit_distance(a, b, most) == min(plain(a, b), most + 1)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz 0", "漢字仮名交文書日本語😀é a"])
def test_distances_of_many_pairs(letters):
    rng = random.Random(5)
    a, b = [], []
    for _ in range(600):
        x = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 128, 129, 300, 1100]))]
        y = list(x)
        for _ in range(rng.randrange(len(x) // 6 + 3)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        a.append("".join(x))
        b.append("".join(y))
    found = distances(a, b)
    told = [(x, y, d) for x, y, d in zip(a, b, found.tolist(), strict=True) if d >= 0]
    assert len(told) > 400
    assert all(line_dedup.edit_distance(x, y, len(x) + len(y)) == d for x, y, d in told)
    most = [int((1 - line_dedup.SIMILARITY) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
    assert line_dedup.within(a, b).tolist() == [line_dedup.edit_distance(x, y, k) <= k for x, y, k in zip(a, b, most, strict=True)]
    assert line_dedup.within([], []).tolist() == [] and line_dedup.within(["a"], [""]).tolist() == [False]


def test_members_of_a_bucket_meet_in_blocks(spark, monkeypatch):
    """Lines around one passage, all in one bucket: every link is found, across blocks and bands too, and pairs are no rows."""
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    starts = [" ".join(word() for _ in range(rng.choice([3, 8, 9, 10]))) for _ in range(20)]
    lines = [f"{x[: -1 - k]} {passage}" for x in starts for k in range(4)]
    rings = line_dedup._rings([x.encode() for x in lines])
    keys = [[7] * line_dedup.BLOCKS] * len(lines)
    rows = [(i, x, *[int(r[i]) for r in rings], len(x), k) for i, (x, k) in enumerate(zip(lines, keys, strict=True))]
    found = spark.createDataFrame(rows, "node bigint, line string, r0 bigint, r1 bigint, r2 bigint, r3 bigint, n int, mins array<bigint>")
    labelled = spark.createDataFrame([(7, i, i // 2) for i in range(len(lines))], "key bigint, node bigint, comp bigint")
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if i // 2 != j // 2]
    want = {p for p, good in zip(pairs, line_dedup.within(*[[lines[p[k]] for p in pairs] for k in (0, 1)]), strict=True) if good}
    got = [tuple(sorted(r, reverse=True)) for r in line_dedup._block_links(found)(labelled).collect()]
    assert 0 < len(want) < len(pairs) and len(got) == len(set(got)) and set(got) == want


def test_distances_within_a_band():
    """Distances up to the bound are exact, those over it stay over it; what both texts have in common at their ends goes first."""
    rng = random.Random(9)
    a, b, most = [], [], []
    for _ in range(800):
        x = [rng.choice("abc é") for _ in range(rng.choice([5, 64, 129, 300, 700]))]
        y = list(x)
        for _ in range(rng.randrange(len(x) // 5 + 2)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", rng.choice("abc é")])
        a.append("".join(x))
        b.append("".join(y))
        most.append(rng.randrange(len(x) // 4 + 2))
    told = [(x, y, k, d) for x, y, k, d in zip(a, b, most, distances(a, b, np.array(most)).tolist(), strict=True) if d >= 0]
    assert len(told) > 700 and all(min(d, k + 1) == line_dedup.edit_distance(x, y, k) for x, y, k, d in told)
    long = "x" * 3000  # beyond WIDE words, but for the ends
    assert distances([f"{long}a"] * 20, [f"{long}bc"] * 20).tolist() == [2] * 20


def test_distances_of_rare_lengths():
    """Pairs of any length are told together where few edits are allowed; each of these lengths occurs once."""
    rng = random.Random(11)
    a = ["".join(rng.choice("abcdefgh é") for _ in range(k)) for k in range(100, 1500, 35)]
    b = []
    for x in a:
        y = list(x)
        for at in rng.sample(range(len(x)), 5):
            y[at] = rng.choice(["", "z", f"{y[at]}y"])
        b.append("".join(y))
    found = distances(a, b, np.full(len(a), 60))
    assert found.min() >= 0 and found.tolist() == [line_dedup.edit_distance(x, y, 60) for x, y in zip(a, b, strict=True)]


def test_keys_meet_in_packed_parts(spark, monkeypatch):
    """Every key that two nodes have, with all of its nodes; meets are the sizes of a node's buckets summed up."""
    import pyarrow as pa

    monkeypatch.setattr(_buckets, "PACKED", 50)
    rng = np.random.default_rng(4)
    keys, nodes = rng.integers(-60, 60, 400) * 977, rng.integers(0, 30, 400)
    packed = pa.Table.from_batches(list(_buckets.packed_keys(iter([(keys[:0], nodes[:0]), *[(keys[i : i + 20], nodes[i : i + 20]) for i in range(0, 400, 20)]]), 7)))
    assert packed.num_rows > 7
    held = collections.defaultdict(set)
    for k, n in zip(keys.tolist(), nodes.tolist(), strict=True):
        held[k].add(n)
    sizes = collections.Counter()
    for found in held.values():
        sizes.update({n: len(found) for n in found if len(found) > 1})
    want = sorted((k, n, sizes[n]) for k, found in held.items() if len(found) > 1 for n in found)
    assert sorted(map(tuple, _buckets.met_buckets(spark.createDataFrame(packed)).collect())) == want and len(want) < 400
    none = spark.createDataFrame([], "part int, keys binary, nodes binary")
    assert _buckets.met_buckets(none).count() == 0


def test_texts_of_chosen_lines(rows):
    """Normalised lines are cut out in one go, and their counted letters with them."""
    import pyarrow as pa

    texts = [x or "" for _, x in rows] + ["", "\n\n", "  a,b;c d  é!\n!!1 2 33 d e f??\n", "今天天气很好我们 x\n\na b c d e f é"]
    for _, _, data, offsets in line_dedup.T.blocks(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])):
        x = line_dedup._Judged(data, offsets, line_dedup.MIN_WORDS)
        for chosen in (np.arange(len(x.node)), np.arange(0, len(x.node), 3), np.arange(0)):
            want = x.texts(chosen)
            got, rings = x.lines(chosen)
            assert [t.encode() for t in got.to_pylist()] == want and np.array_equal(rings, line_dedup._rings(want))


# 10: decontamination


def _contamination(docs, items, window=10):
    found = collections.defaultdict(set)
    for i, x in items:
        w = words(x, ALNUM)
        k = min(window, len(w))
        for s in range(len(w) - k + 1) if k else ():
            found[tuple(w[s : s + k])].add(str(i))
    for i, x in docs:
        w, hit, ids = words(x, ALNUM), set(), set()
        for k in {len(f) for f in found}:
            for s in range(len(w) - k + 1):
                if f := found.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    ids |= f
        yield i, len(w), len(hit), tuple(sorted(ids))


@pytest.mark.parametrize("slice_bytes", [decontaminate.SLICE_BYTES, 700])
def test_decontamination(spark, rows, edges, empty, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", slice_bytes)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(900, "one two"), (901, "fine"), (902, ""), (903, None), (904, "b a b a")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    planted = [*rows, (10**6, "One, TWO. one two a b a b a b"), (10**6 + 1, f"x {items[0][1]} {items[1][1]} y {items[0][1]}")]
    df = spark.createDataFrame(planted, "doc_id bigint, text string")
    got = decontaminate.contamination(df, bench).collect()
    assert {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got} == set(_contamination(planted, items))
    left = {r["doc_id"]: r["text"] for r in decontaminate.remove_contaminated(df, bench).collect()}
    assert 10**6 not in left or "one two" not in left[10**6].lower()
    assert words(left[10**6 + 1], ALNUM)[0] == b"x"
    assert decontaminate.contamination(edges, bench).count() == len(EDGES)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(df, bench.limit(0)).collect()} == {0}
    assert set(decontaminate.remove_contaminated(edges, bench).columns) == set(edges.columns)


def test_fm_index():
    rng = np.random.default_rng(2)
    for _ in range(20):
        text = rng.integers(1, 6, 200)
        index = decontaminate.FMIndex(text, 6)
        for k in (1, 2, 4):
            phrases = rng.integers(1, 6, (30, k))
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi, strict=True):
                want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# Long texts


def test_texts_of_megabytes(spark):
    """One text of two megabytes and one of one long word among short ones, through every operator."""
    rng = random.Random(6)
    words_ = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    long = "\n".join(" ".join(rng.choice(words_) for _ in range(40)) for _ in range(8000))
    items = [(1, long, "en"), (2, "z" * 1_000_000, "en"), (3, f"{long} end", "de"), (4, "a short text of some words here", "de"), (5, None, None)]
    docs = spark.createDataFrame(items, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    left = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert left[1]["n_removed"] == 0 and left[3]["n_removed"] == 8000 and left[2]["text"] == items[1][1]
    assert {r["doc_id"]: r["n_bytes"] for r in token_counts.token_counts(docs, vocabulary("word_bpe_49k.json")).collect()}[1] == len(long)
    coded = byte_bpe.encode_texts(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN, digest=True).where("doc_id <= 2")
    assert {r["doc_id"]: r["decoded"] for r in coded.collect()} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x, _ in items[:2]}
    net = language_id.fit(docs, F.lit(True))
    assert language_id.identify(docs, net, F.col("doc_id")).count() == 5
    assert all(r["score"] < 0 for r in context_tree.code_lengths(docs, F.lit(True)).collect())
    assert pii.personal_data(docs).count() == 5
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, label int")
    assert pairwise_quality.score(docs, pairwise_quality.fit(docs, labels)).count() == 5
    assert quality_rules.quality_rules(docs, docs.where("doc_id = 1")).count() == 5
    bench = spark.createDataFrame([(1, " ".join(long.split()[5000:5020]))], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontaminate.contamination(docs, bench).where("n_hit > 0").collect()} == {1, 3}


def test_context_tree_chunks_keep_subtrees_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(context_tree, "CHUNK", 10)
    root = np.repeat(np.arange(9), [3, 1, 14, 2, 2, 2, 2, 2, 5])
    rows = pa.table({"root": root, "gram": np.arange(len(root)), "n": np.ones(len(root), np.int64)})
    parts = list(context_tree._chunks(iter(rows.to_batches(max_chunksize=4))))
    assert np.concatenate([g for g, _ in parts]).tolist() == list(range(len(root)))
    assert all(set(root[p]) & set(root[q]) == set() for i, (p, _) in enumerate(parts) for q, _ in parts[:i])
