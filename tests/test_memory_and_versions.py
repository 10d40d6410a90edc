"""Fuzzy memory, constraint packs, nearest vectors and versions against plain loops."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest

from lexigate.operators import documents, memory, packs, versions

SEGMENT = "owner bigint, seg bigint, text string"


def _segments(n: int, seed: int) -> list[tuple]:
    """Lines over few words, so that many are equal or similar; null, empty and wordless ones, repeated rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Ünï", "日本"]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    out = []
    for i in range(n):
        line = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            line[rng.randrange(len(line))] = rng.choice([*words, f"x{rng.randrange(40)}"])
        rng.shuffle(line)
        out.append((rng.randrange(9), i, rng.choice([" ".join(line), ", ".join(line).upper(), " ".join(line), None if i % 50 == 7 else "" if i % 50 == 8 else "...!" if i % 50 == 9 else " ".join(line)])))
    return out + out[:4]


@pytest.mark.parametrize("threshold", [85, 60, 100])
def test_best_match_of_every_segment(spark, threshold):
    stored, asked = _segments(160, 1), _segments(160, 1)[:80] + [(100 + i, i, t) for i, (_, _, t) in enumerate(_segments(90, 2))]
    sets = lambda rows: [(o, s, frozenset(re.findall(r"\w+", (t or "").lower()))) for o, s, t in rows]
    want = []
    for o, s, a in sets(asked):
        found = [(-len(a & b) / len(a | b), p, q) for p, q, b in sets(stored) if a and b and p != o and 100 * len(a & b) >= threshold * len(a | b)]
        if found:
            sim, p, q = min((round(x, 6), p, q) for x, p, q in found)
            want.append((o, s, p, q, -sim))
    got = memory.best_matches(spark.createDataFrame(asked, SEGMENT), spark.createDataFrame(stored, SEGMENT), threshold).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert memory.best_matches(spark.createDataFrame([], SEGMENT), spark.createDataFrame(stored, SEGMENT)).count() == 0


def test_memory_writes_words_once_and_shuffles_few(spark):
    """What stays under the checkpoint folder is smaller than the documents, and only words of marked lines are read again."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = lambda: {p: p.stat().st_size for p in Path(folder).glob("lexigate-memory-*/*.parquet")}
    before = held()
    assert memory.memory_best_segments(spark, "/root/testdata/sf0.01").count() == 2804
    assert sum(n for p, n in held().items() if p not in before) < Path("/root/testdata/sf0.01/documents.parquet").stat().st_size
    rows = spark.range(20_000).selectExpr("id * 7 AS line", "'w' AS words")
    ids = spark.range(0, 20_000, 40).selectExpr("id * 7 AS x")
    got = [r["line"] for r in memory._marked(rows, "line", ids).collect()]
    assert {i * 7 for i in range(0, 20_000, 40)} <= set(got) and len(got) == len(set(got)) < 600


def test_null_owners_match_nothing(spark):
    rows = [(None, 1, "a b c d e f g"), (1, 2, "a b c d e f g"), (2, 3, "g f e d c b a"), (None, 4, "a b c d e f g h"), (3, 5, "a b c d e f g i")]
    segments = spark.createDataFrame(rows, SEGMENT)
    got = sorted(map(tuple, memory.best_matches(segments, segments).collect()))
    assert got == [(1, 2, 2, 3, 1.0), (2, 3, 1, 2, 1.0), (3, 5, 1, 2, 0.875)]


def test_parts_of_similar_sets_meet_and_others_do_not(spark):
    """Sets over few tokens: all similar pairs are found, and keys are few and mostly of one set."""
    rng = random.Random(3)
    base = [rng.sample(range(900), rng.randrange(6, 120)) for _ in range(150)]
    sets = [(f"s{i}", [f"t{x}" for x in sorted(b)]) for i, b in enumerate(base + [[*b[1:], 901, 902][: len(b)] for b in base])]
    df = spark.createDataFrame(sets, "cid string, tokens array<string>")
    want = {(x, y) for x, a in sets for y, b in sets if x != y and 100 * len(set(a) & set(b)) >= 85 * len(set(a) | set(b))}
    assert {(r["x"], r["y"]) for r in memory.similar_sets(df, df).collect()} == want and len(want) > 200
    hashed = df.selectExpr("xxhash64(cid) AS id", "3 AS role", "transform(tokens, t -> xxhash64(t)) AS hashes")
    met = hashed.mapInArrow(memory._keys(85), "key bigint, id bigint, packed bigint").groupBy("key").count().selectExpr("sum(count)", "sum(count * count)").first()
    assert met[0] <= sum(0.5 * len(t) + 4 for _, t in sets) and met[1] < 4 * met[0]


@pytest.mark.parametrize("cosine", [False, True])
def test_nearest_in_steps(spark, monkeypatch, cosine):
    """Blocks and steps of any size, equal vectors, a null one, groups, fewer vectors than asked for."""
    monkeypatch.setattr(documents, "BLOCK", 7)
    monkeypatch.setattr(documents, "STEP", 5)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(1, 4, 3)] if i != 17 else None, None if i == 3 else int(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    for by in (None, "label"):
        got = sorted(map(tuple, documents.nearest(df, df.where("vec_id % 4 = 0"), 4, cosine, by).collect()))
        want = []
        for i, x, a in rows:
            if i % 4 == 0 and x is not None and (by is None or a is not None):
                far = lambda x, y: 1 - np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) if cosine else np.sum((np.array(x) - np.array(y)) ** 2)
                near = sorted((abs(round(float(far(x, y)), 6)), j) for j, y, b in rows if j != i and y is not None and (by is None or a == b))[:4]
                want += [(i, j, d, k) for k, (d, j) in enumerate(near, 1)]
        assert [(a, b, abs(c), d) for a, b, c, d in got] == sorted(want)
    assert documents.nearest(df.limit(0), df, 2).count() == documents.nearest(df, df.limit(0), 2).count() == 0


@pytest.mark.parametrize("cosine", [False, True])
def test_nearest_of_each_in_cells(spark, monkeypatch, cosine):
    """Every vector is a query, over one cell or many; nulls are near to nothing, ties go to the least id."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(1, 5, 3)] if i != 17 else None, None if i == 3 else 7 if i == 4 else int(i % 2)) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    far = lambda x, y: 1 - np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) if cosine else np.sum((np.array(x) - np.array(y)) ** 2)
    want = []
    for i, x, a in rows:
        if x is not None and a is not None:
            near = sorted((abs(round(float(far(x, y)), 6)), j) for j, y, b in rows if j != i and y is not None and a == b)[:2]
            want += [(i, j, d, k) for k, (d, j) in enumerate(near, 1)]
    for cell in (documents.CELL, 9):
        monkeypatch.setattr(documents, "CELL", cell)
        got = documents.nearest_of_each(df, 2, "label", cosine).collect()
        assert sorted((a, b, abs(c), d) for a, b, c, d in got) == sorted(want)
    assert documents.nearest_of_each(df.limit(0), 2, "label").count() == 0


def test_top_cosine_of_every_vector(spark):
    assert documents.vec_top1_cosine(spark, "/root/testdata/sf0.001").select("q").distinct().count() == 500


def test_constraint_packs(spark):
    v = lambda *x: [float(y) for y in x]
    jobs = spark.createDataFrame([(1, 10, "g", "en-de", v(0, 0)), (2, 11, "h", "en-fr", v(0, 0)), (3, None, None, "en-de", None), (4, 10, "off", "xx", v(9, 9))], "job_id bigint, org_id bigint, glossary_id string, pair string, embedding array<double>")
    glossaries = spark.createDataFrame([("g", "v1", True), ("g", "v2", True), ("g", "v3", False), ("h", "v1", True), ("off", "v1", False)], "glossary_id string, version string, is_active boolean")
    terms = spark.createDataFrame([("g", "v1", 1, "old", "alt", False), ("g", "v2", 3, "b", "B", None), ("g", "v2", 2, "a", "A", False), ("g", "v2", 4, "bad", "", True), ("g", "v2", 5, "x", "worse", True), ("g", "v3", 6, "later", "l", False)], "glossary_id string, version string, term_id bigint, source string, target string, is_forbidden boolean")
    rules = spark.createDataFrame([(10, 2, "p2", "c", True, "ACTIVE"), (10, 1, "p1", "c", None, "ACTIVE"), (10, 3, "p3", "c", True, "PROPOSED"), (12, 4, "p4", "c", True, "ACTIVE")], "org_id bigint, rule_id bigint, pattern string, correction string, is_strict boolean, status string")
    memory_ = spark.createDataFrame([(1, "en-de", v(0.3, 0), "s1", "t1"), (2, "en-de", v(0.1, 0), "s2", "t2"), (3, "en-de", v(0, 0.2), "s3", "t3"), (4, "en-de", v(0.4, 0), "s4", "t4"), (5, "en-fr", v(0.5, 0), "s5", "t5"), (6, "en-fr", None, "s6", "t6")], "vec_id bigint, pair string, embedding array<double>, source string, target string")
    got = {r["job_id"]: r for r in packs.constraint_packs(jobs, glossaries, terms, rules, memory_).collect()}
    assert len(got) == 4
    assert [t["term_id"] for t in got[1]["glossary"]] == [2, 3] and got[1]["forbidden"] == ["bad", "worse"] and got[1]["version"] == "v2"
    assert [r["rule_id"] for r in got[1]["rules"]] == [1, 2] and [r["rule_id"] for r in got[4]["rules"]] == [1, 2]
    assert [(m["vec_id"], m["distance"]) for m in got[1]["matches"]] == [(2, 0.1), (3, 0.2), (1, 0.3)]
    assert (got[2]["version"], got[2]["glossary"], got[2]["forbidden"], got[2]["rules"], got[2]["matches"]) == ("v1", [], [], [], [])
    assert got[3]["version"] is None and got[4]["version"] is None and got[3]["matches"] == [] == got[3]["rules"]


FIELDS = ["pattern", "priority"]
CHANGE = "key bigint, version bigint, seq bigint, op string, pattern string, priority bigint"


def replay(changes: list[tuple], version: int) -> dict:
    """One change after another."""
    live: dict = {}
    for key, v, _, op, pattern, priority in sorted(set(changes), key=lambda c: c[:3]):
        if v > version:
            continue
        r = live.get(key)
        if op == "create" and (r is None or r["is_deleted"]):
            live[key] = {"pattern": pattern, "priority": priority, "active": True, "revision": 1, "is_deleted": False}
        elif op != "create" and r is not None and not r["is_deleted"]:
            r["revision"] += 1
            if pattern is not None:
                r["pattern"] = pattern
            if priority is not None:
                r["priority"] = priority
            if op == "toggle":
                r["active"] = not r["active"]
            if op == "delete":
                r["is_deleted"] = True
    return live


def test_versions_against_replay(spark):
    rng = random.Random(6)
    changes = [(rng.randrange(12), v, s, rng.choice(versions.OPS), rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3])) for v in range(1, 9) for s in range(30)]
    changes = [(*c[:4], c[4] or "p", c[5]) if c[3] == "patch" else c for c in changes]
    df = spark.createDataFrame(changes + random.Random(7).sample(changes, 100), CHANGE)
    good, dead = versions.checked(df, FIELDS)
    assert dead.count() == 0
    for version in (0, 1, 3, 8, 99):
        want = replay(changes, version)
        got = {r["key"]: {k: r[k] for k in ("pattern", "priority", "active", "revision", "is_deleted")} for r in versions.as_of(good, FIELDS, version, deleted=True).collect()}
        assert got == want
        assert {r["key"] for r in versions.as_of(good, FIELDS, version).collect()} == {k for k, r in want.items() if not r["is_deleted"]}


def test_dead_letters(spark):
    rows = [(1, 1, 1, "create", "a", 1), (1, 1, 1, "create", "a", 1), (2, 1, 1, "create", "a", 1), (2, 1, 1, "create", "b", 1), (3, 1, 1, "explode", None, None), (4, 1, 1, "patch", None, None), (None, 1, 1, "create", None, None), (5, 1, 1, None, "a", 1)]
    good, dead = versions.checked(spark.createDataFrame(rows, CHANGE), FIELDS)
    assert [r["key"] for r in good.collect()] == [1]
    assert sorted((r["key"] or 0, r["reason"]) for r in dead.collect()) == [(0, "no key or place"), (2, "conflicting content"), (2, "conflicting content"), (3, "unknown operation"), (4, "empty patch"), (5, "unknown operation")]


def test_merge_of_terms(spark):
    have, fresh = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "key string, target string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("d", "4"), ("c", None)], "key string, target string")
    assert sorted((r["key"], r["op"], r["target"]) for r in versions.merge_terms(have, fresh, 5).collect()) == [("b", "patch", "3"), ("d", "create", "4")]
    assert sorted((r["key"], r["op"]) for r in versions.merge_terms(have, fresh.limit(0), 5).collect()) == [("a", "delete"), ("b", "delete"), ("c", "delete")]


def test_long_first_lines_and_pairs_of_vectors(spark, tmp_path):
    """A first line of 600,000 letters is searched in one pass; nearest vectors come without a join of pairs."""
    from lexigate.operators import records

    rows = [(1, "An" + "x" * 600_000 + "aNan\nan"), (2, ""), (3, None), (4, "b")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, records.rule_test(spark, str(tmp_path)).collect())) == [(1, "0,600002,600004", True), (2, "", False), (4, "", False)]
    vectors = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.0], 2), (20, [0.0, 1.0], 3), (4, [-1.0, 0.0], 1)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    top3, top1 = documents.vec_top3_l2(spark, str(tmp_path)), documents.vec_top1_cosine(spark, str(tmp_path))
    assert sorted(map(tuple, top3.select("q", "vec_id", "distance", "place").collect())) == [(0, 1, 0.01, 1), (0, 2, 0.01, 2), (0, 4, 4.0, 3)]
    assert [tuple(r) for r in top1.select("q", "vec_id", "cosine", "similarity").collect()] == [(0, 1, 0.995037, 99.5037)]
    assert "Join" not in top3._jdf.queryExecution().toString()
