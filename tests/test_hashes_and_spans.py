"""Canonical JSON against the json module; overlaps and islands of spans against all pairs."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lexigate.functions import canonical
from lexigate.operators import hashes, spans

JSON = ['{"b":1,"a":{"z":1.50,"y":[3,{"d":1,"c":2}]},"é":"ü\\n\\u0001/\\"\\\\"}', '{"B":1,"a":2,"A":3,"_":4,"😀":1,"￮":2}', "[1e3,1E-7,100000000000000000000000,0.1,-0.0,1.0,null,true]", '{"a":1,"a":2}', '"x"', " [ ] ", "{}"]
BAD = {"NaN": canonical.NOT_FINITE, '{"a":[-Infinity]}': canonical.NOT_FINITE, "[1e400]": canonical.NOT_FINITE, "": canonical.NOT_JSON, '{"a":1} x': canonical.NOT_JSON, "{'a':1}": canonical.NOT_JSON, "[" * 100_000: canonical.NOT_JSON}


@pytest.mark.parametrize("ascii", [False, True])
def test_canonical_form(spark, ascii):
    df = spark.createDataFrame([(x,) for x in [*JSON, *BAD, None]], "x string")
    got = {r["x"]: (r["c"]["json"], r["c"]["reason"]) for r in df.select("x", canonical.canonical(F.col("x"), ascii).alias("c")).collect()}
    assert all(got[x] == (json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii), None) for x in JSON)
    assert all(got[x] == (None, why) for x, why in BAD.items()) and got[None] == (None, None)


def _shuffled(value, rng):
    if isinstance(value, dict):
        items = [(k, _shuffled(v, rng)) for k, v in value.items()]
        rng.shuffle(items)
        return dict(items)
    return [_shuffled(v, rng) for v in value] if isinstance(value, list) else value


def test_order_of_keys_and_spaces_do_not_matter(spark):
    rng = random.Random(3)
    rows = [(i, json.dumps(_shuffled({"k": {"b": [1, {"z": i, "y": "é"}], "a": None}, "props": {str(j): j for j in range(9)}}, rng), indent=rng.choice([None, 1]))) for i in range(5) for _ in range(6)]
    out = hashes.hashed(spark.createDataFrame(rows, "i int, payload string"), "payload")
    assert [r["n"] for r in out.groupBy("i").agg(F.countDistinct("payload_hash").alias("n")).collect()] == [1] * 5
    assert hashes.hashed(spark.createDataFrame([("NaN",), (None,)], "payload string"), "payload").where("payload_hash is null").count() == 2


def test_output_hash(spark):
    segments = [(1, 1, "b", "zwei\t\x01"), (1, 0, "a", "eins"), (1, 1, "a", None), (1, None, None, "é"), (2, 5, "x", ""), (None, 0, "n", "null job")]
    jobs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "job_id bigint")
    got = {r["job_id"]: (r["n_segments"], r["output_hash"]) for r in hashes.output_hashes(jobs, spark.createDataFrame(segments, "job_id bigint, position bigint, segment_id string, text string")).collect()}
    for job in (1, 2, 3, None):
        own = sorted(((o is not None, o or 0, i or "", t or "") for j, o, i, t in segments if j == job))
        text = json.dumps([{"order": o if has else None, "id": i, "text": t} for has, o, i, t in own], sort_keys=True, ensure_ascii=False)
        assert got[job] == (len(own), hashlib.sha256(text.encode()).hexdigest())
    assert len(got) == 4 and hashes.output_hashes(jobs.limit(0), spark.createDataFrame([], "job_id bigint, position bigint, segment_id string, text string")).count() == 0


SPAN = "segment string, start bigint, `end` bigint, judge string, severity string"


def _spans(n: int, seed: int) -> list[tuple]:
    """Short and very long spans, most in one segment, empty and turned ones, ties, repeated rows, null segments, negative places."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(-500, 3000)
        out.append((rng.choice(["hot"] * 6 + ["b", "c", None]), a, a + rng.choice([0, -3, 1, 1, 2, 7, 40, 300, 5000] if rng.random() < 0.3 else [1, 2, 3, 5, 8]), rng.choice("xyz"), rng.choice([*spans.SEVERITIES, "odd", None])))
    return out + out[:5]


def test_overlaps_are_all_pairs(spark):
    a, b = _spans(300, 1), _spans(200, 2)
    left, right = (spark.createDataFrame([(*r, i) for i, r in enumerate(x)], f"{SPAN}, id int") for x in (a, b))
    got = sorted(tuple(r) for r in spans.overlaps(left, right).select("segment", "l.id", "r.id").collect())
    want = sorted((x[0], i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] is not None and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    assert got == want and want
    assert spans.overlaps(left.limit(0), right).count() == 0


def test_a_long_span_gives_few_rows(spark):
    """A span over everything is not cut into bins of the width of the others."""
    one = spark.createDataFrame([("a", 0, 10**12)], "segment string, start bigint, `end` bigint")
    many = spark.range(1000).selectExpr("'a' as segment", "id * 1000 as start", "id * 1000 + 3 as end")
    assert spans._bins(one, spans._level(F.col("end") - F.col("start"))).count() <= 2
    assert spans.overlaps(one, many).count() == 1000 == spans.overlaps(many, one).count()


@pytest.mark.parametrize("width", [1 << 16, 64, 1])
def test_islands_are_components_of_overlaps(spark, width):
    rows = _spans(120, 4)
    got = {r["id"]: r["island"] for r in spans.islands(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{SPAN}, id int"), width).collect()}
    assert len(got) == len(rows)
    low = {i: i for i, r in enumerate(rows) if r[0] is not None and r[1] < r[2]}
    changed = True
    while changed:  # spread the least start of all that overlap
        changed = False
        for i in low:
            for j in low:
                x, y = rows[i], rows[j]
                if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and rows[low[j]][1] < rows[low[i]][1]:
                    low[i], changed = low[j], True
    assert got == {i: rows[low[i]][1] if i in low else None for i in range(len(rows))}


def test_merged_takes_the_worst_and_tells_disagreement(spark):
    rows = [("a", 0, 5, "x", "MINOR"), ("a", 4, 6, "y", "CRITICAL"), ("a", 3, 5, "z", "odd"), ("a", 10, 12, "x", "MAJOR"), ("a", 11, 12, "y", "MAJOR"), ("a", 10, 11, "z", "MAJOR"), ("b", 0, 1, "x", None), ("b", 5, 5, "x", "MAJOR")]
    got = sorted(map(tuple, spans.merged(spark.createDataFrame(rows, SPAN)).collect()))
    assert got == [("a", 0, 3, 3, "CRITICAL", True), ("a", 10, 3, 3, "MAJOR", False), ("b", 0, 1, 1, "NEUTRAL", True)]
