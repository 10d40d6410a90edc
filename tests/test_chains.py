"""Chains: verification in ranges, null payloads, and appending as a stream."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexigate.plans import audit
from lexigate.streaming import chains

V2 = "chain string, seq bigint, payload string, previous_hash string, event_hash string"
V1 = "chain string, seq bigint, payload string, previous_hash string, entry_hash string"


def stored(chain, n: int, first: bool = False) -> list[tuple]:
    """A chain as written, every seventh payload null; of the first format where asked."""
    last, out = audit.SEED if first else audit.ZERO, []
    for i in range(n):
        payload = None if i % 7 == 3 else f"p{i}"
        own = hashlib.sha256((last + (payload or "")).encode()).hexdigest() if first else chains.link(i, last, payload)
        out.append((chain, i, payload, last, own))
        last = own
    return out


def by_hand(rows: list[tuple]) -> list[tuple]:
    out = []
    before: dict = {}
    for chain, seq, payload, previous, own in sorted(rows, key=lambda r: (r[0] or "", r[1], r[4] or "")):
        last = before.get(chain)
        short = len(own or "") != 64 or len(previous or "") != 64
        out += [(chain, seq, "LENGTH")] * short
        if not short and chains.link(seq, previous, payload) != own:
            out.append((chain, seq, "EVENT_HASH"))
        if last is None:
            out += [(chain, seq, "GENESIS")] * (previous is not None and previous != audit.ZERO)
        else:
            out += [(chain, seq, "LINK")] * (previous is not None and last[1] is not None and previous != last[1])
            out += [(chain, seq, "GAP")] * (seq > last[0] + 1) + [(chain, seq, "DUPLICATE")] * (seq == last[0])
        before[chain] = (seq, own)
    return sorted(out, key=repr)


def tampered(rows: list[tuple]) -> list[tuple]:
    """Lost stretches, one longer than several ranges, changed and nulled payloads, broken links, short and null hashes, repeated entries."""
    random.seed(5)
    out = []
    for chain, seq, payload, previous, own in rows:
        x = random.random()
        if 300 <= seq < 340 or x < 0.02:
            continue
        if x < 0.06:
            payload = random.choice([None, "changed", ""])
        elif x < 0.1:
            previous = random.choice(["f" * 64, "ab", None])
        elif x < 0.12:
            own = random.choice(["f" * 64, "ab", None])
        out += [(chain, seq, payload, previous, own)] * (2 if x > 0.98 else 1)
    return out


@pytest.mark.parametrize("width", [4096, 8, 1])
def test_findings_do_not_depend_on_ranges(spark, monkeypatch, width):
    monkeypatch.setattr(audit, "RANGE", width)
    rows = tampered(stored("a", 900) + stored("b", 5) + stored(None, 40) + stored("c", 1))
    got = sorted((tuple(r) for r in audit.verify(spark.createDataFrame(rows, V2)).collect()), key=repr)
    assert got == by_hand(rows) and {x[2] for x in got} >= {"LENGTH", "EVENT_HASH", "LINK", "GAP", "DUPLICATE"}
    assert audit.verify(spark.createDataFrame(stored("a", 900), V2)).count() == 0
    assert audit.verify(spark.createDataFrame([], V2)).count() == 0


def test_one_chain_is_verified_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE", 512)
    rows = spark.createDataFrame(stored("a", 20_000), V2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        tasks = audit._preceded(rows, ["event_hash", "seq"], ["seq", "event_hash"]).select(F.spark_partition_id().alias("task"))
        counts = [r["count"] for r in tasks.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) == 4 and max(counts) < 9000
    assert audit.verify(rows).count() == 0


@pytest.mark.parametrize("width", [4096, 3])
def test_first_format(spark, monkeypatch, width):
    monkeypatch.setattr(audit, "RANGE", width)
    rows = {c: stored(c, 20, True) for c in "abcd"}
    rows["b"][9] = (*rows["b"][9][:2], None, *rows["b"][9][3:])
    rows["c"][4] = (*rows["c"][4][:3], "f" * 64, rows["c"][4][4])
    rows["d"][2] = (*rows["d"][2][:2], "p", *rows["d"][2][3:])
    got = sorted(map(tuple, audit.verify_v1(spark.createDataFrame([x for v in rows.values() for x in v], V1)).collect()))
    assert got == [("a", 20, True, None, None), ("b", 20, False, 9, "CONTENT"), ("c", 20, False, 4, "LINK"), ("d", 20, False, 2, "CONTENT")]


def test_stream_appends_in_order_of_time(spark, tmp_path):
    """Events out of order within the delay, repeated in one run and in a later one, too late ones, and a chain that falls silent."""
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    random.seed(9)
    one = [(c, at(i * 7 + c), 100 * c + i, None if i % 5 == 2 else f"p{i}") for c in (1, 2) for i in range(40)]
    runs = [random.sample(one[:20] + one[40:60], 40) + one[3:5], random.sample(one[20:40], 20) + [one[4], (1, at(1), 999, "too late")], [(1, at(2000), 500, "later"), (1, at(2500), 501, "last")]]
    folder = str(tmp_path)
    for rows in runs:
        spark.createDataFrame(rows, "chain bigint, ts timestamp, event_id bigint, payload string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("chain bigint, ts timestamp, event_id bigint, payload string").parquet(f"{folder}/in")
        before = spark.conf.get(chains._PROVIDER, None)
        chains.run_append(spark, chains.append_chains(stream), f"{folder}/out", f"{folder}/state")
        assert spark.conf.get(chains._PROVIDER, None) == before
    found = spark.read.schema(chains._OUT).parquet(f"{folder}/out").collect()
    want = []
    for c in (1, 2):
        last = audit.ZERO
        rows = [r for r in one if r[0] == c][: 40 if c == 1 else 20] + ([(1, at(2000), 500, "later")] if c == 1 else [])
        for i, (_, _, event, payload) in enumerate(sorted(rows, key=lambda r: (r[1], r[2]))):
            own = chains.link(i, last, payload)
            want.append((c, i, event, last, own))
            last = own
    assert sorted(tuple(r)[:5] for r in found if r["status"] == chains.APPENDED) == want
    assert sorted((r["chain"], r["seq"], r["event_id"]) for r in found if r["status"] == chains.SILENT) == [(1, 40, 139), (1, 41, 500), (2, 20, 219)]


def test_events_that_come_together_wait_as_one_entry():
    """State entries do not grow with the events of a batch, and what waits is linked in order of time."""
    import pandas as pd

    class State(list):
        def exists(self):
            return bool(self)

        def get(self):
            return iter(self)

        def put(self, rows):
            self[:] = rows

        def appendList(self, rows):
            self.extend(rows)

        appendValue = list.append

    class Head:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    class Handle:
        getValueState, getListState, registerTimer = (lambda *_: Head()), (lambda *_: State()), (lambda *_: None)

    class Times:
        def __init__(self, mark):
            self.mark = mark

        def getCurrentWatermarkInMs(self):
            return self.mark

    x = chains.Appender()
    x.init(Handle())
    n = 500
    batch = lambda a: pd.DataFrame({"ts": pd.to_datetime([1000 * (n - i) + a for i in range(n)], unit="ms"), "event_id": range(n), "payload": [None if i % 7 == 0 else f'"{i}é\n' for i in range(n)]})
    for a in (0, 500):
        assert list(x.handleInputRows((1,), iter([batch(a)]), None)) == []
    assert len(x.waiting) == 2
    head, seen = chains.ZERO, 0
    rows = sorted((int(t.value), i, p) for a in (0, 500) for t, i, p in batch(a).itertuples(index=False, name=None))
    for mark in (100_000, 10_000_000):
        for r in pd.concat(x.handleExpiredTimer((1,), Times(mark), None)).itertuples(index=False):
            if r.status == chains.APPENDED:
                assert (r.seq, r.event_id, r.previous_hash) == (seen, rows[seen][1], head)
                head, seen = chains.link(seen, head, rows[seen][2]), seen + 1
                assert r.event_hash == head
        assert len(x.waiting) <= 1
    assert seen == 2 * n and not x.waiting
