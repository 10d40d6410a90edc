"""Tamper-evident logs: chained hashes, their verification, daily Merkle anchors, coverage.

A chain is one user's events in order of time. Building a chain is sequential inside the
chain and parallel across chains. Verifying compares each entry with the one before it; a chain
is cut into ranges of its sequence for that, so that one long chain is verified by many tasks,
and only the last entry of each range is passed on to the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.sources.tables import table

# Fixed values of the hash formats.
SEED = "GENESIS"
TAG = "6c657869676174652d61756469742d7632000000"[:36]
LEAF, NODE = "01", "02"
ZERO = "00" * 32
#: Levels of a Merkle tree that one round folds: a row holds 2**LEVELS hashes at most.
LEVELS = 10
#: Sequence numbers of a range: what one task verifies of a chain at a time.
RANGE = 4096


def _chain_events(spark: SparkSession, d: str) -> DataFrame:
    """(chain, seq, event_id, ts, payload): events numbered from 0 in each chain."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("chain"), (F.row_number().over(w) - 1).cast("bigint").alias("seq"), "event_id", "ts", F.col("props").alias("payload"))


def _sha(raw: Column) -> Column:
    return F.unhex(F.sha2(raw, 256))


def _event_hash(seq: Column, previous: Column, payload: Column) -> Column:
    """SHA-256 of the tag, the sequence number as 8 little-endian bytes, the previous and the payload hash."""
    digits = F.lpad(F.hex(seq), 16, "0")
    little = F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])
    return F.sha2(F.unhex(F.concat(F.lit(TAG), little, previous, F.sha2(payload.cast("binary"), 256))), 256)


def _along(events: DataFrame, run, schema: str) -> DataFrame:
    """Rows of each chain in order through ``run``, which carries only the last hash from row to row.

    A chain is sequential by nature, so its rows go through one task; nothing is gathered there.
    """
    return events.repartition("chain").sortWithinPartitions("chain", "seq", "event_id").mapInPandas(run, schema)


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(chain, n, head) of each chain of a sorted partition."""
    chain, n, head = None, 0, ""
    for batch in batches:
        out = []
        for c, payload in zip(batch["chain"], batch["payload"], strict=True):
            if n and c != chain:
                out.append((chain, n, head))
            if not n or c != chain:
                chain, n, head = c, 0, SEED
            n, head = n + 1, hashlib.sha256((head + (payload or "")).encode()).hexdigest()
        yield pd.DataFrame(out, columns=["chain", "n", "head"])
    if n:
        yield pd.DataFrame([(chain, n, head)], columns=["chain", "n", "head"])


def chain_v1_build(spark: SparkSession, d: str) -> DataFrame:
    """Head of each chain: every hash is SHA-256 of the previous hash's text and the payload (null: empty)."""
    return _along(_chain_events(spark, d), _heads, "chain bigint, n bigint, head string")


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted partition with previous_hash and event_hash."""
    chain, last, tag = None, ZERO, bytes.fromhex(TAG)
    for batch in batches:
        before, own = [], []
        for c, seq, payload in zip(batch["chain"], batch["seq"], batch["payload"], strict=True):
            if c != chain:
                chain, last = c, ZERO
            before.append(last)
            last = hashlib.sha256(tag + int(seq).to_bytes(8, "little") + bytes.fromhex(last) + hashlib.sha256((payload or "").encode()).digest()).hexdigest()
            own.append(last)
        yield batch.assign(previous_hash=before, event_hash=own)


def _linked(events: DataFrame) -> DataFrame:
    """Events with previous_hash and event_hash, chain by chain."""
    kept = events.select("chain", "seq", "event_id", "payload")
    kind = kept.schema["chain"].dataType.simpleString()
    return _along(kept, _links, f"chain {kind}, seq bigint, event_id bigint, payload string, previous_hash string, event_hash string")


def chain_v2_event_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of each event on its own: zero bytes before it, its payload, its place."""
    e = _chain_events(spark, d)
    return e.select("event_id", "seq", _event_hash(F.col("seq"), F.lit(ZERO), F.col("payload")).alias("event_hash"))


def _preceded(entries: DataFrame, carried: list[str], order: list[str]) -> DataFrame:
    """Entries with before_<column> of the entry before, in order of ``order`` (seq first) inside the chain.

    Neighbours are found inside ranges of RANGE sequence numbers. A range's first entry gets the last one
    of the nearest range before it that has any: one row a range is ordered by chain for that.
    """
    x = entries.withColumn("range_", F.coalesce(F.floor(F.col("seq") / RANGE), F.lit(-(1 << 62))))
    w = Window.partitionBy("chain", "range_").orderBy(*order)
    inside = x.select("*", *[F.lag(c).over(w).alias(f"in_{c}") for c in carried], F.row_number().over(w).alias("place_"))
    ends = x.groupBy(F.col("chain").alias("chain_"), F.col("range_").alias("to_")).agg(F.max_by(F.struct(*carried), F.struct(*order)).alias("end_"))
    passed = ends.select("chain_", "to_", F.lag("end_").over(Window.partitionBy("chain_").orderBy("to_")).alias("end_"))
    both = inside.join(passed, F.col("chain").eqNullSafe(F.col("chain_")) & (F.col("range_") == F.col("to_")), "left")
    before = [F.when(F.col("place_") == 1, F.col(f"end_.{c}")).otherwise(F.col(f"in_{c}")).alias(f"before_{c}") for c in carried]
    return both.select(*entries.columns, *before)


def verify(entries: DataFrame) -> DataFrame:
    """(chain, seq, finding): every finding of every entry. Entries: chain, seq, payload, previous_hash, event_hash.

    A null payload counts as empty, as it does when a chain is built: one that was stored is no
    finding, one put in place of another payload is. Null hashes count as of wrong length; an empty
    table has no findings.
    """
    x = _preceded(entries, ["event_hash", "seq"], ["seq", "event_hash"])
    first = F.col("before_seq").isNull()
    bad_length = F.coalesce(F.length("event_hash") != 64, F.lit(True)) | F.coalesce(F.length("previous_hash") != 64, F.lit(True))
    own = _event_hash(F.col("seq"), F.col("previous_hash"), F.coalesce("payload", F.lit("")))
    wrong = F.array_compact(
        F.array(
            F.when(bad_length, "LENGTH"),
            F.when(first & (F.col("previous_hash") != ZERO), "GENESIS"),
            F.when(~bad_length & ~own.eqNullSafe(F.col("event_hash")), "EVENT_HASH"),
            F.when(~first & (F.col("previous_hash") != F.col("before_event_hash")), "LINK"),
            F.when(~first & (F.col("seq") > F.col("before_seq") + 1), "GAP"),
            F.when(~first & (F.col("seq") == F.col("before_seq")), "DUPLICATE"),
        )
    )
    return x.select("chain", "seq", F.explode(wrong).alias("finding"))


def chain_long_verify(spark: SparkSession, d: str) -> DataFrame:
    """Findings in a few long chains, one of each event type, some payloads stored as null and some set to null later."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    stored = F.when(F.col("event_id") % 83 != 0, F.col("props"))
    e = table(spark, d, "events").select(F.col("event_type").alias("chain"), (F.row_number().over(w) - 1).cast("bigint").alias("seq"), "event_id", stored.alias("payload"))
    x = _linked(e).where("event_id % 89 <> 0")
    broken = F.when(F.col("event_id") % 101 == 0, F.lit("f" * 64)).otherwise(F.col("previous_hash"))
    return verify(x.withColumn("payload", F.when(F.col("event_id") % 97 != 0, F.col("payload"))).withColumn("previous_hash", broken))


def chain_tamper_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings after planted tampering: payloads changed, entries lost, links broken."""
    x = _linked(_chain_events(spark, d))
    changed = F.when(F.col("event_id") % 97 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    broken = F.when(F.col("event_id") % 101 == 0, F.lit("f" * 64)).otherwise(F.col("previous_hash"))
    return verify(x.where("event_id % 89 <> 0").withColumn("payload", changed).withColumn("previous_hash", broken))


def chain_summary(spark: SparkSession, d: str) -> DataFrame:
    """All chains as written: how many there are and how many verify."""
    x = _linked(_chain_events(spark, d))
    bad = verify(x).select("chain").distinct().withColumn("bad", F.lit(1))
    return x.select("chain").distinct().join(bad, "chain", "left").agg(F.count("*").alias("total"), F.count_if(F.col("bad").isNull()).alias("ok"), F.every(F.col("bad").isNull()).alias("all_ok"))


def _v1_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted partition with the first format's previous_hash and entry_hash."""
    chain, last = None, SEED
    for batch in batches:
        before, own = [], []
        for c, payload in zip(batch["chain"], batch["payload"], strict=True):
            if c != chain:
                chain, last = c, SEED
            before.append(last)
            last = hashlib.sha256((last + (payload or "")).encode()).hexdigest()
            own.append(last)
        yield batch.assign(previous_hash=before, entry_hash=own)


def verify_v1(entries: DataFrame) -> DataFrame:
    """(chain, entries, valid, broken_at, reason): the first entry whose link or content is wrong, the link looked at first.

    An entry's link is the hash stored before it; a null payload counts as empty, as it does
    when a chain is built.
    """
    x = _preceded(entries, ["entry_hash"], ["seq", "entry_hash"])
    link = ~F.col("previous_hash").eqNullSafe(F.coalesce("before_entry_hash", F.lit(SEED)))
    content = ~F.sha2(F.concat("previous_hash", F.coalesce("payload", F.lit(""))).cast("binary"), 256).eqNullSafe(F.col("entry_hash"))
    x = x.withColumn("reason", F.when(link, "LINK").when(content, "CONTENT"))
    wrong = F.when(F.col("reason").isNotNull(), F.struct("seq", "reason"))
    return x.groupBy("chain").agg(F.count("*").alias("entries"), F.min(wrong).alias("w")).select("chain", "entries", F.col("w").isNull().alias("valid"), F.col("w.seq").alias("broken_at"), F.col("w.reason").alias("reason"))


def chain_v1_verify(spark: SparkSession, d: str) -> DataFrame:
    """First fault of each chain of the first format after planted changes of payloads and links."""
    kept = _chain_events(spark, d).select("chain", "seq", "event_id", "payload")
    x = _along(kept, _v1_links, "chain bigint, seq bigint, event_id bigint, payload string, previous_hash string, entry_hash string")
    changed = F.when(F.col("event_id") % 397 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    broken = F.when(F.col("event_id") % 401 == 0, F.lit("f" * 64)).otherwise(F.col("previous_hash"))
    return verify_v1(x.withColumn("payload", changed).withColumn("previous_hash", broken))


def chain_reports(spark: SparkSession, d: str) -> DataFrame:
    """Report of each tampered chain: entries, head, number of findings by kind, and its status."""
    x = _linked(_chain_events(spark, d))
    kept = x.where("event_id % 89 <> 0").withColumn("payload", F.when(F.col("event_id") % 97 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    found = verify(kept).groupBy("chain").agg(*[F.count_if(F.col("finding") == k).alias(k.lower()) for k in ("EVENT_HASH", "LINK", "GAP", "GENESIS")])
    heads = kept.groupBy("chain").agg(F.count("*").alias("entries"), F.max_by("event_hash", "seq").alias("head"))
    out = heads.join(found, "chain", "left").fillna(0, ["event_hash", "link", "gap", "genesis"])
    return out.withColumn("status", F.when(F.col("event_hash") + F.col("link") + F.col("gap") + F.col("genesis") > 0, "TAMPERED").otherwise("VERIFIED"))


def chain_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Export of every chain as lines of canonical JSON, one an entry, in order of (chain, seq)."""
    x = _linked(_chain_events(spark, d))
    line = F.to_json(F.struct("event_hash", "event_id", F.col("previous_hash").alias("previous"), "seq"))
    return x.select("chain", "seq", line.alias("line")).repartitionByRange("chain", "seq").sortWithinPartitions("chain", "seq")


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """Root of each day's hashes (day, at, leaf: hex), at any size of a day.

    An odd last node of a level is paired with itself. A day of one leaf is that leaf's
    node. Each round folds aligned runs of 2**LEVELS nodes by LEVELS levels, or by as many
    as the day still has, so a round is one shuffle and no row holds more than a run.
    """
    sizes = leaves.groupBy("day").agg(F.count("*").alias("n"))
    depth = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    node = F.sha2(F.unhex(F.concat(F.lit(LEAF), "leaf")), 256)
    level = leaves.join(sizes.select("day", depth.alias("left")), "day").select("day", F.col("at").alias("i"), node.alias("h"), "left")
    most = sizes.agg(F.max("n")).first()[0] or 0

    def halved(nodes: Column, _: Column) -> Column:
        pairs = F.transform(nodes, lambda h, i: F.concat(F.lit(NODE), h, F.coalesce(F.get(nodes, i + 1), h)))
        return F.transform(F.filter(pairs, lambda _, i: i % 2 == 0), lambda p: F.sha2(F.unhex(p), 256))

    for _ in range(-(-max(most - 1, 0).bit_length() // LEVELS)):
        runs = level.groupBy("day", F.shiftright("i", LEVELS).alias("i"), "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("run"))
        steps = F.when(F.col("left") > 0, F.sequence(F.lit(1), F.least("left", F.lit(LEVELS)))).otherwise(F.array().cast("array<int>"))
        level = runs.select("day", "i", F.element_at(F.aggregate(steps, F.col("run"), halved), 1).alias("h"), F.greatest(F.col("left") - LEVELS, F.lit(0)).alias("left"))
    return level.select("day", F.col("h").alias("root"))


def _places(events: DataFrame) -> DataFrame:
    """Events with their place in the day by (ts, event_id), from 0: places in a minute after the minutes before it."""
    minute = events.withColumn("minute", F.date_trunc("minute", "ts"))
    counts = minute.groupBy("day", "minute").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("day", "minute").orderBy("ts", "event_id")) - 1
    return minute.withColumn("inside", inside).join(counts.select("day", "minute", before.alias("before")), ["day", "minute"]).withColumn("at", (F.col("before") + F.col("inside")).cast("bigint"))


def daily_anchor(spark: SparkSession, d: str) -> DataFrame:
    """UTC day, number of events, first and last event, and the Merkle root over their hashes."""
    e = chain_v2_event_hash(spark, d).join(table(spark, d, "events").select("event_id", "ts"), "event_id").withColumn("day", F.to_date("ts"))
    roots = merkle_roots(_places(e).select("day", "at", F.col("event_hash").alias("leaf")))
    days = e.groupBy("day").agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
    return days.join(roots, "day")


def anchor_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest of each day as canonical JSON: keys in order, no spaces. The leaves are rows of their own, not a list in it."""
    a = daily_anchor(spark, d)
    body = F.struct(F.lit("sha256-merkle-v1").alias("algorithm"), F.date_format("day", "yyyy-MM-dd").alias("anchor_date"), F.col("n").alias("event_count"), F.col("first_event").alias("first_event_id"), F.col("last_event").alias("last_event_id"), F.col("root").alias("merkle_root"))
    return a.select("day", F.to_json(body).alias("manifest"))


def coverage_diff(spark: SparkSession, d: str) -> DataFrame:
    """Events that one log has beyond the other, per user and type: a multiset difference both ways."""
    e = table(spark, d, "events")
    old, new = e.where("event_id % 7 <> 0"), e.where("event_id % 11 <> 0")
    count = lambda x, n: x.groupBy("user_id", "event_type").agg(F.count("*").alias(n))
    both = count(old, "a").join(count(new, "b"), ["user_id", "event_type"], "full_outer").fillna(0, ["a", "b"])
    return both.where("a <> b").select("user_id", "event_type", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("missing"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("extra"))


QUERIES = {f.__name__: f for f in (chain_v1_build, chain_v2_event_hash, chain_tamper_findings, chain_long_verify, chain_summary, daily_anchor, anchor_manifest, chain_v1_verify, chain_reports, chain_bundle, coverage_diff)}
_EV = "e AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id, ts, props AS payload FROM events)"
_LITTLE = "substr(x, 15, 2) || substr(x, 13, 2) || substr(x, 11, 2) || substr(x, 9, 2) || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)"
_hash = lambda seq, before, payload: f"sha256(unhex('{TAG}' || {_LITTLE.replace('x,', f"printf('%016x', {seq}),")} || {before} || sha256({payload})))"
_CHAIN = f"""{_EV}, l AS (
        SELECT chain, seq, event_id, payload, '{ZERO}' AS previous_hash, {_hash("seq", f"'{ZERO}'", "payload")} AS event_hash FROM e WHERE seq = 0
        UNION ALL SELECT e.chain, e.seq, e.event_id, e.payload, l.event_hash, {_hash("e.seq", "l.event_hash", "e.payload")} FROM l JOIN e ON e.chain = l.chain AND e.seq = l.seq + 1
    )"""
#: The findings of a table t of entries.
_FOUND = f"""
    w AS (SELECT *, lag(event_hash) OVER v AS before_hash, lag(seq) OVER v AS before_seq FROM t WINDOW v AS (PARTITION BY chain ORDER BY seq, event_hash)),
    f AS (
        SELECT chain, seq, 'LENGTH' AS finding FROM w WHERE coalesce(length(event_hash), 0) <> 64 OR coalesce(length(previous_hash), 0) <> 64
        UNION ALL SELECT chain, seq, 'GENESIS' FROM w WHERE before_seq IS NULL AND previous_hash <> '{ZERO}'
        UNION ALL SELECT chain, seq, 'EVENT_HASH' FROM w WHERE length(event_hash) = 64 AND length(previous_hash) = 64 AND {_hash("seq", "previous_hash", "coalesce(payload, '')")} <> event_hash
        UNION ALL SELECT chain, seq, 'LINK' FROM w WHERE before_seq IS NOT NULL AND previous_hash <> before_hash
        UNION ALL SELECT chain, seq, 'GAP' FROM w WHERE seq > before_seq + 1
        UNION ALL SELECT chain, seq, 'DUPLICATE' FROM w WHERE seq = before_seq
    )"""
_LONG = _CHAIN.replace(_EV, "e AS (SELECT event_type AS chain, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq, event_id, CASE WHEN event_id % 83 <> 0 THEN props END AS payload FROM events)").replace("sha256(payload)", "sha256(coalesce(payload, ''))").replace("sha256(e.payload)", "sha256(coalesce(e.payload, ''))")
_TAMPERED = "SELECT chain, seq, CASE WHEN event_id % 97 = 0 THEN payload || ' ' ELSE payload END AS payload, CASE WHEN event_id % 101 = 0 THEN repeat('f', 64) ELSE previous_hash END AS previous_hash, event_hash FROM l WHERE event_id % 89 <> 0"
_V1 = f"{_EV}, l AS (SELECT chain, seq, event_id, payload, '{SEED}' AS previous_hash, sha256('{SEED}' || payload) AS entry_hash FROM e WHERE seq = 0 UNION ALL SELECT e.chain, e.seq, e.event_id, e.payload, l.entry_hash, sha256(l.entry_hash || e.payload) FROM l JOIN e ON e.chain = l.chain AND e.seq = l.seq + 1)"
ORACLE_SQL = {
    "chain_v1_build": f"WITH RECURSIVE {_EV}, h AS (SELECT chain, seq, sha256('{SEED}' || payload) AS h FROM e WHERE seq = 0 UNION ALL SELECT e.chain, e.seq, sha256(h.h || e.payload) FROM h JOIN e ON e.chain = h.chain AND e.seq = h.seq + 1) SELECT chain, seq + 1 AS n, h AS head FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY seq DESC) AS r FROM h) t WHERE r = 1",
    "chain_v2_event_hash": f"WITH {_EV} SELECT event_id, seq, {_hash("seq", f"'{ZERO}'", "payload")} AS event_hash FROM e",
    "chain_tamper_findings": f"WITH RECURSIVE {_CHAIN}, t AS ({_TAMPERED}), {_FOUND} SELECT chain, seq, finding FROM f",
    "chain_long_verify": f"WITH RECURSIVE {_LONG}, t AS (SELECT chain, seq, CASE WHEN event_id % 97 <> 0 THEN payload END AS payload, CASE WHEN event_id % 101 = 0 THEN repeat('f', 64) ELSE previous_hash END AS previous_hash, event_hash FROM l WHERE event_id % 89 <> 0), {_FOUND} SELECT chain, seq, finding FROM f",
    "chain_summary": f"WITH RECURSIVE {_CHAIN}, t AS (SELECT * FROM l), {_FOUND}, c AS (SELECT DISTINCT chain FROM t), b AS (SELECT DISTINCT chain FROM f) SELECT count(*) AS total, count(*) FILTER (WHERE b.chain IS NULL) AS ok, bool_and(b.chain IS NULL) AS all_ok FROM c LEFT JOIN b ON b.chain = c.chain",
    "daily_anchor": f"""
        WITH RECURSIVE {_EV},
        o AS (SELECT CAST(ts AS DATE) AS day, ts, event_id, sha256(unhex('{LEAF}' || {_hash("seq", f"'{ZERO}'", "payload")})) AS h FROM e),
        d AS (SELECT day, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, list(h ORDER BY ts, event_id) AS hs FROM o GROUP BY day),
        m AS (SELECT day, hs FROM d UNION ALL SELECT day, list_transform(range(0, (len(hs) + 1) // 2), lambda i: sha256(unhex('{NODE}' || hs[2 * i + 1] || coalesce(hs[2 * i + 2], hs[2 * i + 1])))) FROM m WHERE len(hs) > 1)
        SELECT d.day, n, first_event, last_event, m.hs[1] AS root FROM d JOIN m ON m.day = d.day AND len(m.hs) = 1
    """,
    "chain_v1_verify": f"""
        WITH RECURSIVE {_V1},
        t AS (SELECT chain, seq, CASE WHEN event_id % 397 = 0 THEN payload || ' ' ELSE payload END AS payload, CASE WHEN event_id % 401 = 0 THEN repeat('f', 64) ELSE previous_hash END AS previous_hash, entry_hash FROM l),
        w AS (SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY chain ORDER BY seq), '{SEED}') AS expected FROM t),
        r AS (SELECT *, CASE WHEN previous_hash <> expected THEN 'LINK' WHEN sha256(previous_hash || payload) <> entry_hash THEN 'CONTENT' END AS reason FROM w)
        SELECT chain, count(*) AS entries, count(reason) = 0 AS valid, min(seq) FILTER (WHERE reason IS NOT NULL) AS broken_at, arg_min(reason, seq) FILTER (WHERE reason IS NOT NULL) AS reason FROM r GROUP BY chain
    """,
    "chain_reports": f"""
        WITH RECURSIVE {_CHAIN}, t AS (SELECT chain, seq, CASE WHEN event_id % 97 = 0 THEN payload || ' ' ELSE payload END AS payload, previous_hash, event_hash FROM l WHERE event_id % 89 <> 0), {_FOUND},
        h AS (SELECT chain, count(*) AS entries, arg_max(event_hash, seq) AS head FROM t GROUP BY chain),
        k AS (SELECT chain, count(*) FILTER (WHERE finding = 'EVENT_HASH') AS event_hash, count(*) FILTER (WHERE finding = 'LINK') AS link, count(*) FILTER (WHERE finding = 'GAP') AS gap, count(*) FILTER (WHERE finding = 'GENESIS') AS genesis FROM f GROUP BY chain)
        SELECT h.chain, entries, head, coalesce(event_hash, 0) AS event_hash, coalesce(link, 0) AS link, coalesce(gap, 0) AS gap, coalesce(genesis, 0) AS genesis, CASE WHEN k.chain IS NULL THEN 'VERIFIED' ELSE 'TAMPERED' END AS status FROM h LEFT JOIN k ON k.chain = h.chain
    """,
    "chain_bundle": f"""WITH RECURSIVE {_CHAIN} SELECT chain, seq, '{{"event_hash":"' || event_hash || '","event_id":' || event_id || ',"previous":"' || previous_hash || '","seq":' || seq || '}}' AS line FROM l""",
    "coverage_diff": "SELECT user_id, event_type, greatest(a - b, 0) AS missing, greatest(b - a, 0) AS extra FROM (SELECT user_id, event_type, count(*) FILTER (WHERE event_id % 7 <> 0) AS a, count(*) FILTER (WHERE event_id % 11 <> 0) AS b FROM events GROUP BY user_id, event_type) t WHERE a <> b",
}
ORACLE_SQL["anchor_manifest"] = f"""SELECT day, '{{"algorithm":"sha256-merkle-v1","anchor_date":"' || strftime(day, '%Y-%m-%d') || '","event_count":' || n || ',"first_event_id":' || first_event || ',"last_event_id":' || last_event || ',"merkle_root":"' || root || '"}}' AS manifest FROM ({ORACLE_SQL["daily_anchor"]}) q"""
