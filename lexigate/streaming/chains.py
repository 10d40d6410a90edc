"""Appending to hash chains as a stream: next index, repeated and late events, silent chains.

Events wait in the state of their chain until the watermark has passed them and are then
linked in order of time, so the hashes do not depend on the order of arrival within the delay. A
chain's state is its head and what waits; what has been linked is not kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexigate.plans.audit import _CHAIN, TAG, ZERO
from lexigate.sources.tables import table

#: How long an event may be late, and after how long a silent chain is reported.
DELAY, SILENCE_MS = "2 hours", 6 * 3600 * 1000
#: Spans of time of a table that are appended one after another.
PARTS = 4
APPENDED, LATE, SILENT = "APPENDED", "LATE", "SILENT"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_OUT = "chain bigint, seq bigint, event_id bigint, previous_hash string, event_hash string, status string"
_COLUMNS = [x.split()[0] for x in _OUT.split(", ")]


def link(seq: int, previous: str, payload: str | None) -> str:
    """The hash of an entry: tag, sequence number, hash before it, hash of the payload (null: empty)."""
    return hashlib.sha256(bytes.fromhex(TAG) + seq.to_bytes(8, "little") + bytes.fromhex(previous) + hashlib.sha256((payload or "").encode()).digest()).hexdigest()


class Appender(StatefulProcessor):
    """State of a chain: its head (seq of the next entry, hash, place of the last event) and the events that wait.

    Events of a chain that come together wait together, as one entry of JSON: an entry for each
    event costs far more than the event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "seq long, hash string, ts long, event_id long, told boolean")
        self.waiting = handle.getListState("waiting", "events string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Events that lie behind the head are late; a repeated one is late too, once its first is linked."""
        ts, last = self._head()[2:4]
        fresh = [(int(t.value // 1000), int(i), p) for pdf in rows for t, i, p in zip(pdf["ts"], pdf["event_id"], pdf["payload"], strict=True)]
        late = [r for r in fresh if ts is not None and r[:2] <= (ts, last)]
        kept = [r for r in fresh if ts is None or r[:2] > (ts, last)]
        if kept:
            self.waiting.appendValue((json.dumps(kept),))
            self.handle.registerTimer(min(r[0] for r in kept) // 1000 + 1)
        if late:
            yield pd.DataFrame([(key[0], None, r[1], None, None, LATE) for r in late], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Link what the watermark has passed, repeated events once; report each silence once, at the latest when it ends."""
        passed = timerValues.getCurrentWatermarkInMs()
        seq, head, ts, last, told = self._head()
        rows = sorted(tuple(r) for (some,) in self.waiting.get() for r in json.loads(some)) if self.waiting.exists() else []
        due, rest, out = [r for r in rows if r[0] // 1000 < passed], [r for r in rows if r[0] // 1000 >= passed], []
        silent = lambda: (key[0], seq, last, None, head, SILENT)
        for t, event, payload in due:
            if (t, event) == (ts, last):
                out.append((key[0], None, event, None, None, LATE))
                continue
            if ts is not None and not told and t // 1000 - ts // 1000 > SILENCE_MS:
                out.append(silent())
            before, head = head, link(seq, head, payload)
            out.append((key[0], seq, event, before, head, APPENDED))
            seq, ts, last, told = seq + 1, t, event, False
        if ts is not None and not told and passed - ts // 1000 > SILENCE_MS:
            out.append(silent())
            told = True
        if ts is not None:
            self.head.update((seq, head, ts, last, told))
        if due:
            if rest:
                self.waiting.put([(json.dumps(rest),)])
            else:
                self.waiting.clear()
            self.handle.registerTimer(ts // 1000 + SILENCE_MS + 2)
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def _head(self) -> tuple:
        head = self.head.get()
        return (0, ZERO, None, None, False) if head is None else tuple(head)

    def close(self) -> None:
        pass


def append_chains(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Entries of chains from a stream of events (chain, ts, event_id, payload); the state store must be RocksDB.

    Rows: chain, seq, event_id, previous_hash, event_hash, status. APPENDED entries are those of a
    chain built at once over all events in order of (ts, event_id). LATE events lie behind the
    head or repeat it, and are not linked (those behind the watermark do not get here). SILENT names
    the head of a chain (seq: entries so far) that no event followed for SILENCE_MS, once for each such silence.
    """
    return events.withWatermark("ts", delay).groupBy("chain").transformWithStateInPandas(Appender(), _OUT, "Append", "EventTime")


def run_append(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what there is to ``out`` (Parquet) and stop; a later call goes on from the checkpoint."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if old is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, old)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events of chains by type, as instants."""
    return table(spark, d, "events").select(F.col("user_id").alias("chain"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("props").alias("payload"))


def chain_append_stream(spark: SparkSession, d: str) -> DataFrame:
    """The chains of all users, appended in four spans of time, each by a run of the stream that goes on from the one before."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{folder.rstrip('/')}/lexigate-append-{uuid.uuid4().hex}"
    events = _events(spark, d)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    for i in range(PARTS if first else 0):
        step = (last - first) / PARTS
        own = (F.col("ts") >= F.lit(first + i * step)) & ((F.col("ts") < F.lit(first + (i + 1) * step)) if i + 1 < PARTS else F.lit(True))
        events.where(own).write.mode("append").parquet(f"{folder}/in")
        stream = append_chains(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
        run_append(spark, stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(_OUT).parquet(f"{folder}/out") if first else spark.createDataFrame([], _OUT)


QUERIES = {"chain_append_stream": chain_append_stream}
#: Events behind the last watermark, linked at once, and the silences between them.
ORACLE_SQL = {
    "chain_append_stream": f"""
        WITH RECURSIVE {_CHAIN.replace("FROM events)", "FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 7200000 FROM events))")},
        s AS (
            SELECT l.*, lead(epoch_ms(e.ts)) OVER (PARTITION BY chain ORDER BY seq) AS next, epoch_ms(e.ts) AS own, (SELECT epoch_ms(max(ts)) - 7200000 FROM events) AS mark
            FROM l JOIN events e ON e.event_id = l.event_id
        )
        SELECT chain, seq, event_id, previous_hash, event_hash, 'APPENDED' AS status FROM s
        UNION ALL SELECT chain, seq + 1, event_id, NULL, event_hash, 'SILENT' FROM s WHERE coalesce(next, mark) - own > {SILENCE_MS}
    """
}
