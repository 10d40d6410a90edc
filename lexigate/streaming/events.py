"""Event-time queries: a stream over the events table, and the batch twin that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.sources.tables import table

WINDOW, DELAY, GAP = "1 hour", "1 hour", "30 minutes"


def hourly(events: DataFrame) -> DataFrame:
    """Counts of each type and hour; the same plan for batch and stream."""
    g = events.withWatermark("ts", DELAY) if events.isStreaming else events
    return g.groupBy(F.window("ts", WINDOW).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame) -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    g = events.withWatermark("ts", DELAY) if events.isStreaming else events
    return g.groupBy(F.session_window("ts", GAP).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def replay(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream; watermarks need instants, so ts becomes one."""
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true")
    return source.parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over what there is, append finished rows as Parquet, and stop."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of the hourly stream."""
    return hourly(table(spark, d, "events"))


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of the session stream: number and sizes of the sessions of each user."""
    return sessions(table(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    """Circuit breaker of each user, as runs: open from the third error in a row until a success."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("ok", (F.col("event_type") != "error").cast("int"))
    e = e.withColumn("run", F.sum("ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    failures = F.sum(1 - F.col("ok")).over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", F.when(failures >= 3, "open").otherwise("closed").alias("state"))


QUERIES = {f.__name__: f for f in (hourly_counts, session_counts, breaker_states)}
ORACLE_SQL = {
    "hourly_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "session_counts": "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s), g AS (SELECT user_id, k, count(*) AS n FROM r GROUP BY user_id, k) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY user_id",
    "breaker_states": "WITH r AS (SELECT event_id, user_id, ts, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) SELECT event_id, CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 3 THEN 'open' ELSE 'closed' END AS state FROM r",
}
