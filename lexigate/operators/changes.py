"""State changes as rewrites: partial updates, promotions, soft deletes, appends with conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.sources.tables import table


def partial_update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the changed columns' non-null values; rows without a change stay. Later changes are merged first."""
    fresh = [c for c in changes.columns if c != key and c in rows.columns]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in fresh])
    joined = rows.join(new, key, "left")
    return joined.select(*[(F.coalesce(f"new_{c}", c) if c in fresh else F.col(c)).alias(c) for c in rows.columns])


def promote(rules: DataFrame, requests: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, audit rows): proposed rules become active where the asker may and gives a reason."""
    good = requests.where("coalesce(trim(reason), '') <> ''").join(allowed, "role", "left_semi")
    asked = good.groupBy("rule_id").agg(F.min_by(F.struct("role", "reason"), "asked_at").alias("by"))
    hit = rules.where("status = 'PROPOSED'").join(asked, "rule_id")
    audit = hit.select("rule_id", F.lit("RULE_PROMOTED").alias("event_type"), "by.role", "by.reason")
    updated = rules.join(hit.select("rule_id", F.lit("ACTIVE").alias("new")), "rule_id", "left").withColumn("status", F.coalesce("new", "status")).drop("new")
    return updated, audit


def soft_delete(rows: DataFrame, condition: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, snapshots): matching live rows are marked, never removed, and snapshot first."""
    hit = condition & ~F.col("is_deleted")
    snapshots = rows.where(hit).withColumn("deleted_at", now)
    return rows.withColumn("is_deleted", F.col("is_deleted") | hit), snapshots


def append_missing(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and those of fresh whose key is not there yet, one for each key."""
    return rows.unionByName(fresh.dropDuplicates(keys).join(rows.select(*keys), keys, "left_anti").select(*rows.columns))


def capture_edits(segments: DataFrame) -> DataFrame:
    """Corrections worth learning: changed and not empty before."""
    return segments.where("old_text <> '' AND old_text <> new_text")


def status_updates(spark: SparkSession, d: str) -> DataFrame:
    """Orders after a sweep: pending ones of the oldest day of each customer are in review."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    hit = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") == F.col("first"))
    return o.withColumn("first", first).select("o_orderkey", F.when(hit, "R").otherwise(F.col("o_orderstatus")).alias("status"))


def learning_rows(spark: SparkSession, d: str) -> DataFrame:
    """Memory rows of answered turns: content hash of the source, both texts' lengths, one row for each hash."""
    from lexigate.operators.gate_queries import pairs

    p = pairs(spark, d).where("trim(source) <> '' AND trim(target) <> ''").select(F.sha2(F.trim("source"), 256).alias("content_hash"), "conv_id", "turn")
    return p.groupBy("content_hash").agg(F.count("*").alias("n"), F.max(F.struct("conv_id", "turn")).alias("last")).select("content_hash", "n", "last.conv_id", "last.turn")


QUERIES = {f.__name__: f for f in (status_updates, learning_rows)}
ORACLE_SQL = {
    "status_updates": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey) THEN 'R' ELSE o_orderstatus END AS status FROM orders",
    "learning_rows": "WITH p AS (SELECT conv_id, turn, text AS source, role, lead(role) OVER w AS next_role, lead(text) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)), q AS (SELECT sha256(trim(source, ' ')) AS content_hash, conv_id, turn FROM p WHERE role = 'user' AND next_role = 'assistant' AND trim(source, ' ') <> '' AND trim(target, ' ') <> '') SELECT content_hash, n, conv_id, turn FROM (SELECT *, count(*) OVER (PARTITION BY content_hash) AS n, row_number() OVER (PARTITION BY content_hash ORDER BY conv_id DESC, turn DESC) AS r FROM q) t WHERE r = 1",
}
