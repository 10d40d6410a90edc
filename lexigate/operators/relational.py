"""Operational queries: scoped scans, lists, pages, top-k, rollups, joins and sweeps.

Orders stand for jobs (status, priority, cost), customers' nations for tenants, events for
the activity log. Every top-k and page ends in an id, so its rows are fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.sources.tables import TenantCatalog, table

NOW = "timestamp'1996-01-01 00:00:00'"
EVENT_CUTOFF_DAYS = 2


def tenant_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one tenant: the predicate that every tenant-scoped read carries."""
    return TenantCatalog(spark, d, 7).table("customer", "c_nationkey").select("c_custkey", "c_name", "c_acctbal")


def tenant_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of a tenant's members, by membership rather than a fetched id list."""
    members = TenantCatalog(spark, d, 7).table("customer", "c_nationkey").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(members, "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def members_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers without any job."""
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


def org_order_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Dashboard figures of each tenant in one pass: totals, conditional counts, mean and sum."""
    jobs = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.count("*")
    return jobs.groupBy("c_nationkey").agg(
        n.alias("jobs"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open_jobs"),
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        F.round(F.avg("o_totalprice"), 2).alias("mean_cost"),
        F.round(F.sum("o_totalprice"), 2).alias("total_cost"),
        F.count_if(F.col("o_orderdate") >= F.expr(NOW) - F.expr("interval 1 day")).alias("last_day"),
    )


def order_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status, by priority, and of all, as grouping sets in one scan."""
    rolled = table(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority")
    return rolled.agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority", "level", "n")


def order_list_page(spark: SparkSession, d: str) -> DataFrame:
    """Third page of open jobs, newest first, 20 a page."""
    page = table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)
    return page.select("o_orderkey", "o_custkey", "o_totalprice")


def name_search(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive substring search with scope predicates that also take null."""
    part = table(spark, d, "part")
    return part.where(F.col("p_name").ilike("%a%") & ((F.col("p_size") == 10) | F.col("p_size").isNull())).select("p_partkey", "p_name", "p_brand")


def activity_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The 100 newest events; k is clamped to 1..100."""
    k = min(max(250, 1), 100)
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(k).select("event_id", "user_id", "event_type")


def recent_activity_priority(spark: SparkSession, d: str) -> DataFrame:
    """Activity label of each event: status first, then a low-score override; 0 and null are exempt."""
    v = F.col("value")
    label = F.when(F.col("event_type") == "error", "failed").when((v > 0) & (v < 10), "needs_review").when(F.col("event_type") == "purchase", "completed").otherwise("in_progress")
    return table(spark, d, "events").select("event_id", label.alias("label"))


def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    """Newest event of each user, by a combining aggregate rather than a sort."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_id", "e.event_type")


def event_feed_joined(spark: SparkSession, d: str) -> DataFrame:
    """Events with their key of the payload and the customer that the key names."""
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return e.join(c, "k", "left").select("event_id", "k", F.coalesce("c_name", F.lit("unknown")).alias("name"))


def running_budget(spark: SparkSession, d: str) -> DataFrame:
    """Running cost of each customer's jobs, and where it passes the budget (strictly)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).over(w)
    return table(spark, d, "orders").select("o_orderkey", spent.alias("spent_cents")).withColumn("exceeded", F.col("spent_cents") > 100_000_000)


def budget_exceeded_from(spark: SparkSession, d: str) -> DataFrame:
    """First job of each customer at which the budget is passed."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).over(w).alias("spent"))
    return rows.where("spent > 100000000").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


def rule_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    """Top 10 parts by fires (returned lines count as false positives): fires / (fires + false) x 100."""
    fires, false = F.count_if(F.col("l_returnflag") != "R"), F.count_if(F.col("l_returnflag") == "R")
    grouped = table(spark, d, "lineitem").groupBy("l_partkey").agg(fires.alias("fires"), false.alias("false_positives"))
    rate = F.when(F.col("fires") + F.col("false_positives") > 0, F.round(100 * F.col("fires") / (F.col("fires") + F.col("false_positives")), 1)).otherwise(0.0)
    return grouped.withColumn("effectiveness", rate).orderBy(F.desc("fires"), "l_partkey").limit(10)


def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of events by type and by sign of the value, as grouping sets."""
    e = table(spark, d, "events").withColumn("state", F.when(F.col("value") > 50, "high").otherwise("low"))
    return e.groupingSets([["event_type"], ["state"]], "event_type", "state").agg(F.count("*").alias("n")).select("event_type", "state", "n")


def glossary_with_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier with the number of its lines, 0 where it has none."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "supplier").join(n, "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n"))


def job_universe(spark: SparkSession, d: str) -> DataFrame:
    """Jobs known to either of two logs, and to which: a full outer join of distinct ids."""
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both")
    return a.join(b, "id", "full_outer").select("id", side.alias("side"))


def stuck_users(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last activity is older than the cutoff before the newest event of all."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    newest = e.agg(F.max("ts").alias("now"))
    return last.join(F.broadcast(newest)).where(F.col("last_ts") < F.col("now") - F.expr(f"interval {EVENT_CUTOFF_DAYS} days")).select("user_id", "n")


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Fixed batches of five turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.floor((F.row_number().over(w) - 1) / 5).cast("bigint").alias("batch"))


def segment_context(spark: SparkSession, d: str) -> DataFrame:
    """Previous and next text of every turn, 500 characters of each."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    cut = lambda c: F.substring(c, 1, 500)
    return table(spark, d, "conversations").select("conv_id", "turn", cut(F.lag("text").over(w)).alias("before"), cut(F.lead("text").over(w)).alias("after"))


def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Batches, calls, tokens and seconds that a conversation would take."""
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("segments"), F.sum(words).alias("words"))
    n = F.ceil(F.col("segments") / 5)
    return g.select("conv_id", n.cast("bigint").alias("batches"), F.floor(F.col("words") * 26 / 10).cast("bigint").alias("input_tokens"), F.floor(F.col("words") * 15 / 10).cast("bigint").alias("output_tokens"), (F.ceil(n / 4) * 3 + F.ceil(F.col("segments") / 4)).cast("bigint").alias("seconds"))


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative histogram of event values by type over fixed bounds."""
    bounds = [1, 5, 10, 25, 50, 100]
    g = table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in bounds], F.count("value").alias("le_inf"))
    return g


def p99_value(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank 99th percentile of each type: the whole number in which it lies by counts, then the value in there."""
    e = table(spark, d, "events").where("value is not null").select("event_type", "value", F.floor("value").alias("b"))
    w = Window.partitionBy("event_type").orderBy("b")
    bins = e.groupBy("event_type", "b").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy("event_type")))
    at = bins.where(F.col("upto") * 100 >= F.col("total") * 99).groupBy("event_type").agg(F.min_by(F.struct("b", (F.col("upto") - F.col("c")).alias("before"), "total"), "b").alias("x")).select("event_type", "x.*")
    inside = e.join(at, ["event_type", "b"]).groupBy("event_type", "value", "before", "total").agg(F.count("*").alias("c"))
    rank = F.col("before") + F.sum("c").over(Window.partitionBy("event_type").orderBy("value"))
    return inside.withColumn("rank", rank).where(F.col("rank") * 100 >= F.col("total") * 99).groupBy("event_type").agg(F.min("value").alias("p99"))


def distinct_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Users and days of each event type."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and both differences of two id sets."""
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    b = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"))
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a)}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("op"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    """What occurrences of a status one priority has over another: a multiset difference."""
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderpriority").startswith(p)).select("o_custkey") for p in ("1", "2"))
    return a.exceptAll(b).groupBy("o_custkey").agg(F.count("*").alias("extra"))


_JOBS = "FROM orders JOIN customer ON o_custkey = c_custkey"
QUERIES = {f.__name__: f for f in (tenant_scan, tenant_semi_join, members_anti, org_order_metrics, order_status_counts, order_list_page, name_search, activity_top_k, recent_activity_priority, latest_event_per_user, event_feed_joined, running_budget, budget_exceeded_from, rule_effectiveness, feedback_stats, glossary_with_counts, job_universe, stuck_users, batches, segment_context, cost_estimate, latency_histogram, p99_value, distinct_by_type, set_operations, multiset_difference)}
ORACLE_SQL = {
    "tenant_scan": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 7",
    "tenant_semi_join": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)",
    "members_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "org_order_metrics": f"SELECT c_nationkey, count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_jobs, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, round(avg(o_totalprice), 2) AS mean_cost, round(sum(o_totalprice), 2) AS total_cost, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-12-31 00:00:00') AS last_day {_JOBS} GROUP BY c_nationkey",
    "order_status_counts": "SELECT o_orderstatus, NULL::VARCHAR AS o_orderpriority, 1::BIGINT AS level, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT NULL, o_orderpriority, 2, count(*) FROM orders GROUP BY o_orderpriority UNION ALL SELECT NULL, NULL, 3, count(*) FROM orders",
    "order_list_page": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "name_search": "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%a%' AND (p_size = 10 OR p_size IS NULL)",
    "activity_top_k": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "recent_activity_priority": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 0 AND value < 10 THEN 'needs_review' WHEN event_type = 'purchase' THEN 'completed' ELSE 'in_progress' END AS label FROM events",
    "latest_event_per_user": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) t WHERE r = 1",
    "event_feed_joined": "SELECT event_id, k, coalesce(c_name, 'unknown') AS name FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e LEFT JOIN customer ON c_custkey = k",
    "running_budget": "SELECT o_orderkey, CAST(spent AS BIGINT) AS spent_cents, spent > 100000000 AS exceeded FROM (SELECT o_orderkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) t",
    "budget_exceeded_from": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM (SELECT o_custkey, o_orderkey, o_orderdate, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) t WHERE spent > 100000000) u WHERE r = 1",
    "rule_effectiveness": "SELECT l_partkey, fires, false_positives, CASE WHEN fires + false_positives > 0 THEN round(100.0 * fires / (fires + false_positives), 1) ELSE 0.0 END::DOUBLE AS effectiveness FROM (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS fires, count(*) FILTER (WHERE l_returnflag = 'R') AS false_positives FROM lineitem GROUP BY l_partkey) t ORDER BY fires DESC, l_partkey LIMIT 10",
    "feedback_stats": "WITH e AS (SELECT event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS state FROM events) SELECT event_type, NULL::VARCHAR AS state, count(*) AS n FROM e GROUP BY event_type UNION ALL SELECT NULL, state, count(*) FROM e GROUP BY state",
    "glossary_with_counts": "SELECT s_suppkey, s_name, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name",
    "job_universe": "WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P') SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'only_b' WHEN b.id IS NULL THEN 'only_a' ELSE 'both' END AS side FROM a FULL OUTER JOIN b ON a.id = b.id",
    "stuck_users": f"SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL {EVENT_CUTOFF_DAYS} DAY",
    "batches": "SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) / 5) AS BIGINT) AS batch FROM conversations",
    "segment_context": "SELECT conv_id, turn, substr(lag(text) OVER w, 1, 500) AS before, substr(lead(text) OVER w, 1, 500) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
    "cost_estimate": "SELECT conv_id, CAST(ceil(segments / 5.0) AS BIGINT) AS batches, CAST(floor(words * 26 / 10.0) AS BIGINT) AS input_tokens, CAST(floor(words * 15 / 10.0) AS BIGINT) AS output_tokens, CAST(ceil(ceil(segments / 5.0) / 4.0) * 3 + ceil(segments / 4.0) AS BIGINT) AS seconds FROM (SELECT conv_id, count(*) AS segments, sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS words FROM conversations GROUP BY conv_id) t",
    "latency_histogram": "SELECT event_type, " + ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{b}" for b in (1, 5, 10, 25, 50, 100)) + ", count(value) AS le_inf FROM events GROUP BY event_type",
    "p99_value": "SELECT event_type, min(value) AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) t WHERE r * 100 >= n * 99 GROUP BY event_type",
    "distinct_by_type": "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type",
    "set_operations": "WITH a AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O') SELECT 'union' AS op, id FROM (SELECT id FROM a UNION SELECT id FROM b) t UNION ALL SELECT 'both', id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) t UNION ALL SELECT 'only_a', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b) t UNION ALL SELECT 'only_b', id FROM (SELECT id FROM b EXCEPT SELECT id FROM a) t",
    "multiset_difference": "SELECT o_custkey, n1 - n2 AS extra FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS n1, count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS n2 FROM orders GROUP BY o_custkey) t WHERE n1 > n2",
}
