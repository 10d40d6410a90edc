"""Scoring: defects to verdicts, confidence, weighted quality scores, agreement of raters.

Lines stand for defects: the line number is the quality dimension, (return flag, status)
give the severity, the order's priority its metric profile, the quantities its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.functions.gates import SEVERITY_SCORES
from lexigate.sources.tables import table

# Fixed values of the metric profiles: pass threshold, acceptable penalty points, weight of each dimension.
PROFILES = {
    "1": (97.0, 3.0, {1: 3, 2: 3, 6: 2}),
    "2": (98.0, 2.0, {1: 3, 2: 3, 5: 2}),
    "3": (97.0, 3.0, {1: 3, 2: 3}),
    "4": (97.0, 3.0, {1: 3, 6: 2}),
    "5": (90.0, 10.0, {4: 2, 6: 2, 1: 2}),
}
FLOOR = 500


def _severity() -> Column:
    return F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "CRITICAL").when(F.col("l_returnflag") == "R", "MAJOR").when(F.col("l_returnflag") == "A", "MINOR").otherwise("NEUTRAL")


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("dimension"), _severity().alias("severity"), "l_quantity")


def _counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "MAJOR", "MINOR")]


def defects_from_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Defects by dimension and severity."""
    return _defects(spark, d).groupBy("dimension", "severity").agg(F.count("*").alias("n"))


def verdict_per_order(spark: SparkSession, d: str) -> DataFrame:
    """Severity counts and verdict of each job, with its pass rate."""
    c = _defects(spark, d).groupBy("l_orderkey").agg(*_counts())
    verdict = F.when(F.col("critical") > 0, "BLOCKED").when(F.col("major") > 0, "REVIEW_REQUIRED").otherwise("PASS")
    return c.withColumn("verdict", verdict).withColumn("pass_rate", F.greatest(F.lit(0), 100 - 5 * (F.col("critical") + F.col("major") + F.col("minor"))))


def risk_status(spark: SparkSession, d: str) -> DataFrame:
    """Status under the job's risk level: high reviews any defect, medium the major ones, low passes."""
    c = _defects(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*_counts())
    risk = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2") | F.col("o_orderpriority").startswith("3"), "medium").otherwise("low")
    any_, major = F.col("critical") + F.col("major") + F.col("minor"), F.col("major")
    status = F.when(F.col("critical") > 0, "blocked").when((F.col("risk") == "high") & (any_ > 0), "review").when((F.col("risk") == "medium") & (major > 0), "review").otherwise("pass")
    return table(spark, d, "orders").select("o_orderkey", risk.alias("risk")).join(c, "o_orderkey").select("o_orderkey", "risk", status.alias("status"))


def scorecard_compare(spark: SparkSession, d: str) -> DataFrame:
    """Change of each customer's job against the one before: critical counts first, then major."""
    c = _defects(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*_counts())
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pair = F.struct("critical", "major")
    j = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(c, "o_orderkey").withColumn("before", F.lag(pair).over(w))
    change = F.when(F.col("before").isNull(), "FIRST").when(pair < F.col("before"), "IMPROVED").when(pair > F.col("before"), "DEGRADED").otherwise("NEUTRAL")
    return j.select("o_orderkey", change.alias("change"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    profile = F.substring("o_orderpriority", 1, 1)
    weight = F.lit(1.0)
    for p, (_, _, weights) in PROFILES.items():
        for dim, w in weights.items():
            weight = F.when((F.col("profile") == p) & (F.col("dimension") == dim), float(w)).otherwise(weight)
    score = F.lit(0)
    for s, v in SEVERITY_SCORES.items():
        score = F.when(F.col("severity") == s, v).otherwise(score)
    jobs = table(spark, d, "orders").select("o_orderkey", profile.alias("profile"))
    return _defects(spark, d).join(jobs, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("points", weight * score)


def mqm_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Weighted penalty points of each profile and dimension."""
    return _scored(spark, d).groupBy("profile", "dimension").agg(F.sum("points").alias("points"), F.count("*").alias("n"))


def mqm_score_per_order(spark: SparkSession, d: str) -> DataFrame:
    """Per-word, normed, raw and calibrated quality score of each job, and whether it passes."""
    g = _scored(spark, d).groupBy("o_orderkey", "profile").agg(F.sum("points").alias("apt"), (F.sum("l_quantity") * 10).alias("ewc"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    threshold, points = F.lit(0.0), F.lit(1.0)
    for p, (pt, app, _) in PROFILES.items():
        threshold, points = F.when(F.col("profile") == p, pt).otherwise(threshold), F.when(F.col("profile") == p, app).otherwise(points)
    per_word = F.col("apt") / F.greatest(F.col("ewc"), F.lit(1.0))
    cqs = 100 - 1000 * per_word * (100 - threshold) / points
    return g.select("o_orderkey", "profile", "apt", F.round(100 * (1 - per_word), 4).alias("rqs"), F.round(cqs, 4).alias("cqs"), ((cqs >= threshold) & (F.col("critical") == 0)).alias("passed"), (F.col("ewc") < FLOOR).alias("short_sample"))


def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of each job: 0 with a critical defect, else 100 less penalties, in bands."""
    c = _defects(spark, d).groupBy("l_orderkey").agg(*_counts())
    raw = F.greatest(F.lit(0), 100 - 15 * F.col("major") - 5 * F.col("minor"))
    score = F.when(F.col("critical") > 0, 0).otherwise(raw)
    band = F.when(F.col("critical") > 0, "blocked").when(score >= 95, "excellent").when(score >= 80, "good").when(score >= 60, "fair").when(score > 0, "poor").otherwise("none")
    return c.select("l_orderkey", score.cast("bigint").alias("score"), band.alias("band"))


def shadow_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether two ways to block agree, by profile, with the least, mean and greatest points."""
    g = _scored(spark, d).groupBy("o_orderkey", "profile").agg(F.sum("points").alias("points"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    agree = (F.col("critical") > 0) == (F.col("points") >= 25)
    return g.groupBy("profile").agg(F.count("*").alias("jobs"), F.count_if(agree).alias("agreeing"), F.min("points").alias("least"), F.round(F.avg("points"), 4).alias("mean"), F.max("points").alias("most"))


def ensemble_merge(spark: SparkSession, d: str) -> DataFrame:
    """Greatest severity of each (job, dimension) over judges (odd and even suppliers), and disagreement."""
    rank = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "MAJOR", 2).when(F.col("severity") == "MINOR", 1).otherwise(0)
    x = _defects(spark, d).withColumn("judge", F.col("l_suppkey") % 2).withColumn("rank", rank)
    g = x.groupBy("l_orderkey", "dimension").agg(F.max("rank").alias("top"), F.min("rank").alias("low"), F.count_distinct("judge").alias("judges"))
    return g.select("l_orderkey", "dimension", F.col("top").cast("bigint").alias("top"), ((F.col("judges") < 2) | (F.col("top") != F.col("low"))).alias("disagreement"))


def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Cohen's kappa of two raters by language, with the degenerate cases."""
    rated = table(spark, d, "labels").where("quality is not null and toxic is not null").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    g = rated.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("same"), F.sum("quality").alias("a"), F.sum("toxic").alias("b"))
    n = F.col("n")
    po = F.col("same") / n
    pe = (F.col("a") * F.col("b") + (n - F.col("a")) * (n - F.col("b"))) / (n * n)
    return g.select("lang", "n", F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise(F.round((po - pe) / (1 - pe), 3)).alias("kappa"))


def judge_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of flagged documents against planted ones; an empty side is 1."""
    x = table(spark, d, "labels").select((F.col("quality") == 0).alias("planted"), (F.col("toxic") == 1).alias("judged"))
    g = x.agg(F.count_if(F.col("planted")).alias("p"), F.count_if(F.col("judged")).alias("j"), F.count_if(F.col("planted") & F.col("judged")).alias("hit"))
    rate = lambda of: F.when(F.col(of) == 0, 1.0).otherwise(F.round(F.col("hit") / F.col(of), 3))
    return g.select("p", "j", "hit", rate("p").alias("recall"), rate("j").alias("precision"))


def routing_choice(spark: SparkSession, d: str) -> DataFrame:
    """Best provider of each market segment: 0.7 x confidence + 0.3 x (1 - cost), least name on ties."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    conf = s.groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal") / 10000, 6).alias("confidence"))
    cost = c.groupBy("c_mktsegment", F.col("c_nationkey").alias("s_nationkey")).agg(F.round(F.avg("c_acctbal") / 10000, 6).alias("cost"))
    x = cost.join(conf, "s_nationkey").withColumn("score", F.round(0.7 * F.col("confidence") + 0.3 * (1 - F.col("cost")), 6))
    return x.groupBy("c_mktsegment").agg(F.max_by(F.struct("s_nationkey", "score"), F.struct("score", -F.col("s_nationkey"))).alias("b")).select("c_mktsegment", "b.s_nationkey", "b.score")


def suite_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each language's suite, and whether it passes the gate."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    acc = F.avg((F.col("quality") == 1).cast("int"))
    return x.groupBy("lang").agg(F.count("*").alias("cases"), F.round(acc, 4).alias("accuracy"), (acc >= 0.85).alias("passed"))


def regression_check(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of each type by halves of the log, and whether it fell by more than the tolerance."""
    e = table(spark, d, "events").where("value is not null")
    late = F.col("event_id") % 2 == 1
    g = e.groupBy("event_type").agg(F.round(F.avg(F.when(~late, F.col("value"))), 4).alias("baseline"), F.round(F.avg(F.when(late, F.col("value"))), 4).alias("current"))
    return g.withColumn("regressed", F.col("current") < F.col("baseline") - 0.02)


QUERIES = {f.__name__: f for f in (defects_from_lineitem, verdict_per_order, risk_status, scorecard_compare, mqm_by_dimension, mqm_score_per_order, confidence_score, shadow_agreement, ensemble_merge, cohen_kappa, judge_reliability, routing_choice, suite_accuracy, regression_check)}

_SEV = "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'CRITICAL' WHEN l_returnflag = 'R' THEN 'MAJOR' WHEN l_returnflag = 'A' THEN 'MINOR' ELSE 'NEUTRAL' END"
_D = f"d AS (SELECT l_orderkey, l_suppkey, l_linenumber AS dimension, {_SEV} AS severity, l_quantity FROM lineitem)"
_C = "c AS (SELECT l_orderkey, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'MAJOR') AS major, count(*) FILTER (WHERE severity = 'MINOR') AS minor FROM d GROUP BY l_orderkey)"
_W = "CASE " + " ".join(f"WHEN profile = '{p}' AND dimension = {k} THEN {float(v)}" for p, (_, _, ws) in PROFILES.items() for k, v in ws.items()) + " ELSE 1.0 END"
_S = f"s AS (SELECT o_orderkey, profile, dimension, severity, l_quantity, CAST({_W} AS DOUBLE) * CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'MAJOR' THEN 5 WHEN 'MINOR' THEN 1 ELSE 0 END AS points FROM d JOIN (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS profile FROM orders) o ON l_orderkey = o_orderkey)"
_PT = "CASE profile " + " ".join(f"WHEN '{p}' THEN {v[0]}" for p, v in PROFILES.items()) + " END::DOUBLE"
_APP = "CASE profile " + " ".join(f"WHEN '{p}' THEN {v[1]}" for p, v in PROFILES.items()) + " END::DOUBLE"
ORACLE_SQL = {
    "defects_from_lineitem": f"WITH {_D} SELECT dimension, severity, count(*) AS n FROM d GROUP BY dimension, severity",
    "verdict_per_order": f"WITH {_D}, {_C} SELECT l_orderkey, critical, major, minor, CASE WHEN critical > 0 THEN 'BLOCKED' WHEN major > 0 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS verdict, greatest(0, 100 - 5 * (critical + major + minor)) AS pass_rate FROM c",
    "risk_status": f"WITH {_D}, {_C} SELECT o_orderkey, risk, CASE WHEN critical > 0 THEN 'blocked' WHEN risk = 'high' AND critical + major + minor > 0 THEN 'review' WHEN risk = 'medium' AND major > 0 THEN 'review' ELSE 'pass' END AS status FROM (SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'medium' ELSE 'low' END AS risk FROM orders) o JOIN c ON l_orderkey = o_orderkey",
    "scorecard_compare": f"WITH {_D}, {_C}, j AS (SELECT o_orderkey, critical * 1000 + major AS m, lag(critical * 1000 + major) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders JOIN c ON l_orderkey = o_orderkey) SELECT o_orderkey, CASE WHEN p IS NULL THEN 'FIRST' WHEN m < p THEN 'IMPROVED' WHEN m > p THEN 'DEGRADED' ELSE 'NEUTRAL' END AS change FROM j",
    "mqm_by_dimension": f"WITH {_D}, {_S} SELECT profile, dimension, sum(points) AS points, count(*) AS n FROM s GROUP BY profile, dimension",
    "mqm_score_per_order": f"WITH {_D}, {_S}, g AS (SELECT o_orderkey, profile, sum(points) AS apt, sum(l_quantity) * 10 AS ewc, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical FROM s GROUP BY o_orderkey, profile), h AS (SELECT *, apt / greatest(ewc, 1.0) AS pw, {_PT} AS pt, {_APP} AS app FROM g) SELECT o_orderkey, profile, apt, round(100 * (1 - pw), 4) AS rqs, round(100 - 1000 * pw * (100 - pt) / app, 4) AS cqs, 100 - 1000 * pw * (100 - pt) / app >= pt AND critical = 0 AS passed, ewc < {FLOOR} AS short_sample FROM h",
    "confidence_score": f"WITH {_D}, {_C}, s AS (SELECT *, CASE WHEN critical > 0 THEN 0 ELSE greatest(0, 100 - 15 * major - 5 * minor) END AS score FROM c) SELECT l_orderkey, CAST(score AS BIGINT) AS score, CASE WHEN critical > 0 THEN 'blocked' WHEN score >= 95 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score > 0 THEN 'poor' ELSE 'none' END AS band FROM s",
    "shadow_agreement": f"WITH {_D}, {_S}, g AS (SELECT o_orderkey, profile, sum(points) AS points, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical FROM s GROUP BY o_orderkey, profile) SELECT profile, count(*) AS jobs, count(*) FILTER (WHERE (critical > 0) = (points >= 25)) AS agreeing, min(points) AS least, round(avg(points), 4) AS mean, max(points) AS most FROM g GROUP BY profile",
    "ensemble_merge": f"WITH {_D}, r AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'MAJOR' THEN 2 WHEN 'MINOR' THEN 1 ELSE 0 END AS rank_ FROM d) SELECT l_orderkey, dimension, CAST(max(rank_) AS BIGINT) AS top, count(DISTINCT l_suppkey % 2) < 2 OR max(rank_) <> min(rank_) AS disagreement FROM r GROUP BY l_orderkey, dimension",
    "cohen_kappa": "WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS same, sum(quality) AS a, sum(toxic) AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY lang), h AS (SELECT lang, n, same::DOUBLE / n AS po, (a * b + (n - a) * (n - b))::DOUBLE / (n * n) AS pe FROM g) SELECT lang, n, CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1.0 ELSE 0.0 END ELSE round((po - pe) / (1 - pe), 3) END::DOUBLE AS kappa FROM h",
    "judge_reliability": "WITH g AS (SELECT count(*) FILTER (WHERE quality = 0) AS p, count(*) FILTER (WHERE toxic = 1) AS j, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS hit FROM labels) SELECT p, j, hit, CASE WHEN p = 0 THEN 1.0 ELSE round(hit::DOUBLE / p, 3) END::DOUBLE AS recall, CASE WHEN j = 0 THEN 1.0 ELSE round(hit::DOUBLE / j, 3) END::DOUBLE AS precision FROM g",
    "routing_choice": "WITH f AS (SELECT s_nationkey, round(avg(s_acctbal) / 10000, 6) AS confidence FROM supplier GROUP BY s_nationkey), k AS (SELECT c_mktsegment, c_nationkey, round(avg(c_acctbal) / 10000, 6) AS cost FROM customer GROUP BY c_mktsegment, c_nationkey), x AS (SELECT c_mktsegment, s_nationkey, round(0.7 * confidence + 0.3 * (1 - cost), 6) AS score FROM k JOIN f ON s_nationkey = c_nationkey) SELECT c_mktsegment, s_nationkey, score FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY score DESC, s_nationkey) AS r FROM x) t WHERE r = 1",
    "suite_accuracy": "SELECT lang, count(*) AS cases, round(avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 4) AS accuracy, avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END) >= 0.85 AS passed FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang",
    "regression_check": "SELECT event_type, baseline, current, current < baseline - 0.02 AS regressed FROM (SELECT event_type, round(avg(value) FILTER (WHERE event_id % 2 = 0), 4) AS baseline, round(avg(value) FILTER (WHERE event_id % 2 = 1), 4) AS current FROM events WHERE value IS NOT NULL GROUP BY event_type) t",
}
