"""Review and routing: what needs a person, what may be finished, which profile, model and price apply.

Orders stand for jobs and lines for their defects, as in ``quality``; events of a customer
for the acknowledgements of its jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.operators.quality import _counts, _defects
from lexigate.sources.tables import table

# Thresholds, profile ids by content type and archetype, calibrations, routes and prices.
LOW_CONFIDENCE, DRIFT_LEAST, MOST_ROUNDS = 85, 70, 3
PENALTY_MAJOR, PENALTY_MINOR = 15.0, 5.0
DRIFT_MEDIUM, DRIFT_HIGH, PENALTY_DRIFT_MEDIUM, PENALTY_DRIFT_HIGH = 0.05, 0.15, 10.0, 25.0
DOSAGE, FORMULA, LEGAL = r"(?i)\b(\d+(\.\d+)?)\s*(mg|ml|g|mcg|mol|tablet|capsule)", r"\d+\s*[\+\-\*/=]\s*\d+", r"(?i)\b(shall|must|prohibited|liable|obligation)\b"
CONTENT_PROFILES = {
    "icf": "icf", "informed_consent": "icf", "consent": "icf",
    "smpc": "smpc_pil", "spc": "smpc_pil", "pil": "smpc_pil",
    "labelling": "smpc_pil", "labeling": "smpc_pil", "label": "smpc_pil", "ifu": "smpc_pil",
    "pv": "pv", "pharmacovigilance": "pv", "psur": "pv", "dsur": "pv",
    "ae_narrative": "pv", "icsr": "pv", "narrative": "pv",
    "pro": "pro_coa", "coa": "pro_coa", "pro_coa": "pro_coa", "questionnaire": "pro_coa",
    "promo": "promo", "promotional": "promo", "mlr": "promo", "transcreation": "promo",
}
ARCHETYPE_PROFILES = {"SAFETY_CRITICAL": "smpc_pil", "ANALYTICAL": "pro_coa", "OPERATIONAL": "pv", "LEGAL": "smpc_pil", "INFORMATIONAL": "promo"}
TIER_PROFILES = {("OPERATIONAL", "TIER_A"): "smpc_pil", ("ANALYTICAL", "TIER_A"): "smpc_pil"}
DEFAULT_PROFILE = "smpc_pil"
#: (source, target): multiplier of defect penalties, difficulty of the pair, medium and high drift.
CALIBRATIONS = {
    ("en", "fr"): (1.0, 0.0, None, None),
    ("en", "es"): (1.0, 0.0, None, None),
    ("en", "de"): (1.0, 2.0, None, None),
    ("en", "it"): (1.0, 0.0, None, None),
    ("en", "pt"): (1.0, 0.0, None, None),
    ("en", "pt-br"): (1.0, 0.0, None, None),
    ("en", "nl"): (1.0, 0.0, None, None),
    ("en", "sv"): (1.0, 0.0, None, None),
    ("en", "da"): (1.0, 0.0, None, None),
    ("en", "no"): (1.0, 0.0, None, None),
    ("en", "ru"): (0.9, 3.0, None, None),
    ("en", "pl"): (0.9, 3.0, None, None),
    ("en", "cs"): (0.9, 3.0, None, None),
    ("en", "tr"): (0.9, 3.0, None, None),
    ("en", "el"): (0.9, 3.0, None, None),
    ("en", "hu"): (0.85, 4.0, None, None),
    ("en", "fi"): (0.85, 4.0, None, None),
    ("en", "ja"): (0.8, 5.0, 0.08, 0.20),
    ("en", "zh"): (0.8, 5.0, 0.08, 0.20),
    ("en", "zh-cn"): (0.8, 5.0, 0.08, 0.20),
    ("en", "zh-tw"): (0.8, 5.0, 0.08, 0.20),
    ("en", "ko"): (0.8, 5.0, 0.08, 0.20),
    ("en", "ar"): (0.8, 5.0, 0.08, 0.20),
    ("en", "he"): (0.8, 5.0, 0.08, 0.20),
    ("en", "hi"): (0.85, 4.0, 0.07, 0.18),
    ("en", "th"): (0.85, 4.0, None, None),
    ("en", "vi"): (0.9, 3.0, None, None),
}
MARKERS = ["$", "\\", "```", "|"]
LONG_SEGMENT = 200


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Scorecard of each job that has lines: counts, verdict and score."""
    c = _defects(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*_counts())
    verdict = F.when(F.col("critical") > 0, "BLOCKED").when(F.col("major") > 0, "REVIEW_REQUIRED").otherwise("PASS")
    score = F.when(F.col("critical") > 0, 0).otherwise(F.greatest(F.lit(0), 100 - 15 * F.col("major") - 5 * F.col("minor")))
    return c.withColumn("verdict", verdict).withColumn("score", score.cast("bigint")).withColumn("issues", F.col("critical") + F.col("major") + F.col("minor"))


def review_needed(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with any defect, or with a score below the threshold that is not the unscored 0."""
    return _cards(spark, d).where((F.col("issues") > 0) | ((F.col("score") < LOW_CONFIDENCE) & (F.col("score") != 0))).select("o_orderkey", "score")


def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    """Number of reviewable issues of each job, the low-confidence row among them, and its message."""
    low = F.col("score") < LOW_CONFIDENCE
    message = F.concat(F.lit("Confidence "), F.col("score").cast("string"), F.lit(f" is below the review threshold {LOW_CONFIDENCE}."))
    n = F.col("issues") + low.cast("bigint")
    return _cards(spark, d).select("o_orderkey", n.alias("issue_count"), (n > 0).alias("needs_review"), F.when(low, message).alias("low_confidence"))


def pending_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The review queue of each customer: blocked jobs and those to review; a customer without any has none."""
    flagged = _cards(spark, d).where(F.col("verdict").isin("BLOCKED", "REVIEW_REQUIRED"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(flagged, "o_orderkey").select("o_custkey", "o_orderkey", "verdict")


def finalisable(spark: SparkSession, d: str) -> DataFrame:
    """Whether a job may be finished: a card that passes, or one to review whose customer acknowledged it."""
    ack = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey")).distinct().withColumn("ack", F.lit(True))
    jobs = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(_cards(spark, d).select("o_orderkey", "verdict"), "o_orderkey", "left").join(ack, "o_custkey", "left")
    may = F.when(F.col("verdict") == "PASS", True).when(F.col("verdict") == "REVIEW_REQUIRED", F.coalesce("ack", F.lit(False))).otherwise(False)
    return jobs.select("o_orderkey", may.alias("may_finish"))


def next_step(spark: SparkSession, d: str) -> DataFrame:
    """Route of each job: refine while it is to be reviewed and under three rounds, else finish; urgent ones finish at once."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    jobs = table(spark, d, "orders").withColumn("rounds", F.pmod(F.row_number().over(w) - 1, F.lit(5))).join(_cards(spark, d), "o_orderkey")
    forced = F.col("o_orderpriority").startswith("1")
    step = F.when(forced, "finalize").when((F.col("verdict") == "REVIEW_REQUIRED") & (F.col("rounds") < MOST_ROUNDS), "refine").otherwise("finalize")
    return jobs.select("o_orderkey", step.alias("step"))


def drift_gate(spark: SparkSession, d: str) -> DataFrame:
    """Back-translation scores of each job: least, how many assessed and below the bound; null is not assessed."""
    score = F.when(F.col("l_tax") > 0, F.round(100 - F.col("l_discount") * 500).cast("bigint"))
    g = table(spark, d, "lineitem").select("l_orderkey", score.alias("score")).groupBy("l_orderkey")
    out = g.agg(F.min("score").alias("least"), F.count("score").alias("assessed"), F.count_if(F.col("score") < DRIFT_LEAST).alias("below"))
    return out.withColumn("review_required", F.col("below") > 0)


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    """Job metadata: content type, archetype and tier spread over parts; every eleventh names its profile."""
    kinds, archetypes = F.array(*[F.lit(x) for x in CONTENT_PROFILES]), F.array(*[F.lit(x) for x in ARCHETYPE_PROFILES])
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        F.when(k % 11 == 0, F.concat(F.lit("own_"), F.col("p_size").cast("string"))).alias("explicit"),
        F.when(k % 3 == 0, F.upper(F.get(kinds, (k % len(CONTENT_PROFILES)).cast("int")))).alias("content_type"),
        F.when(k % 4 != 0, F.get(archetypes, (k % len(ARCHETYPE_PROFILES)).cast("int"))).alias("archetype"),
        F.when(k % 2 == 0, "tier_a").otherwise("TIER_B").alias("tier"),
    )


def resolved_profile(explicit: Column, content_type: Column, archetype: Column, tier: Column) -> Column:
    """Metric profile: the one named, by content type, by archetype and tier, by archetype, the default."""
    pairs = _map({f"{a}:{t}": p for (a, t), p in TIER_PROFILES.items()})
    refined = F.try_element_at(pairs, F.concat_ws(":", F.upper(archetype), F.upper(tier)))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.try_element_at(_map(CONTENT_PROFILES), F.lower(content_type)), F.when(archetype.isNotNull(), refined), F.try_element_at(_map(ARCHETYPE_PROFILES), F.upper(archetype)), F.lit(DEFAULT_PROFILE))


def profile_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Metric profile of each job's metadata."""
    return _metadata(spark, d).select("p_partkey", resolved_profile(*map(F.col, ("explicit", "content_type", "archetype", "tier"))).alias("profile"))


def profile_validation(spark: SparkSession, d: str) -> DataFrame:
    """Whether archetype and tier may go together: an informational job is never of the top tier; missing ones take the strictest."""
    archetype, tier = F.coalesce("archetype", F.lit("SAFETY_CRITICAL")), F.upper("tier")
    wrong = (archetype == "INFORMATIONAL") & (tier == "TIER_A")
    return _metadata(spark, d).select("p_partkey", F.when(wrong, "GOVERNANCE").when(~archetype.isin(*ARCHETYPE_PROFILES), "ARCHETYPE").otherwise("OK").alias("status"), F.when(~wrong & (archetype == "SAFETY_CRITICAL"), "STRICT").alias("numeric_fidelity"))


def calibration(spark: SparkSession) -> DataFrame:
    """The calibration table; it has as many rows as CALIBRATIONS."""
    rows = [(s, t, *v) for (s, t), v in CALIBRATIONS.items()]
    return spark.createDataFrame(rows, "source string, target string, multiplier double, difficulty double, medium double, high double")


def calibrated(jobs: DataFrame, spark: SparkSession) -> DataFrame:
    """jobs with the calibration of (source, target): the exact pair, any source to the target, or none."""
    c = calibration(spark)
    rest = c.where("source = '*'").drop("source")
    exact = jobs.join(F.broadcast(c.withColumnsRenamed({x: f"{x}_x" for x in ("multiplier", "difficulty", "medium", "high")})), ["source", "target"], "left")
    both = exact.join(F.broadcast(rest), "target", "left")
    return both.select(*jobs.columns, *[F.coalesce(f"{x}_x", x, F.lit(v)).alias(x) for x, v in (("multiplier", 1.0), ("difficulty", 0.0), ("medium", DRIFT_MEDIUM), ("high", DRIFT_HIGH))])


_TARGETS = ["fr", "de", "RU", "fi", "ja", "hi", "vi", "xx"]


def calibrated_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of each job under its language pair's calibration and its mean drift, with its band."""
    drift = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / (100 * F.count("*"))).alias("drift"))
    target = F.lower(F.get(F.array(*[F.lit(x) for x in _TARGETS]), (F.col("o_orderkey") % len(_TARGETS)).cast("int")))
    jobs = calibrated(_cards(spark, d).join(drift, "o_orderkey").select("o_orderkey", "critical", "major", "minor", "drift", F.lit("en").alias("source"), target.alias("target")), spark)
    semantic = F.when(F.col("drift") > F.col("high"), PENALTY_DRIFT_HIGH).when(F.col("drift") > F.col("medium"), PENALTY_DRIFT_MEDIUM).otherwise(0.0)
    penalty = (F.col("major") * PENALTY_MAJOR + F.col("minor") * PENALTY_MINOR) * F.col("multiplier") + semantic + F.col("difficulty")
    score = F.when(F.col("critical") > 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - penalty))
    band = F.when(score >= 95, "Very High").when(score >= 80, "High").when(score >= 60, "Medium").when(score > 0, "Low").otherwise("Blocked")
    return jobs.select("o_orderkey", "target", F.bround(score, 1).alias("score"), band.alias("band"))


def structural_risk(spark: SparkSession, d: str) -> DataFrame:
    """Penalty of each document for doses, formulas and legal words, at most 25."""
    hit = lambda p, v: F.when(F.col("text").rlike(p), v).otherwise(0)
    return table(spark, d, "documents").select("doc_id", F.least(F.lit(25), hit(DOSAGE, 10) + hit(FORMULA, 10) + hit(LEGAL, 5)).alias("penalty"))


def short_sample_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of each job's quality around 100 less a point a defect: 100 over the root of its words, at most 50, clamped."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("words"), F.count_if(F.col("l_returnflag") != "N").alias("n"))
    margin = F.least(100.0 / F.sqrt(F.greatest("words", F.lit(1))), F.lit(50.0))
    score = 100.0 - F.col("n")
    return g.select("l_orderkey", F.round(F.greatest(F.lit(0.0), score - margin), 1).alias("low"), F.round(F.least(F.lit(100.0), score + margin), 1).alias("high"))


def score_delta(spark: SparkSession, d: str) -> DataFrame:
    """Weighted against plain score of each job: points by severity against penalties."""
    c = _cards(spark, d)
    weighted = 100 - 25 * F.col("critical") - 5 * F.col("major") - F.col("minor")
    return c.select("o_orderkey", weighted.alias("weighted"), F.col("score").alias("plain"), (weighted - F.col("score")).alias("delta"))


def segment_model(spark: SparkSession, d: str) -> DataFrame:
    """Model size for each turn: large over 200 characters or with a marker of code, math or tables."""
    marked = reduce(lambda a, b: a | b, [F.col("text").contains(m) for m in MARKERS])
    return table(spark, d, "conversations").select("conv_id", "turn", F.when((F.length("text") > LONG_SEGMENT) | marked, "large").otherwise("small").alias("model"))


# Tier by (task, complexity), tiers from cheap to best, and each tier's prices per million tokens.
POLICY = {("translate", "low"): "economy", ("translate", "medium"): "balanced", ("translate", "high"): "premium", ("judge", "high"): "premium"}
TIERS = ["economy", "balanced", "premium"]
PRICES = {"economy": (0.15, 0.6, 0.075), "balanced": (2.5, 10.0, 1.25), "premium": (5.0, 15.0, 2.5)}


def routed_cost(spark: SparkSession, d: str) -> DataFrame:
    """Tier and price of each conversation's call: by task and complexity, an override for some, one step down near the budget."""
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", words).otherwise(0)).alias("input"), F.sum(F.when(F.col("role") == "assistant", words).otherwise(0)).alias("output"))
    complexity = F.when(F.col("input") > 300, "high").when(F.col("input") > 100, "medium").otherwise("low")
    wanted = F.coalesce(F.when(F.col("conv_id") % 7 == 0, "premium"), F.try_element_at(_map({":".join(k): v for k, v in POLICY.items()}), F.concat(F.lit("translate:"), complexity)), F.lit("balanced"))
    place = F.array_position(F.array(*[F.lit(t) for t in TIERS]), wanted).cast("int")
    tier = F.get(F.array(*[F.lit(t) for t in TIERS]), F.when(F.col("conv_id") % 3 == 0, F.greatest(place - 2, F.lit(0))).otherwise(place - 1))
    price = spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "tier string, p_in double, p_out double, p_cached double")  # one row a tier
    cached = F.floor(F.col("input") / 2)
    cost = ((F.col("input") - cached) * F.col("p_in") + F.col("output") * F.col("p_out") + cached * F.col("p_cached")) / 1_000_000
    return g.withColumn("tier", tier).join(F.broadcast(price), "tier", "left").select("conv_id", "tier", (F.col("input") + F.col("output")).alias("tokens"), F.round(cost, 6).alias("cost"))


def pilot_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Jobs, finished and reviewed ones, share of success, sums of the cards and the verdict, as one row."""
    jobs = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(_cards(spark, d), "o_orderkey", "left")
    done, n = F.count_if(F.col("o_orderstatus") == "F"), F.count("*")
    out = jobs.agg(n.alias("jobs"), done.alias("finished"), F.count_if(F.col("verdict") == "REVIEW_REQUIRED").alias("in_review"), F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"), F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("mean_score"))
    rate = F.when(F.col("jobs") > 0, F.round(100 * F.col("finished") / F.col("jobs"), 1)).otherwise(0.0)
    return out.withColumn("success_rate", rate).withColumn("ready", (F.col("critical") == 0) & (rate >= 95))


def quick_score(spark: SparkSession, d: str) -> DataFrame:
    """95 less points for each defect of a job by severity, 50 at least; beside it the form that costs 2 a defect."""
    c = _cards(spark, d)
    return c.select("o_orderkey", F.greatest(F.lit(50), 95 - 20 * F.col("critical") - 10 * F.col("major") - 5 * F.col("minor")).alias("by_severity"), F.greatest(F.lit(50), 95 - 2 * F.col("issues")).alias("flat"))


def worst_severity(spark: SparkSession, d: str) -> DataFrame:
    """Greatest severity of each supplier's defects; one without any has none."""
    rank = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "MAJOR", 2).when(F.col("severity") == "MINOR", 1).otherwise(0)
    g = _defects(spark, d).groupBy("l_suppkey").agg(F.max(F.struct(rank.alias("rank"), "severity")).alias("top"), F.count_if(rank > 0).alias("n"))
    return g.select("l_suppkey", F.when(F.col("n") > 0, F.col("top.severity")).otherwise("NONE").alias("worst"), "n")


def provider_states(spark: SparkSession, d: str) -> DataFrame:
    """Final status of each customer from its jobs' progress: failed, review, done or running."""
    g = table(spark, d, "orders").join(_cards(spark, d).select("o_orderkey", "verdict"), "o_orderkey", "left").groupBy("o_custkey")
    c = g.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "BLOCKED").alias("blocked"), F.count_if(F.col("verdict") == "REVIEW_REQUIRED").alias("review"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    status = F.when(F.col("blocked") == F.col("n"), "failed").when(F.col("blocked") + F.col("review") > 0, "in_review").when(F.col("done") == F.col("n"), "completed").otherwise("processing")
    return c.select("o_custkey", status.alias("status"), "n", "review")


QUERIES = {f.__name__: f for f in (review_needed, issue_summary, pending_reviews, finalisable, next_step, drift_gate, profile_resolution, profile_validation, calibrated_confidence, structural_risk, short_sample_interval, score_delta, segment_model, routed_cost, pilot_readiness, quick_score, worst_severity, provider_states)}

_sev = {"critical": "l_returnflag = 'R' AND l_linestatus = 'F'", "major": "l_returnflag = 'R' AND l_linestatus <> 'F'", "minor": "l_returnflag = 'A'"}
_CARD = "cnt AS (SELECT l_orderkey AS o_orderkey, " + ", ".join(f"count(*) FILTER (WHERE {v}) AS {k}" for k, v in _sev.items()) + " FROM lineitem GROUP BY l_orderkey), card AS (SELECT *, CASE WHEN critical > 0 THEN 'BLOCKED' WHEN major > 0 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS verdict, CASE WHEN critical > 0 THEN 0 ELSE greatest(0, 100 - 15 * major - 5 * minor) END AS score, critical + major + minor AS issues FROM cnt)"
_lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_case = lambda x, m: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
_META = f"meta AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'own_' || p_size END AS explicit, CASE WHEN p_partkey % 3 = 0 THEN upper({_lst(CONTENT_PROFILES)}[p_partkey % {len(CONTENT_PROFILES)} + 1]) END AS content_type, CASE WHEN p_partkey % 4 <> 0 THEN {_lst(ARCHETYPE_PROFILES)}[p_partkey % {len(ARCHETYPE_PROFILES)} + 1] END AS archetype, CASE WHEN p_partkey % 2 = 0 THEN 'tier_a' ELSE 'TIER_B' END AS tier FROM part)"
_num = lambda x: "NULL" if x is None else repr(x)
_CAL = "cal(s, t, mul, dif, med, hi) AS (VALUES " + ", ".join(f"('{s}', '{t}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {_num(v[2])}::DOUBLE, {_num(v[3])}::DOUBLE)" for (s, t), v in CALIBRATIONS.items()) + ")"
_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
ORACLE_SQL = {
    "review_needed": f"WITH {_CARD} SELECT o_orderkey, score FROM card WHERE issues > 0 OR (score < 85 AND score <> 0)",
    "issue_summary": f"WITH {_CARD} SELECT o_orderkey, issues + (score < 85)::INT AS issue_count, issues + (score < 85)::INT > 0 AS needs_review, CASE WHEN score < 85 THEN 'Confidence ' || score || ' is below the review threshold 85.' END AS low_confidence FROM card",
    "pending_reviews": f"WITH {_CARD} SELECT o_custkey, o_orderkey, verdict FROM card JOIN orders USING (o_orderkey) WHERE verdict <> 'PASS'",
    "finalisable": f"WITH {_CARD} SELECT o.o_orderkey, CASE WHEN verdict = 'PASS' THEN true WHEN verdict = 'REVIEW_REQUIRED' THEN o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') ELSE false END AS may_finish FROM orders o LEFT JOIN card ON card.o_orderkey = o.o_orderkey",
    "next_step": f"WITH {_CARD}, r AS (SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 5 AS rounds FROM orders) SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '1%' AND verdict = 'REVIEW_REQUIRED' AND rounds < 3 THEN 'refine' ELSE 'finalize' END AS step FROM r JOIN card USING (o_orderkey)",
    "drift_gate": "SELECT l_orderkey, min(s) AS least, count(s) AS assessed, count(*) FILTER (WHERE s < 70) AS below, count(*) FILTER (WHERE s < 70) > 0 AS review_required FROM (SELECT l_orderkey, CASE WHEN l_tax > 0 THEN CAST(round(100 - l_discount * 500) AS BIGINT) END AS s FROM lineitem) t GROUP BY l_orderkey",
    "profile_resolution": f"WITH {_META} SELECT p_partkey, coalesce(explicit, {_case('lower(content_type)', CONTENT_PROFILES)}, CASE WHEN archetype IN ('OPERATIONAL', 'ANALYTICAL') AND upper(tier) = 'TIER_A' THEN 'smpc_pil' END, {_case('archetype', ARCHETYPE_PROFILES)}, '{DEFAULT_PROFILE}') AS profile FROM meta",
    "profile_validation": f"WITH {_META} SELECT p_partkey, CASE WHEN archetype = 'INFORMATIONAL' AND upper(tier) = 'TIER_A' THEN 'GOVERNANCE' ELSE 'OK' END AS status, CASE WHEN coalesce(archetype, 'SAFETY_CRITICAL') = 'SAFETY_CRITICAL' THEN 'STRICT' END AS numeric_fidelity FROM meta",
    "calibrated_confidence": f"WITH {_CARD}, {_CAL}, dr AS (SELECT l_orderkey AS o_orderkey, sum(CAST(round(l_discount * 100) AS BIGINT)) / (100.0::DOUBLE * count(*)) AS drift FROM lineitem GROUP BY l_orderkey), j AS (SELECT card.*, drift, lower({_lst(_TARGETS)}[o_orderkey % 8 + 1]) AS target FROM card JOIN dr USING (o_orderkey)), p AS (SELECT j.*, CASE WHEN critical > 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100.0 - ((major * 15.0::DOUBLE + minor * 5.0::DOUBLE) * coalesce(mul, 1.0) + CASE WHEN drift > coalesce(hi, 0.15) THEN 25.0::DOUBLE WHEN drift > coalesce(med, 0.05) THEN 10.0 ELSE 0.0 END + coalesce(dif, 0.0))) END AS s FROM j LEFT JOIN cal ON t = target AND cal.s = 'en') SELECT o_orderkey, target, round_even(s, 1) AS score, CASE WHEN s >= 95 THEN 'Very High' WHEN s >= 80 THEN 'High' WHEN s >= 60 THEN 'Medium' WHEN s > 0 THEN 'Low' ELSE 'Blocked' END AS band FROM p",
    "structural_risk": f"SELECT doc_id, least(25, CASE WHEN regexp_matches(text, '{DOSAGE}') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(text, '{FORMULA}') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(text, '{LEGAL}') THEN 5 ELSE 0 END) AS penalty FROM documents",
    "short_sample_interval": "SELECT l_orderkey, round(greatest(0.0, 100.0 - n - m), 1) AS low, round(least(100.0, 100.0 - n + m), 1) AS high FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'N') AS n, least(100.0::DOUBLE / sqrt(greatest(sum(CAST(l_quantity AS BIGINT)), 1)), 50.0) AS m FROM lineitem GROUP BY l_orderkey) t",
    "score_delta": f"WITH {_CARD} SELECT o_orderkey, 100 - 25 * critical - 5 * major - minor AS weighted, score AS plain, 100 - 25 * critical - 5 * major - minor - score AS delta FROM card",
    "segment_model": "SELECT conv_id, turn, CASE WHEN length(text) > 200 OR " + " OR ".join(f"contains(text, '{m}')" for m in MARKERS) + " THEN 'large' ELSE 'small' END AS model FROM conversations",
    "routed_cost": f"WITH g AS (SELECT conv_id, CAST(sum(CASE WHEN role <> 'assistant' THEN {_WORDS} ELSE 0 END) AS BIGINT) AS i, CAST(sum(CASE WHEN role = 'assistant' THEN {_WORDS} ELSE 0 END) AS BIGINT) AS o FROM conversations GROUP BY conv_id), t AS (SELECT *, {_lst(TIERS)}[greatest(1, CASE WHEN conv_id % 7 = 0 OR i > 300 THEN 3 WHEN i > 100 THEN 2 ELSE 1 END - CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END)] AS tier FROM g), pr(tier, a, b, c) AS (VALUES " + ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE)" for k, v in PRICES.items()) + ") SELECT conv_id, tier, i + o AS tokens, round(((i - floor(i / 2.0)::BIGINT) * a + o * b + floor(i / 2.0)::BIGINT * c) / 1000000, 6) AS cost FROM t JOIN pr USING (tier)",
    "pilot_readiness": f"WITH {_CARD} SELECT count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE verdict = 'REVIEW_REQUIRED') AS in_review, CAST(sum(critical) AS BIGINT) AS critical, round(avg(score), 2) AS mean_score, round(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 1) AS success_rate, sum(critical) = 0 AND round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 1) >= 95 AS ready FROM orders LEFT JOIN card USING (o_orderkey)",
    "quick_score": f"WITH {_CARD} SELECT o_orderkey, greatest(50, 95 - 20 * critical - 10 * major - 5 * minor) AS by_severity, greatest(50, 95 - 2 * issues) AS flat FROM card",
    "worst_severity": f"SELECT l_suppkey, CASE WHEN count(*) FILTER (WHERE {_sev['critical']}) > 0 THEN 'CRITICAL' WHEN count(*) FILTER (WHERE {_sev['major']}) > 0 THEN 'MAJOR' WHEN count(*) FILTER (WHERE {_sev['minor']}) > 0 THEN 'MINOR' ELSE 'NONE' END AS worst, count(*) FILTER (WHERE l_returnflag IN ('R', 'A')) AS n FROM lineitem GROUP BY l_suppkey",
    "provider_states": f"WITH {_CARD}, c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE verdict = 'BLOCKED') AS blocked, count(*) FILTER (WHERE verdict = 'REVIEW_REQUIRED') AS review, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders LEFT JOIN card USING (o_orderkey) GROUP BY o_custkey) SELECT o_custkey, CASE WHEN blocked = n THEN 'failed' WHEN blocked + review > 0 THEN 'in_review' WHEN done = n THEN 'completed' ELSE 'processing' END AS status, n, review FROM c",
}
