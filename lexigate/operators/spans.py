"""Spans of several judges over the same segments: which overlap, and what they add up to.

Overlaps are found by an equi-join on bins. A span of length up to 2**j is of level j and touches
at most two bins of that width; the shorter span of a pair is looked up in the bins of the longer
one's level. So a span gives at most two rows a level, whatever its length, and a segment that
holds most spans is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.sources.tables import table

#: Severities by rank.
SEVERITIES = ("NEUTRAL", "MINOR", "MAJOR", "CRITICAL")


def _level(length: Column) -> Column:
    """Least j with length <= 2**j."""
    return F.length(F.bin(length - 1)) * (length > 1).cast("int")


def _bins(spans: DataFrame, level: Column) -> DataFrame:
    """Spans with level_ and bin_, one row for each of the bins of that width that they touch."""
    x = spans.withColumn("level_", level)
    width = F.expr("shiftleft(1L, level_)")
    low, high = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    return x.withColumn("first_", low).withColumn("bin_", F.explode(F.sequence(low, high)))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(segment, l, r): every pair of a left and a right span of one segment that overlap.

    Spans: segment, start, end (exclusive) and other columns, which l and r hold as structs. Empty and
    null spans, and those without a segment, overlap nothing. Each pair comes once: of the bins that two
    spans share, the first counts.
    """
    some = "segment is not null and start < `end`"
    pack = lambda x: x.where(some).select("segment", "start", "end", F.struct(*[c for c in x.columns if c != "segment"]).alias("own"), _level(F.col("end") - F.col("start")).alias("level"))
    a, b = pack(left), pack(right)
    top = lambda x: x.agg(F.max("level")).first()[0] or 0
    highest = max(top(a), top(b))

    def meet(long: DataFrame, short: DataFrame, longer: Column, names: tuple[str, str]) -> DataFrame:
        x = _bins(long, F.col("level")).select("segment", "level_", "bin_", F.col("first_").alias("first_x"), F.col("start").alias("start_x"), F.col("end").alias("end_x"), F.col("own").alias(names[0]))
        up = short.withColumn("up", F.explode(F.sequence(F.col("level"), F.lit(highest))))
        y = _bins(up, F.col("up")).select("segment", "level_", "bin_", "level", F.col("first_").alias("first_y"), F.col("start").alias("start_y"), F.col("end").alias("end_y"), F.col("own").alias(names[1]))
        pairs = x.join(y, ["segment", "level_", "bin_"]).where(longer & (F.col("start_x") < F.col("end_y")) & (F.col("start_y") < F.col("end_x")) & (F.col("bin_") == F.greatest("first_x", "first_y")))
        return pairs.select("segment", "l", "r")

    return meet(a, b, F.lit(True), ("l", "r")).unionByName(meet(b, a, F.col("level") < F.col("level_"), ("r", "l")))


def islands(spans: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``spans`` with island: the start of the run of overlapping spans (the component of overlaps) that each belongs to.

    Spans that only touch are apart; empty spans and those without a segment have no island. A segment is cut
    into ranges of ``width``: the farthest end, and then the last start of an island, are carried from range
    to range by one row each, so that no task orders a whole segment.
    """
    x = spans.withColumn("range_", F.when((F.col("start") < F.col("end")) & F.col("segment").isNotNull(), F.floor(F.col("start") / width)))
    good = x.where("range_ is not null")
    before = Window.partitionBy("segment", "range_").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("segment", "range_").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal starts count
    ranges = Window.partitionBy("segment").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    far = good.groupBy("segment", "range_").agg(F.max("end").alias("far_")).select("segment", "range_", F.max("far_").over(ranges).alias("far_"))
    seen = good.join(far, ["segment", "range_"]).withColumn("far_", F.greatest(F.col("far_"), F.max("end").over(before)))
    opened = seen.withColumn("open_", F.when(F.col("far_").isNull() | (F.col("far_") <= F.col("start")), F.col("start"))).drop("far_")
    last = opened.groupBy("segment", "range_").agg(F.max("open_").alias("last_")).select("segment", "range_", F.max("last_").over(ranges).alias("last_"))
    found = opened.join(last, ["segment", "range_"]).withColumn("island", F.coalesce(F.max("open_").over(upto), "last_"))
    none = x.where("range_ is null").withColumn("island", F.lit(None).cast(found.schema["island"].dataType))
    return found.select(*spans.columns, "island").unionByName(none.select(*spans.columns, "island"))


def merged(spans: DataFrame) -> DataFrame:
    """One row for each island: segment, island, spans, judges, the most severe severity, and whether the judges disagree.

    Spans: segment, start, end, judge, severity. Judges disagree where one of them has no span in the
    island or another worst severity; an unknown severity counts as NEUTRAL. Severities are never averaged.
    """
    rank = F.coalesce(F.try_subtract(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")), F.lit(1)), F.lit(0))
    judges = spans.select("judge").distinct().agg(F.count("judge").alias("panel"))
    each = islands(spans.withColumn("rank", F.greatest(rank, F.lit(0)))).where("island is not null").groupBy("segment", "island", "judge").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    group = each.groupBy("segment", "island").agg(F.sum("n").alias("spans"), F.count("judge").alias("judges"), F.max("rank").alias("worst"), F.min("rank").alias("mildest"))
    out = group.join(F.broadcast(judges))
    return out.select("segment", "island", "spans", "judges", F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("worst").cast("int")).alias("severity"), ((F.col("judges") < F.col("panel")) | (F.col("worst") != F.col("mildest"))).alias("disagree"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Spans of three judges on the time line of each supplier: line items by day, for as many days as their quantity."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    rank = F.when(F.col("l_returnflag") == "R", "CRITICAL").when(F.col("l_returnflag") == "A", "MAJOR").otherwise("MINOR")
    return table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_suppkey").alias("segment"), day.cast("bigint").alias("start"), (day + F.ceil(F.col("l_quantity") / 8)).cast("bigint").alias("end"), F.col("l_linenumber").alias("judge"), rank.alias("severity"), "l_orderkey")


def span_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """For every two judges and segment: overlapping pairs of spans, those of equal severity, and the days shared."""
    s = _judged(spark, d)
    pairs = overlaps(s, s).where("l.judge < r.judge")
    shared = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    return pairs.groupBy("segment", F.col("l.judge").alias("judge_a"), F.col("r.judge").alias("judge_b")).agg(F.count("*").alias("pairs"), F.count_if(F.col("l.severity") == F.col("r.severity")).alias("agreeing"), F.sum(shared).alias("days"))


def ensemble_merge(spark: SparkSession, d: str) -> DataFrame:
    """Merged annotations of the three judges, and where they disagree."""
    return merged(_judged(spark, d))


QUERIES = {f.__name__: f for f in (span_overlaps, ensemble_merge)}
_SPANS = "s AS (SELECT l_suppkey AS segment, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS start, start + CAST(ceil(l_quantity / 8) AS BIGINT) AS stop, l_linenumber AS judge, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS rank FROM lineitem WHERE l_linenumber <= 3)"
ORACLE_SQL = {
    "span_overlaps": f"WITH {_SPANS} SELECT a.segment, a.judge AS judge_a, b.judge AS judge_b, count(*) AS pairs, count(*) FILTER (a.rank = b.rank) AS agreeing, CAST(sum(least(a.stop, b.stop) - greatest(a.start, b.start)) AS BIGINT) AS days FROM s a JOIN s b ON a.segment = b.segment AND a.judge < b.judge AND a.start < b.stop AND b.start < a.stop WHERE a.start < a.stop AND b.start < b.stop GROUP BY ALL",
    "ensemble_merge": f"""
        WITH {_SPANS},
        f AS (SELECT *, max(stop) OVER (PARTITION BY segment ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s WHERE start < stop),
        i AS (SELECT *, max(CASE WHEN far IS NULL OR far <= start THEN start END) OVER (PARTITION BY segment ORDER BY start) AS island FROM f),
        e AS (SELECT segment, island, judge, max(rank) AS rank, count(*) AS n FROM i GROUP BY ALL)
        SELECT segment, island, CAST(sum(n) AS BIGINT) AS spans, count(*) AS judges, ['NEUTRAL', 'MINOR', 'MAJOR', 'CRITICAL'][max(rank) + 1] AS severity, count(*) < (SELECT count(DISTINCT judge) FROM s) OR max(rank) <> min(rank) AS disagree FROM e GROUP BY segment, island
    """,
}
