"""Records as changes: create, patch, toggle and delete rows, and the state as of any version.

A table of changes is only added to. What holds as of a version follows from the changes up to
it, so a version once read stays the same, a batch that is sent again changes nothing, and a deleted
record can be told from one that never was. Changes: key, version, seq, op and the fields.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.sources.tables import table

#: What a change does.
CREATE, PATCH, TOGGLE, DELETE = "create", "patch", "toggle", "delete"
OPS = (CREATE, PATCH, TOGGLE, DELETE)


def checked(changes: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(changes, dead letters): repeated changes once; those that cannot be applied apart, with a reason.

    A change is one (key, version, seq). One that is sent again with the same content counts once;
    one sent again with other content is refused as a conflict, all of it, since no order among its rows is known.
    """
    rows = changes.select("key", "version", "seq", "op", *fields).distinct()
    nothing = functools.reduce(Column.__and__, [F.col(f).isNull() for f in fields])
    alike = Window.partitionBy("key", "version", "seq")
    why = (
        F.when(F.col("key").isNull() | F.col("version").isNull() | F.col("seq").isNull(), "no key or place")
        .when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "unknown operation")
        .when(F.count("*").over(alike) > 1, "conflicting content")
        .when((F.col("op") == PATCH) & nothing, "empty patch")
    )
    told = rows.withColumn("reason", why)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def history(changes: DataFrame) -> DataFrame:
    """Changes with life (which creation of the key they belong to, from 1; 0 before any) and applies.

    A create applies where the key does not live, the others where it does. Only the last create or delete
    before a change counts for that, since a create of a living key and a delete of a dead one do nothing.
    """
    order = Window.partitionBy("key").orderBy("version", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("op") == CREATE, True).when(F.col("op") == DELETE, False)
    lives = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False))
    x = changes.withColumn("applies", F.when(F.col("op") == CREATE, ~lives).otherwise(lives))
    born = (F.col("applies") & (F.col("op") == CREATE)).cast("bigint")
    return x.withColumn("life", F.sum(born).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def as_of(changes: DataFrame, fields: list[str], version: int | Column, deleted: bool = False) -> DataFrame:
    """(key, fields, active, revision, is_deleted) of every record as of a version: its last life.

    A field has the value of the last change that gave one. ``active`` begins true and turns at each
    toggle; revision counts the changes that applied. Deleted records are left out unless asked for.
    """
    upto = history(changes.where(F.col("version") <= version)).where("applies")
    place = F.struct("version", "seq")
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields]
    lives = upto.groupBy("key", "life").agg(*last, (F.count_if(F.col("op") == TOGGLE) % 2 == 0).alias("active"), F.count("*").alias("revision"), (F.count_if(F.col("op") == DELETE) > 0).alias("is_deleted"))
    now = lives.groupBy("key").agg(F.max_by(F.struct(*fields, "active", "revision", "is_deleted"), "life").alias("r")).select("key", "r.*")
    return now if deleted else now.where("not is_deleted")


def merge_terms(terms: DataFrame, fresh: DataFrame, version: int) -> DataFrame:
    """Changes that make ``terms`` (key, target; as of now) hold ``fresh`` (key, target): new keys are created, other targets patched, missing keys deleted."""
    both = terms.select("key", F.col("target").alias("old"), F.lit(True).alias("was")).join(fresh.groupBy("key").agg(F.max("target").alias("new")).withColumn("will", F.lit(True)), "key", "full_outer")
    op = F.when(F.col("was").isNull(), CREATE).when(F.col("will").isNull(), DELETE).when(~F.col("old").eqNullSafe(F.col("new")), PATCH)
    return both.select("key", F.lit(version).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("seq"), op.alias("op"), F.when(op != DELETE, F.col("new")).alias("target")).where("op is not null")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Rule changes out of events: a rule for each user and weekday, a version for each day."""
    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    op = F.when(F.col("event_type") == "signup", CREATE).when(F.col("event_type") == "error", DELETE).when(F.col("event_type") == "purchase", TOGGLE).otherwise(PATCH)
    seen = F.col("event_type").isin("signup", "click")
    return table(spark, d, "events").select((F.col("user_id") * 7 + day % 7).alias("key"), day.cast("bigint").alias("version"), F.col("event_id").alias("seq"), op.alias("op"), F.when(seen, F.col("props")).alias("pattern"), F.when(F.col("event_type").isin("signup", "view"), F.round(F.col("value")).cast("bigint")).alias("priority"))


def rules_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Live rules as of three versions, read from one table of changes to which every batch was sent twice."""
    good, _ = checked(_changes(spark, d).unionByName(_changes(spark, d)), ["pattern", "priority"])
    out = None
    for version in (7, 14, 28):
        one = as_of(good, ["pattern", "priority"], version).select(F.lit(version).alias("version"), "key", "pattern", "priority", "active", "revision")
        out = one if out is None else out.unionByName(one)
    return out


def glossary_merge(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each brand after its first upload is merged with a second one: parts of small sizes, then those of other sizes."""
    part = table(spark, d, "part").select(F.concat_ws(":", "p_brand", F.substring("p_name", 1, 12)).alias("key"), F.col("p_type").alias("target"), "p_size")
    first = merge_terms(part.limit(0).select("key", "target"), part.where("p_size <= 30").select("key", "target"), 1)
    terms = as_of(first, ["target"], 1).select("key", "target")
    second = merge_terms(terms, part.where("p_size > 10").select("key", "target"), 2)
    return as_of(first.unionByName(second), ["target"], 2, deleted=True).select("key", "target", "revision", "is_deleted")


QUERIES = {f.__name__: f for f in (rules_as_of, glossary_merge)}
_AS_OF = """
        SELECT {v} AS version, key, arg_max(pattern, (version, seq)) FILTER (pattern IS NOT NULL) AS pattern, arg_max(priority, (version, seq)) FILTER (priority IS NOT NULL) AS priority, count(*) FILTER (op = 'toggle') % 2 = 0 AS active, count(*) AS revision
        FROM (SELECT *, max(life) OVER (PARTITION BY key) AS newest FROM (
            SELECT *, sum(CASE WHEN applies AND op = 'create' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY version, seq) AS life FROM (
                SELECT *, CASE WHEN op = 'create' THEN NOT lives ELSE lives END AS applies FROM (
                    SELECT *, coalesce(last_value(CASE op WHEN 'create' THEN true WHEN 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY version, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS lives
                    FROM c WHERE version <= {v}
                ) a
            ) b
        ) f WHERE applies) g WHERE life = newest GROUP BY key HAVING count(*) FILTER (op = 'delete') = 0"""
ORACLE_SQL = {
    "rules_as_of": """
        WITH e AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
        c AS (
            SELECT user_id * 7 + day % 7 AS key, day AS version, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'toggle' ELSE 'patch' END AS op,
                CASE WHEN event_type IN ('signup', 'click') THEN props END AS pattern, CASE WHEN event_type IN ('signup', 'view') THEN CAST(round(value) AS BIGINT) END AS priority
            FROM e
        )""" + " UNION ALL ".join(_AS_OF.format(v=v) for v in (7, 14, 28)),
    "glossary_merge": """
        WITH p AS (SELECT p_brand || ':' || substr(p_name, 1, 12) AS key, p_type, p_size FROM part),
        a AS (SELECT key, max(p_type) AS t FROM p WHERE p_size <= 30 GROUP BY key), b AS (SELECT key, max(p_type) AS t FROM p WHERE p_size > 10 GROUP BY key)
        SELECT coalesce(a.key, b.key) AS key, coalesce(b.t, a.t) AS target, CASE WHEN a.key IS NULL OR a.t IS NOT DISTINCT FROM b.t THEN 1 ELSE 2 END AS revision, b.key IS NULL AS is_deleted FROM a FULL JOIN b ON a.key = b.key
    """,
}
