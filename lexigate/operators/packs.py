"""The constraint pack of a job: its glossary, what is forbidden, the rules of its organisation, and stored translations near to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigate.operators.documents import nearest
from lexigate.sources.tables import table

#: Stored translations of a job, and how near (L2) they must be.
MATCHES, WITHIN = 3, 0.5
TERM = "array<struct<term_id: bigint, source: string, target: string>>"
RULE = "array<struct<rule_id: bigint, pattern: string, correction: string, is_strict: boolean>>"


def latest_active(glossaries: DataFrame) -> DataFrame:
    """(glossary_id, version): the greatest version, as text, of each glossary among its active ones."""
    return glossaries.where("is_active").groupBy("glossary_id").agg(F.max("version").alias("version"))


def glossary_packs(glossaries: DataFrame, terms: DataFrame) -> DataFrame:
    """(glossary_id, version, glossary, forbidden) of the latest active version; a forbidden term's target counts, else its source."""
    own = latest_active(glossaries).join(terms, ["glossary_id", "version"], "left")
    term = F.when(~F.coalesce("is_forbidden", F.lit(False)) & F.col("term_id").isNotNull(), F.struct("term_id", "source", "target"))
    word = F.when(F.col("is_forbidden"), F.when(F.coalesce("target", F.lit("")) != "", F.col("target")).otherwise(F.col("source")))
    return own.groupBy("glossary_id", "version").agg(F.array_sort(F.collect_list(term)).alias("glossary"), F.array_sort(F.collect_set(word)).alias("forbidden"))


def constraint_packs(jobs: DataFrame, glossaries: DataFrame, terms: DataFrame, rules: DataFrame, memory: DataFrame, within: float = WITHIN) -> DataFrame:
    """One row for each job: job_id, version, glossary, forbidden, rules, matches.

    Jobs: job_id (distinct), org_id, glossary_id, pair, embedding. Glossaries: glossary_id, version, is_active.
    Terms: glossary_id, version, term_id, source, target, is_forbidden. Rules: org_id, rule_id, pattern, correction,
    is_strict, status. Memory: vec_id, pair, embedding, source, target. A job without a glossary, or one whose
    versions are all inactive, has no terms; only ACTIVE rules count, highest priority being left to the caller.
    Matches are the MATCHES nearest stored texts of the job's language pair that lie nearer than ``within``,
    nearest first; a job without a vector has none, and a memory row of the job's own id counts.

    Lists are packed once for a glossary and an organisation, not for each job, and reach the jobs by joins
    on those keys; the memory is searched in blocks of jobs, of which each task sends on its best only.
    """
    packed = glossary_packs(glossaries, terms)
    own = rules.where("status = 'ACTIVE'").groupBy("org_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "pattern", "correction", "is_strict"))).alias("rules"))
    asked = jobs.select((-F.col("job_id") - 1).alias("vec_id"), "pair", "embedding")  # ids that no stored text has
    near = nearest(memory, asked, MATCHES, by="pair").where(F.col("distance") < within * within)
    texts = near.join(memory.select("vec_id", "source", "target"), "vec_id")
    match = F.struct("place", "vec_id", "source", "target", F.round(F.sqrt("distance"), 4).alias("distance"))
    matches = texts.groupBy((-F.col("q") - 1).alias("job_id")).agg(F.array_sort(F.collect_list(match)).alias("matches"))
    out = jobs.select("job_id", "org_id", "glossary_id").join(packed, "glossary_id", "left").join(own, "org_id", "left").join(matches, "job_id", "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return out.select("job_id", "version", none("glossary", TERM), none("forbidden", "array<string>"), none("rules", RULE), none("matches", matches.schema["matches"].dataType))


def _digest(items: str, line) -> Column:
    return F.sha2(F.array_join(F.transform(items, line), "|"), 256)


def constraint_pack(spark: SparkSession, d: str) -> DataFrame:
    """Packs of all vectors whose id is divisible by 20 as jobs: sizes, digests of their lists, and the matches.

    Brands of parts are glossaries, sizes their versions; suppliers are rules of organisations.
    """
    e, part = table(spark, d, "embeddings"), table(spark, d, "part")
    brand = F.concat(F.lit("Brand#"), (F.floor(F.col("vec_id") / 20) % 5 + 1).cast("string"), (F.floor(F.col("vec_id") / 100) % 6 + 1).cast("string"))
    jobs = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("job_id"), (F.col("vec_id") % 25).alias("org_id"), brand.alias("glossary_id"), F.col("label").alias("pair"), "embedding")
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"))
    glossaries = part.select(F.col("p_brand").alias("glossary_id"), version.alias("version"), (F.col("p_size") % 3 != 0).alias("is_active")).distinct()
    terms = part.select(F.col("p_brand").alias("glossary_id"), version.alias("version"), F.col("p_partkey").alias("term_id"), F.col("p_name").alias("source"), F.col("p_type").alias("target"), (F.col("p_partkey") % 4 == 0).alias("is_forbidden"))
    s = table(spark, d, "supplier")
    rules = s.select(F.col("s_nationkey").alias("org_id"), F.col("s_suppkey").alias("rule_id"), F.col("s_name").alias("pattern"), F.lower("s_name").alias("correction"), (F.col("s_suppkey") % 2 == 0).alias("is_strict"), F.when(F.col("s_suppkey") % 3 == 0, "PROPOSED").otherwise("ACTIVE").alias("status"))
    memory = e.where("vec_id % 20 <> 0").select("vec_id", F.col("label").alias("pair"), "embedding", F.col("vec_id").cast("string").alias("source"), F.hex("vec_id").alias("target"))
    p = constraint_packs(jobs, glossaries, terms, rules, memory, within=NEAR)
    return p.select(
        "job_id",
        "version",
        F.size("glossary").cast("bigint").alias("n_terms"),
        _digest("glossary", lambda t: F.concat_ws(":", t["term_id"].cast("string"), t["source"], t["target"])).alias("glossary_sha256"),
        F.array_join("forbidden", "|").alias("forbidden"),
        F.size("rules").cast("bigint").alias("n_rules"),
        _digest("rules", lambda r: F.concat_ws(":", r["rule_id"].cast("string"), r["pattern"], r["is_strict"].cast("string"))).alias("rules_sha256"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["vec_id"].cast("string"), m["target"])), "|").alias("matches"),
    )


#: How near a stored vector must be in the registered query, whose vectors lie farther apart than those of texts.
NEAR = 1.35
QUERIES = {"constraint_pack": constraint_pack}
ORACLE_SQL = {
    "constraint_pack": f"""
        WITH j AS (SELECT vec_id AS job_id, vec_id % 25 AS org, 'Brand#' || (vec_id // 20 % 5 + 1) || (vec_id // 100 % 6 + 1) AS g, label, embedding FROM embeddings WHERE vec_id % 20 = 0),
        a AS (SELECT p_brand AS g, max('v' || p_size) AS version FROM part WHERE p_size % 3 <> 0 GROUP BY p_brand),
        t AS (
            SELECT a.g, version, count(*) FILTER (p_partkey % 4 <> 0) AS n, string_agg(p_partkey || ':' || p_name || ':' || p_type, '|' ORDER BY p_partkey) FILTER (p_partkey % 4 <> 0) AS terms,
                array_to_string(list_sort(list_distinct(list(p_type) FILTER (p_partkey % 4 = 0))), '|') AS forbidden
            FROM a JOIN part ON p_brand = a.g AND 'v' || p_size = version GROUP BY a.g, version
        ),
        r AS (SELECT s_nationkey AS org, count(*) AS n, string_agg(s_suppkey || ':' || s_name || ':' || (s_suppkey % 2 = 0), '|' ORDER BY s_suppkey) AS rules FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY s_nationkey),
        u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
        p AS (SELECT q.vec_id AS q, e.vec_id, round(sum((q.v - e.v) * (q.v - e.v)), 6) AS distance FROM u q JOIN u e ON q.label = e.label AND q.i = e.i WHERE q.vec_id % 20 = 0 AND e.vec_id % 20 <> 0 GROUP BY q.vec_id, e.vec_id),
        m AS (SELECT q, string_agg(vec_id || ':' || printf('%X', vec_id), '|' ORDER BY distance, vec_id) AS matches FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS k FROM p) x WHERE k <= {MATCHES} AND distance < {NEAR * NEAR} GROUP BY q)
        SELECT job_id, version, coalesce(t.n, 0) AS n_terms, sha256(coalesce(terms, '')) AS glossary_sha256, coalesce(forbidden, '') AS forbidden, coalesce(r.n, 0) AS n_rules, sha256(coalesce(rules, '')) AS rules_sha256, coalesce(matches, '') AS matches
        FROM j LEFT JOIN t ON t.g = j.g LEFT JOIN r ON r.org = j.org LEFT JOIN m ON m.q = job_id
    """
}
