"""Golden suites: cases out of files, run through the gates, with what failed and what was rejected."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigate.functions import gates
from lexigate.sources.datasets import read_cases
from lexigate.sources.tables import table

#: Cases in one JSON file.
FILE = 100
CRITICAL = "CRITICAL"


def run_suites(cases: DataFrame) -> DataFrame:
    """(suite, case_id, kind, missed, passed) of cases with input.source, input.target, input.kind and expected.critical.

    A canonical case passes where the gates give no critical finding, a tampered one where every
    expected critical category is found, others may be there too. A case of another kind passes.
    """
    get = lambda c, p: F.get_json_object(F.col(c), p)
    x = cases.select("suite", "case_id", get("input", "$.source").alias("source"), get("input", "$.target").alias("target"), get("input", "$.kind").alias("kind"), F.from_json(F.coalesce(get("expected", "$.critical"), F.lit("[]")), "array<string>").alias("expected"))
    source, target = F.coalesce("source", F.lit("")), F.coalesce("target", F.lit(""))
    found = F.concat(gates.numbers(source, target), gates.symbols(source, target), gates.units(source, target), gates.placeholders(source, target), gates.pii(target), gates.coverage(source, target))
    critical = F.array_distinct(F.transform(F.filter(found, lambda d: gates.severity(d["message"]) == CRITICAL), lambda d: d["category"]))
    x = x.withColumn("critical", critical)
    missed = F.when(F.col("kind") == "canonical", F.col("critical")).when(F.col("kind") == "tampered", F.array_except("expected", "critical")).otherwise(F.array().cast("array<string>"))
    return x.select("suite", "case_id", "kind", F.array_join(F.array_sort(missed), ",").alias("missed"), (F.size(missed) == 0).alias("passed"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """A case for each document: its text with a number behind it, and a copy as it is or with other digits."""
    source = F.concat(F.coalesce("text", F.lit("")), F.lit(" room 12"))
    kind = F.when(F.col("doc_id") % 2 == 0, "canonical").otherwise("tampered")
    target = F.when(F.col("doc_id") % 2 == 0, source).otherwise(F.translate(source, "0123456789", "1234567890"))
    given = F.struct(source.alias("source"), target.alias("target"), kind.alias("kind"))
    expected = F.struct(F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("NUMERIC_MISMATCH"))).otherwise(F.array().cast("array<string>")).alias("critical"))
    return table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.col("doc_id").cast("string").alias("id"), given.alias("input"), expected.alias("expected"))


def golden_files(spark: SparkSession, d: str) -> DataFrame:
    """Golden cases written as JSON, JSON lines (every tenth line broken) and CSV, read again and run: counts by form and kind."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{folder.rstrip('/')}/lexigate-suites-{uuid.uuid4().hex}"
    cases = _cases(spark, d)
    line = F.to_json(F.struct("id", "input", "expected"))
    cases.where("doc_id % 3 = 0").select(F.when(F.col("doc_id") % 10 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(f"{folder}/lines")
    per = cases.where("doc_id % 3 = 1").groupBy(F.floor(F.col("doc_id") / FILE).alias("n")).agg(F.array_join(F.collect_list(line), ",\n").alias("all"))
    per.select(F.concat(F.lit('{"metadata": {"name": "whole"}, "cases": ['), "all", F.lit("]}")).alias("value"), F.col("n").cast("string").alias("file")).write.partitionBy("file").text(f"{folder}/whole")
    cases.where("doc_id % 3 = 2").select("id", F.to_json("input").alias("input"), F.to_json("expected").alias("expected")).write.option("escape", '"').csv(f"{folder}/table", header=True)
    out = None
    for form, name in (("jsonl", "lines"), ("json", "whole"), ("csv", "table")):
        read = read_cases(spark, f"{folder}/{name}", form, "part-*")
        ran = run_suites(read.where("reason is null")).groupBy("kind").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))
        lost = read.where("reason is not null").groupBy(F.lit("rejected").alias("kind")).agg(F.count("*").alias("cases"), F.lit(0).cast("bigint").alias("passed"))
        both = ran.unionByName(lost).select(F.lit(form).alias("form"), "kind", "cases", "passed")
        out = both if out is None else out.unionByName(both)
    return out


QUERIES = {"golden_files": golden_files}
_UNIT = "|".join(gates.UNITS)
ORACLE_SQL = {
    "golden_files": r"""
        WITH c AS (
            SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'jsonl' WHEN 1 THEN 'json' ELSE 'csv' END AS form, doc_id % 3 = 0 AND doc_id % 10 = 0 AS broken, doc_id % 2 = 1 AS tampered, coalesce(text, '') || ' room 12' AS source,
                translate(coalesce(text, '') || ' room 12', '0123456789', '1234567890') AS target
            FROM documents
        ),
        n AS (SELECT doc_id, target, unnest(regexp_extract_all(source, '[0-9]+(?:[.,][0-9]+)?')) AS n FROM c WHERE tampered),
        l AS (SELECT DISTINCT doc_id FROM n WHERE NOT regexp_matches(target, '(^|[^0-9])' || regexp_replace(n, '[.,]', '[.,]', 'g') || '($|[^0-9])')),
        u AS (SELECT doc_id, source, unnest(list_zip(regexp_extract_all(source, $U$, 1, 'i'), regexp_extract_all(source, $U$, 2, 'i'))) AS z FROM c WHERE NOT tampered),
        p AS (
            SELECT doc_id FROM c WHERE NOT tampered AND (regexp_matches(source, $P$) OR regexp_matches(source, '\[\[PII|<EMAIL|<PHONE'))
            UNION SELECT doc_id FROM u WHERE NOT regexp_matches(lower(source), replace(z[1], '.', '[.,]') || '\s*' || z[2])
        )
        SELECT form, CASE WHEN broken THEN 'rejected' WHEN tampered THEN 'tampered' ELSE 'canonical' END AS kind, count(*) AS cases,
            count(*) FILTER (NOT broken AND CASE WHEN tampered THEN doc_id IN (FROM l) ELSE doc_id NOT IN (FROM p) END) AS passed
        FROM c GROUP BY 1, 2
    """.replace("$U$", rf"'([0-9]+(?:[.,][0-9]+)?)\s*({_UNIT})\b'").replace("$P$", "'" + "|".join(f"(?:{v})" for v in gates.PII_SHAPES.values()).replace("'", "''") + "'"),
}
