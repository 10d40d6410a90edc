"""Hashes of payloads, settings and outputs, over canonical JSON."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigate.functions.canonical import SPACED, canonical, dumps
from lexigate.sources.tables import table


def hashed(rows: DataFrame, payload: str, ascii: bool = False) -> DataFrame:
    """``rows`` with payload_hash (SHA-256 of the canonical payload; null where it is refused or null) and reason."""
    x = rows.withColumn("canonical_", canonical(F.col(payload), ascii))
    return x.select(*rows.columns, F.sha2(F.col("canonical_.json"), 256).alias("payload_hash"), F.col("canonical_.reason").alias("reason"))


def _digest(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, sha, n = None, None, 0

        def end(out: list) -> None:
            sha.update(b"]")
            out.append((job, n, sha.hexdigest()))

        def pack(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in ((0, kind), (1, pa.int64()), (2, pa.string()))], ["job_id", "n_segments", "output_hash"])

        for batch in batches:
            out: list[tuple] = []
            for j, order, segment, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sha is None or j != job:
                    if sha is not None:
                        end(out)
                    job, sha, n = j, hashlib.sha256(b"["), 0
                if segment is not None:
                    sha.update((", " * (n > 0) + dumps({"order": order, "id": segment, "text": text or ""}, separators=SPACED)).encode())
                    n += 1
            yield pack(out)
        if sha is not None:
            out = []
            end(out)
            yield pack(out)

    return run


def output_hashes(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """(job_id, n_segments, output_hash): SHA-256 over the JSON list of each job's segments, by order and id.

    Jobs: job_id. Segments: job_id, position, segment_id, text; null texts are empty, null ids are the empty
    string, null positions come first and are written as null. A job without segments hashes the empty list. A
    job's segments pass one task as a stream, since the digest is sequential.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    none = jobs.select("job_id", F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("string").alias("segment_id"), F.lit(None).cast("string").alias("text"))
    own = segments.select("job_id", F.col("position").cast("bigint"), F.coalesce(F.col("segment_id").cast("string"), F.lit("")).alias("segment_id"), F.col("text").cast("string"))
    rows = none.unionByName(own).repartition("job_id").sortWithinPartitions("job_id", "position", "segment_id", "text")
    kind = rows.schema["job_id"].dataType
    return rows.mapInArrow(_digest(to_arrow_type(kind)), f"job_id {kind.simpleString()}, n_segments bigint, output_hash string")


def payload_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Payload hash of every event, written with its keys in either order; both must agree."""
    e = table(spark, d, "events")
    one = F.to_json(F.struct(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type")).alias("who"), "event_id", "props"))
    two = F.to_json(F.struct("props", "event_id", F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")).alias("who")))
    first = hashed(e.select("event_id", one.alias("a"), F.concat(F.lit(" "), two).alias("b")), "a").withColumnsRenamed({"payload_hash": "hash_a", "reason": "reason_a"})
    return hashed(first, "b").select("event_id", F.col("payload_hash"), (F.col("hash_a") == F.col("payload_hash")).alias("agree"))


def config_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the settings of each region: its nations with their numbers of customers, as ASCII."""
    per = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    n = table(spark, d, "nation").join(per, "n_nationkey", "left").fillna(0, ["customers"])
    one = F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", "customers")), asc=False))
    config = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.struct(F.lit(1).alias("version"), one.alias("nations"))).alias("config"))
    return hashed(config, "config", ascii=True).select("region", F.col("payload_hash").alias("config_hash"))


def document_output_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Output hash of every document over its lines; a null text has none."""
    docs = table(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n", -1)).alias("position", "text"))
    return output_hashes(docs.select(F.col("doc_id").alias("job_id")).distinct(), lines.withColumn("segment_id", F.concat_ws("_seg_", "job_id", "position")))


QUERIES = {f.__name__: f for f in (payload_hashes, config_hashes, document_output_hashes)}
ORACLE_SQL = {
    "payload_hashes": """SELECT event_id, sha256('{"event_id":' || event_id || CASE WHEN props IS NULL THEN '' ELSE ',"props":' || to_json(props) END || ',"who":{"type":"' || event_type || '","user":' || user_id || '}}') AS payload_hash, true AS agree FROM events""",
    "config_hashes": """
        WITH n AS (SELECT n_regionkey, n_name, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
        SELECT n_regionkey AS region, sha256('{"nations":{' || string_agg('"' || n_name || '":' || c, ',' ORDER BY n_name) || '},"version":1}') AS config_hash FROM n GROUP BY n_regionkey
    """,
    "document_output_hashes": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        s AS (SELECT doc_id, count(*) AS n, string_agg('{"id": "' || doc_id || '_seg_' || i || '", "order": ' || i || ', "text": ' || to_json(line) || '}', ', ' ORDER BY i) AS j FROM l GROUP BY doc_id)
        SELECT d.doc_id AS job_id, coalesce(n, 0) AS n_segments, sha256('[' || coalesce(j, '') || ']') AS output_hash FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s ON s.doc_id = d.doc_id
    """,
}
