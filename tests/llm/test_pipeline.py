"""The corpus pipeline: what each stage drops and keeps, on planted documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from lexigate.llm import line_dedup
from lexigate.llm._session import cut
from tests.conftest import SMALL


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = docs.where("lang = 'en'").orderBy("doc_id").first()["text"]
    planted = spark.createDataFrame([(10**6, None, "en", "p", 0), (10**6 + 1, "12345 67890", None, "p", 11), (10**6 + 2, clean, "en", "p", 1), (10**6 + 3, f"Before it. {passage} After it.", "en", "p", 1)], docs.schema)
    docs = docs.unionByName(planted)
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, SMALL))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
        assert not ids & {10**6, 10**6 + 1}
        if name == "line_dedup":
            left = docs.where("doc_id = 1000002").first()  # a copy: only its short lines are its own
            assert left is None or all(len(re.findall(r"[\w]+", line)) < line_dedup.MIN_WORDS for line in left["text"].split("\n"))
        if name == "decontamination":
            text = docs.where("doc_id = 1000003").first()["text"]
            assert passage not in text and "Before it" in text and "After it" in text
    assert {"doc_id", "n_tokens", "ids"} <= set(docs.columns)
    assert docs.where("n_tokens <> size(ids)").count() == 0


def test_stages_take_any_rows(spark):
    """Every stage alone: an empty table, null and repeated ids, repeated rows, null and empty texts, columns of clashing names."""
    extra = ["n_removed", "row_", "gone_", "owner_", "h_", "component_id", "kept", "carry", "lang_pred", "score", "spans", "items", "N_Removed_"]
    rows = [(None, "a null id has words too", "en"), (1, None, "en"), (2, "", None), (3, "one two three four five six\nred", "en"), (3, "one two three four five six\nred", "en"), (3, "other words stand in this row", "fr"), (4, "  \n ", "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").select("*", F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), *[F.lit(c).alias(c) for c in extra])
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SMALL)
            found = out.collect()
            if i + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns, name
                assert all(r[c] == c for r in found for c in extra), name
            assert len(found) <= (0 if given is not docs else len(rows)), name
    assert stage(spark, docs, SMALL).count() == len(rows)
