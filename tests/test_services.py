"""Glossaries of pairs, export lines, costs, routing, similarity and export summaries on small tables."""

from __future__ import annotations

import csv
import io
import itertools
import json

import pytest
from pyspark.sql import functions as F

from lexigate.operators import services


def test_terms_of_a_pair(spark):
    langs = ["en", "de", "", None]
    terms = [(i, s, t) for i, (s, t) in enumerate(itertools.product(langs, langs))]
    pairs = [("en", "de"), ("de", "en"), ("fr", "de"), ("en", "de"), ("en", "")]
    got = services.terms_for_pairs(spark.createDataFrame(terms, "id int, source_lang string, target_lang string"), spark.createDataFrame(pairs, "source string, target string")).collect()
    want = [(s, t, i) for s, t in set(pairs) for i, a, b in terms if (a == s or not a) and (b == t or not b)]
    assert sorted((r["source"], r["target"], r["id"]) for r in got) == sorted(want)


def test_export_lines_are_those_of_a_csv_writer(spark):
    rows = [(1, "a", "b", True, ["x", "y"]), (2, 'q"uote', "two\nlines", False, None), (3, "c,omma", None, None, []), (4, " é ", "", True, ['in"ner', "co,mma"])]
    got = {r["term_id"]: r["line"] for r in services.glossary_csv(spark.createDataFrame(rows, "term_id int, source_text string, target_text string, is_forbidden boolean, allowed_variants array<string>")).collect()}
    for row in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow([row[0], row[1], row[2], bool(row[3]), json.dumps(row[4] or [])])
        assert got[row[0]] == out.getvalue()


def test_costs(spark):
    calls = spark.createDataFrame([("p", "a", 1000, 500), ("p", "unknown", 2000, 1000), ("p", None, 0, 0)], "provider string, model string, input_tokens bigint, output_tokens bigint")
    got = {r["model"]: round(r["cost"], 9) for r in services.call_costs(calls, spark.createDataFrame([("a", 0.5, 2.0)], "model string, rate_in double, rate_out double")).collect()}
    assert got == {"a": 1.5, "unknown": 0.05, None: 0.0}
    assert [r[0] for r in spark.createDataFrame([("abcdefg",), ("日本語日本",), ("",), (None,)], "t string").select(services.estimated_tokens(F.col("t"))).collect()] == [1, 1, 0, 0]


def test_routing(spark):
    rows = [
        (1, 1, "ADMIN", True, {"translate:low": "premium"}), (1, 2, "ADMIN", True, {"translate:low": "economy", "judge:high": "balanced"}), (1, 3, "REVIEWER", True, {"translate:low": "premium"}), (1, 4, "ADMIN", True, {"translate:odd": "premium"}),
        (2, 1, "PROJECT_MANAGER", False, {"translate:low": "premium"}), (3, 1, "ADMIN", True, {"translate:low": "gold"}), (4, 1, "ADMIN", True, None), (5, 1, None, True, {}),
    ]
    good, bad = services.checked_policies(spark.createDataFrame(rows, "org_id int, at int, role string, enabled boolean, overrides map<string,string>"))
    assert sorted((r["org_id"], r["at"], r["reason"]) for r in bad.collect()) == [(1, 3, "no permission"), (1, 4, "unknown key"), (3, 1, "unknown tier"), (5, 1, "no permission")]
    calls = spark.createDataFrame([(o, t, c) for o in (1, 2, 4, 9) for t, c in (("translate", "low"), ("judge", "high"), ("repair", "low"))], "org_id int, task string, complexity string")
    got = {(r["org_id"], r["task"]): r["tier"] for r in services.routed(calls, good, {"translate:low": "premium", "judge:high": "premium"}).collect()}
    assert got == {(1, "translate"): "economy", (1, "judge"): "balanced", (1, "repair"): "balanced"} | {(o, t): x for o in (2, 4, 9) for t, x in (("translate", "premium"), ("judge", "premium"), ("repair", "balanced"))}


def test_similarity_of_back_translations(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], []), ([float("nan")], [1.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(services.back_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [100.0, 0.0] and got[2] == pytest.approx(70.710678) and got[3:] == [None] * 5


def test_export_summary(spark):
    rows = [(1, 1, "BODY", "FIT", True, False), (1, 2, "BODY", "ESCALATE", None, None), (1, 3, "TITLE", None, False, True), (2, 1, None, None, None, None)]
    got = {r["export_id"]: r.asDict() for r in services.export_summaries(spark.createDataFrame(rows, "export_id int, block_id int, class string, strategy string, font_substituted boolean, overflow boolean")).collect()}
    assert got[1] == {"export_id": 1, "blocks": 3, "font_substitutions": 1, "degraded_blocks": [2, 3], "by_class": {"BODY": 2, "TITLE": 1}, "by_strategy": {"ESCALATE": 1, "FIT": 1}, "degraded": True}
    assert got[2] == {"export_id": 2, "blocks": 1, "font_substitutions": 0, "degraded_blocks": [], "by_class": None, "by_strategy": None, "degraded": False}
