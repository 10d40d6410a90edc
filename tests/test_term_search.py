"""Terms, glossaries and rules against plain nested loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lexigate.operators import planted_gates, term_search
from lexigate.sources.tables import table
from tests.conftest import SMALL


def by_hand(text: str, term: str, bounded: bool = True, folded: bool = True) -> list[tuple[int, int]]:
    low, key = (text.lower(), term.lower()) if folded else (text, term)
    found = [i for i in range(len(low) - len(key) + 1) if low.startswith(key, i)]
    word = lambda c: c.isalnum() or c == "_"
    if bounded and key[0].isalnum() and key[-1].isalnum():
        found = [i for i in found if not (i and word(low[i - 1])) and not (i + len(key) < len(low) and word(low[i + len(key)]))]
    return [(i, i + len(key)) for i in found]


#: Symbols at either edge, terms in one another, a phrase, letters of other scripts, terms that differ in case only.
TERMS = ["ace", "+abc", "%", "abc", "a", "aa", "a a", "Ünï", "日本", "e.g.", "[x]", "ABC", "c++", "_id"]


@pytest.fixture(scope="module")
def texts():
    random.seed(7)
    pool = ["ace", "surface", "+abc", "+abcd", "50%", "% ", "aaa", " ", "a ", "A", "ÜNÏ", "日本語", "e.g. ", "[x]", "C++", "_id", "x_id", "."]
    return [None, "", "dose +abcd", "50%", "the ace of aces", "surface"] + ["".join(random.choice(pool) for _ in range(random.randrange(20))) for _ in range(300)]


@pytest.mark.parametrize("size", [1 << 20, 20])
@pytest.mark.parametrize(("folded", "bounded"), [(True, True), (True, False), (False, False)])
def test_every_occurrence_of_every_term(spark, texts, monkeypatch, size, folded, bounded):
    """One slice of terms or many, small batches of hits."""
    monkeypatch.setattr(term_search, "SLICE", size)
    monkeypatch.setattr(term_search, "ROWS", 50)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string").select("*", F.lit("x").alias("term"), F.lit(1).alias("key"))
    terms = spark.createDataFrame([(t,) for t in [*TERMS, TERMS[0], "", None]], "term string")
    got = sorted(tuple(r) for r in term_search.find_terms(docs, terms, folded=folded, bounded=bounded).collect())
    assert got == sorted((i, t, *at) for i, x in enumerate(texts) if x for t in TERMS for at in by_hand(x, t, bounded, folded))


def test_places_hold_where_case_changes_length(spark):
    docs = spark.createDataFrame([(1, "İİ ace İ")], "doc_id bigint, text string")
    assert [tuple(r) for r in term_search.find_terms(docs, spark.createDataFrame([("ACE",)], "term string")).collect()] == [(1, "ACE", 3, 6)]


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("a",)], "term string")
    assert term_search.find_terms(docs, terms.limit(0)).collect() == [] and term_search.find_terms(docs.limit(0), terms).collect() == []


def test_forbidden_terms_with_symbols(spark):
    docs = spark.createDataFrame([(1, "dose +abcd"), (2, "50%"), (3, "surface"), (4, "an Ace."), (4, "an ace")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("+abc",), ("%",), ("ace",)], "term string")
    assert sorted(map(tuple, planted_gates.forbidden_terms(docs, terms).collect())) == [(1, "+abc"), (2, "%"), (4, "ace")]


def test_ten_times_the_documents_give_ten_times_the_hits(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    terms = term_search._term_table(spark, SMALL)
    once = term_search.find_terms(docs, terms)
    many = docs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("doc_id", F.col("doc_id") * 10 + F.col("copy")).repartition(7)
    ten = term_search.find_terms(many, terms).withColumn("doc_id", F.floor(F.col("doc_id") / 10))
    want = {(r["doc_id"], r["term"]): r["count"] * 10 for r in once.groupBy("doc_id", "term").count().collect()}
    assert want and {(r["doc_id"], r["term"]): r["count"] for r in ten.groupBy("doc_id", "term").count().collect()} == want


def test_glossary(spark):
    pairs = spark.createDataFrame([(1, "the dose is", "die Dosis"), (2, "the dose", "der Wert"), (3, "dose and value", None), (4, "Dose", "x"), (5, None, "x")], "pair_id bigint, source string, target string")
    glossary = spark.createDataFrame([("dose", "Dosis", True), ("dose", "Dosis", False), ("value", "Wert", False), ("value", "", True), (None, "x", True)], "src string, tgt string, locked boolean")
    got = sorted(map(tuple, term_search.glossary_findings(pairs, glossary).collect()))
    assert got == [(2, "dose", "Dosis", "CRITICAL"), (3, "dose", "Dosis", "CRITICAL"), (3, "value", "Wert", "MAJOR")]


def test_rules(spark):
    pairs = [(1, "aaa Aa", "right"), (2, "x.y x,y", None), (3, None, "right"), (4, "aa", "RIGHT here")]
    rules = [(10, "aa", "right", False), (11, r"x[.,]y", "z", True), (12, "a", "", False), (13, "(", "q", True), (14, "", "q", False), (15, "AA", "wrong", None)]
    p, r = spark.createDataFrame(pairs, "pair_id bigint, source string, target string"), spark.createDataFrame(rules, "rule_id bigint, pattern string, correction string, is_regex boolean")
    want = []
    for i, source, target in pairs:
        for rule, pattern, correction, regex in rules:
            if not pattern or not source or rule == 13:
                continue
            at = [m.span() for m in re.finditer(pattern, source, re.I)] if regex else by_hand(source, pattern, False)
            want += [(i, rule, *x, correction.lower() not in (target or "").lower()) for x in at]
    assert sorted(map(tuple, term_search.rule_hits(p, r).collect())) == sorted(want)
    assert sorted((x["rule_id"], x["reason"].split(":")[0]) for x in term_search.rejected_rules(r).collect()) == [(13, "invalid regex"), (14, "empty pattern")]


def test_regexes_are_tried_where_their_letters_stand(spark):
    """The same matches as a scan with every pattern, for patterns with and without letters at the front."""
    import re

    from lexigate.operators.term_search import _lead, rule_hits

    assert [_lead(p) for p in ("ab[,.]", "ab*", "ab?c", "a|b", "[ab]", "éa", "ab+", "a{2}")] == ["ab", "a", "a", "", "", "", "ab", ""]
    patterns = ["ab[,.]", "aba", "ab*", "ab?c", "a|b", r"\bab\b", "k.", "éa", "a{2}", "AB\\s"]
    texts = ["abababa, AB. abc ac", "aaaa bb éA ÉA", "K. ſk! İab,", "", None]
    rules = spark.createDataFrame([(i, p, "", True) for i, p in enumerate(patterns)], "rule_id bigint, pattern string, correction string, is_regex boolean")
    pairs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "pair_id bigint, source string, target string")
    want = {(i, j, m.start(), m.end()) for i, t in enumerate(texts) for j, p in enumerate(patterns) for m in re.finditer(p, t or "", re.IGNORECASE)}
    got = [tuple(r)[:4] for r in rule_hits(pairs, rules).select("pair_id", "rule_id", "start", "end").collect()]
    assert set(got) == want and len(got) == len(want)
