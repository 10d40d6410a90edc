"""Text functions and gates on planted rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigate.functions import text as X
from lexigate.functions.gates import PII_SHAPES
from lexigate.operators import text_queries as Q


def _apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def _pairs(spark, fn, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"), F.col("t"))).collect()]


def test_sentences(spark):
    values = ["Dr. Smith said hi. He left.", "Take 5.5 mg. daily. Stop! Now?", "Made by Acme Co. Patient agreed.", "A. B. Jones came.", "e.g. this one. Next", "", "no end"]
    want = [["Dr. Smith said hi.", "He left."], ["Take 5.5 mg. daily.", "Stop!", "Now?"], ["Made by Acme Co.", "Patient agreed."], ["A. B. Jones came."], ["e.g. this one.", "Next"], [], ["no end"]]
    assert _apply(spark, X.sentences, values) == want


def test_cjk_sentences(spark):
    assert _apply(spark, X.cjk_sentences, ["一つ。二つ！「三つ？」四つ 5.5"]) == [["一つ。", "二つ！", "「三つ？」", "四つ 5.5"]]


def test_cap(spark):
    values = ["short", "a" * 25, "aaaa bbbb; cccc dddd, eeee"]
    got = _apply(spark, lambda x: X.capped(F.array(x), 10), values)
    assert got == [["short"], ["a" * 10, "a" * 10, "a" * 5], ["aaaa bbbb;", "cccc dddd,", "eeee"]]


def test_fold(spark):
    assert _apply(spark, X.fold, ["täglich día très ñ Ž"]) == ["taglich dia tres n Z"]


def test_mask_and_back(spark):
    text = "Mail a@b.com and c@d.org, call 555-123-4567, host 10.0.0.1, none"
    masked = _apply(spark, lambda x: X.mask(x, PII_SHAPES), [text])[0]
    assert masked["masked"] == "Mail <EMAIL_1> and <EMAIL_2>, call <PHONE_1>, host <IPV4_1>, none"
    assert [m["original"] for m in masked["map"]] == ["a@b.com", "c@d.org", "555-123-4567", "10.0.0.1"]
    back = _apply(spark, lambda x: X.unmask(X.mask(x, PII_SHAPES)["masked"], F.reverse(X.mask(x, PII_SHAPES)["map"])), [text])
    assert back == [text]


def test_tolerant_json(spark):
    values = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', 'say {"a": 3} end', "none"]
    assert _apply(spark, lambda x: F.get_json_object(X.tolerant_json(x), "$.a"), values) == ["1", "2", "3", None]


def test_frequencies(spark):
    got = _apply(spark, Q.frequencies, ["Take twice daily", "zweimal täglich", "1 tablet BID", "nothing", "once daily and twice daily"])
    assert [sorted(f["daily"] for f in x) for x in got] == [[2], [2], [2], [], [1, 2]]


def test_tables_gate(spark):
    rows = [("|a|b|\n|1|2|", "|a|b|\n|1|2|"), ("|a|b|", "none"), ("|a|b|\n|1|2|", "|a|b|"), ("|a|b|", "|a|")]
    assert _pairs(spark, Q.tables_gate, rows) == [[], ["Table count mismatch"], ["Table row mismatch"], ["Table column mismatch"]]


@pytest.mark.parametrize(("order", "want"), [("DD/MM/YYYY", ["12/31/2020", "2020/01/02"]), ("MM/DD/YYYY", ["31/12/2020", "2020/01/02"]), ("YYYY/MM/DD", ["12/31/2020", "31/12/2020"])])
def test_dates_gate(spark, order, want):
    assert _apply(spark, lambda x: Q.dates_gate(x, order), ["on 12/31/2020 or 31/12/2020 or 2020/01/02"]) == [want]


def test_anchor_gate(spark):
    rows = [("Agree", "d'accord"), ("agree", "oui"), ("other", "oui")]
    assert _pairs(spark, lambda s, t: Q.anchor_gate(s, t, "fr"), rows) == [False, True, False]


def test_conserved(spark):
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end")))
    rows = [("good text here", "best text here"), ("good text here", "best word here")]
    assert _pairs(spark, lambda s, t: X.conserved(s, t, spans), rows) == [True, False]


def test_sentences_of_many_chunks(spark):
    """Joins depend on the neighbouring chunk alone; a text of 3,000 sentences is cut in one pass."""
    text = "Dr. Who met J. Smith. He left ... at once! See Fig. 3 etc. and so on? . Yes.  \n No"
    rows = [(1, text), (2, "One two. " * 3000), (3, ""), (4, None), (5, " \n")]
    got = dict(map(tuple, spark.createDataFrame(rows, "i int, t string").select("i", X.sentences(F.col("t"))).collect()))
    assert got[1] == ["Dr. Who met J. Smith.", "He left ...", "at once!", "See Fig.", "3 etc. and so on?", ".", "Yes.", "No"]
    assert got[2] == ["One two."] * 3000 and got[3] == [] and got[4] is None and got[5] == []
