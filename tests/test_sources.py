"""File sources and sinks, and state changes, on planted rows."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from lexigate.operators import changes
from lexigate.sources import files


def test_text_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\nmore\n\n two \n\n\n")
    (tmp_path / "b.txt").write_text("   ")
    rows = {(r["path"][-5:], r["order_index"], r["text"]) for r in files.text_blocks(spark, str(tmp_path)).collect()}
    assert rows == {("a.txt", 0, "one\nmore"), ("a.txt", 1, "two"), ("b.txt", 0, "   ")}


def test_rules_round_trip(spark, tmp_path):
    (tmp_path / "r.csv").write_text("source_pattern,target_correction,context_tag,confidence_score,is_regex,is_strict,priority\n a , b ,t,0.5,Yes,0,3\n,,,,,,\nc,,,,,,\nd,e,,x,,,\nf,g,,,1,true,9\n")
    rules, rejects = files.read_rules_csv(spark, str(tmp_path / "r.csv"))
    assert {(r["source_pattern"], r["is_regex"], r["is_strict"], r["priority"]) for r in rules.collect()} == {("a", True, False, 3), ("f", True, True, 9)}
    assert {(r["source_pattern"], r["why"]) for r in rejects.collect()} == {("c", "no correction"), ("d", "bad confidence")}
    files.write_rules(rules, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_docx_and_validation(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello </w:t><w:t>there</w:t></w:r></w:p><w:p/></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {ns}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "c.bin").write_bytes(b"\x00\x00\x00\x00\x01")
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    got = {(r["path"][-6:], r["order_index"], r["part"], r["text"]) for r in files.docx_blocks(raw.where("path not like '%.bin'")).collect()}
    assert got == {("a.docx", 0, "document", "Hello there"), ("a.docx", 1, "header1", "Head"), ("b.docx", 0, None, None)}
    assert {(r["path"][-6:], r["kind"], r["valid"]) for r in files.valid_upload(raw).collect()} == {("a.docx", "docx", True), ("b.docx", "docx", True), ("/c.bin", None, False)}


def test_glossary_and_document_text(spark):
    terms = spark.createDataFrame([("g", "1", "a", "x", False), ("g", "2", "b", "y", False)], "glossary_id string, glossary_version string, source_text string, target_text string, is_deleted boolean")
    fresh = spark.createDataFrame([(" c ", "z"), ("", "q")], "source_text string, target_text string")
    assert {(r["source_text"], r["is_deleted"]) for r in files.replace_glossary(terms, ("g", "1"), fresh).collect()} == {("a", True), ("b", False), ("c", False)}
    seg = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", "A")], "document_id int, order_index int, source_text string, translated_text string")
    assert files.document_text(seg).first()["text"] == "A\n\nb"


def test_changes(spark):
    rows = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "id int, text string, other string")
    out = changes.partial_update(rows, spark.createDataFrame([(1, "A", None)], "id int, text string, other string"), "id")
    assert sorted(map(tuple, out.collect())) == [(1, "A", "p"), (2, "b", "q")]
    rules = spark.createDataFrame([(1, "PROPOSED"), (2, "PROPOSED"), (3, "ACTIVE")], "rule_id int, status string")
    asked = spark.createDataFrame([(1, "lead", "good", 1), (2, "guest", "good", 1), (3, "lead", "x", 1)], "rule_id int, role string, reason string, asked_at int")
    updated, audit = changes.promote(rules, asked, spark.createDataFrame([("lead",)], "role string"))
    assert sorted(map(tuple, updated.collect())) == [(1, "ACTIVE"), (2, "PROPOSED"), (3, "ACTIVE")] and audit.count() == 1
    live = spark.createDataFrame([(1, False), (2, True)], "id int, is_deleted boolean")
    after, snap = changes.soft_delete(live, F.lit(True), F.lit("now"))
    assert {r["is_deleted"] for r in after.collect()} == {True} and snap.count() == 1
    both = changes.append_missing(rows, spark.createDataFrame([(2, "z", "z"), (3, "c", "r"), (3, "c", "r")], rows.schema), ["id"])
    assert sorted(r["id"] for r in both.collect()) == [1, 2, 3]
