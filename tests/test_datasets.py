"""Evaluation cases out of files of every form, and the suites that run over them."""

from __future__ import annotations

import csv
import io
import json

import duckdb
import pyarrow as pa
import pytest

from lexigate.operators import suites
from lexigate.sources import datasets
from tests.oracle import difference

FILES = {
    "a/named.json": json.dumps({"metadata": {"name": "My suite"}, "cases": [{"id": "x", "input": {"b": 1, "a": "é"}, "tags": ["t", 2], "assertions": [{"path": "p"}, "no object"]}, {"input": {}}, {"id": 7, "expected": {"z": None}}, "no object", {"input": [1]}, {"tags": "t"}, {"input": {"n": float("nan")}}]}),
    "a/deep/plain.json": '{"suite": "other", "cases": []}',
    "list.json": "[1]",
    "none.json": '{"cases": {}}',
    "broken.json": "{",
    "empty.jsonl": "",
    "lines.jsonl": '{"id": "one", "input": {"k": 1}}\n\n  \n{"input": {"k": 2}}\nnot json\n[1]\n{"id": "", "metadata": {"m": 1}}\n',
    "table.csv": 'expected,id,input,other\n"{""e"": 1}",c1,"{""text"":\n""two""}",x\n,,,\nbad,c3,{},y\n"[1]",c4,,\n',
    "ignored.txt": "nothing",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("cases")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return str(root)


def test_cases_and_rejects_of_every_form(spark, folder):
    cases, rejects = datasets.discover_cases(spark, folder)
    got = {(r["suite"], r["case_id"]): (r["place"], r["input"], r["expected"], r["assertions"], r["tags"], r["metadata"]) for r in cases.collect()}
    assert got == {
        ("My suite", "x"): (1, '{"a":"é","b":1}', None, ['{"path":"p"}'], ["t", "2"], "{}"),
        ("My suite", "case_2"): (2, "{}", None, [], [], "{}"),
        ("My suite", "7"): (3, "{}", '{"z":null}', [], [], "{}"),
        ("lines", "one"): (1, '{"k":1}', None, [], [], "{}"),
        ("lines", "line_4"): (4, '{"k":2}', None, [], [], "{}"),
        ("lines", "line_7"): (7, "{}", None, [], [], '{"m":1}'),
        ("table", "c1"): (1, '{"text":"two"}', '{"e":1}', [], [], "{}"),
        ("table", "row_2"): (2, "{}", "{}", [], [], "{}"),
    }
    assert sorted((r["suite"], r["case_id"] or "", r["place"], r["reason"]) for r in rejects.collect()) == sorted([
        ("My suite", "case_4", 4, "case must be an object"), ("My suite", "case_5", 5, "input must be an object"), ("My suite", "case_6", 6, "tags must be a list"), ("My suite", "case_7", 7, "NaN or infinity"),
        ("list", "", 0, "top level is no object"), ("none", "", 0, "no list of cases at the top"), ("broken", "", 0, "file is not JSON"),
        ("lines", "line_5", 5, "line is not JSON"), ("lines", "line_6", 6, "case must be an object"),
        ("table", "c3", 3, "input or expected is not JSON"), ("table", "c4", 4, "expected must be an object"),
    ])


def test_long_fields_of_a_csv_file_are_read(spark, tmp_path):
    """Fields beyond the csv module's own limit of 131,072 characters, and the rows behind them."""
    (tmp_path / "long.csv").write_text('id,input,expected\n' + "".join(f'c{i},"{{""text"": ""{"x" * n}""}}",\n' for i, n in enumerate((5, 400_000, 7))))
    cases, rejects = datasets.discover_cases(spark, str(tmp_path))
    assert sorted((r["case_id"], len(r["input"])) for r in cases.collect()) == [("c0", 16), ("c1", 400_011), ("c2", 18)]
    assert rejects.count() == 0


def test_csv_lines_pass_as_a_stream():
    """Cases come out before the file has been read; an error costs the rest of its own file only."""
    read = []

    def batches():
        for i, lines in enumerate([["id,input,expected"], *[[f'c{i}{j},"{{""k"": ""{"x" * 5000}""}}",' for j in range(100)] for i in range(60)]]):
            read.append(i)
            yield pa.RecordBatch.from_pydict({"path": ["f.csv"] * len(lines), "value": lines})
        yield pa.RecordBatch.from_pydict({"path": ["g.csv"] * 3 + ["h.csv"] * 2, "value": ["id,input", "a,{}", "b\rc,{}", "id", "d"]})

    out = datasets._csv_rows(batches())
    first = next(out)
    assert 0 < first.num_rows <= datasets.ROWS and len(read) < 15
    rest = [r for b in out for r in b.to_pylist()]
    assert first.num_rows + sum(r["path"] == "f.csv" for r in rest) == 6000
    assert [(r["path"], r["case_id"]) for r in rest if r["path"] != "f.csv"] == [("g.csv", "a"), ("g.csv", "b"), ("g.csv", "c"), ("h.csv", "d")]


def test_csv_files_that_are_split_are_read_in_order(spark, tmp_path):
    """Quoted line ends of every kind, over the borders of blocks, against the csv module over the whole text."""
    texts = {f"f{n}.csv": "id,input,expected\r\n" + "".join(f'n{i},"{{""t"": {i},{end * (i % 4)} ""u"": ""{"y" * (i % 90)}""}}",\r\n{end if i % 9 == 0 else ""}' for i in range(900)) for n, end in enumerate(["\n", "\r\n", "\r"])}
    texts["open.csv"] = 'id,input\na,{}\nb,"{}'
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {(r["path"].rsplit("/", 1)[-1], r["place"]): (r["case_id"], r["input"], r["reason"]) for r in datasets.read_cases(spark, str(tmp_path), "csv").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {}
    for name, text in texts.items():
        for i, row in enumerate(csv.DictReader(io.StringIO(text, newline="")), 1):
            want[name, i] = (row["id"], datasets.dumps(json.loads(row["input"])), None)
    assert got == want and len(want) == 2702


def test_golden_files_on_units_and_long_texts(spark, tmp_path):
    """Units in capitals are critical in a canonical copy too; a text of 70,000 letters is two long fields of a CSV file."""
    rows = [(2, "give 37L"), (4, "give 7 MG"), (5, "x" * 70_000), (8, "give 5 mg"), (10, "[[PII_1]]"), (11, "y")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert not difference(suites.golden_files(spark, str(tmp_path)), suites.ORACLE_SQL["golden_files"], con)


def test_line_numbers_hold_where_a_file_is_split(spark, tmp_path):
    (tmp_path / "many.jsonl").write_text("".join(f'{{"input": {{"n": {i}}}}}\n' for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        read = datasets.read_cases(spark, str(tmp_path), "jsonl")
        assert read.selectExpr("count(distinct path) as n").first()["n"] == 1
        rows = read.selectExpr("place", "get_json_object(input, '$.n') as n", "case_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(r["place"] == int(r["n"]) and r["case_id"] == f"line_{r['place']}" for r in rows)


def test_no_files(spark, tmp_path):
    assert all(x.count() == 0 for x in datasets.discover_cases(spark, str(tmp_path)))


def test_suites(spark):
    def case(name, source, target, kind, critical=None):
        return ("s", name, json.dumps({"source": source, "target": target, "kind": kind}), None if critical is None else json.dumps({"critical": critical}))

    rows = [
        case("same", "take 5 mg", "take 5 mg", "canonical", []),
        case("lost", "take 5 mg", "take it", "canonical"),
        case("found", "take 5 mg", "take 6 mg", "tampered", ["NUMERIC_MISMATCH"]),
        case("missed", "take it", "take it", "tampered", ["NUMERIC_MISMATCH"]),
        case("other", "5", "6", "draft", []),
        case("empty", None, None, "canonical"),
    ]
    got = {r["case_id"]: (r["missed"], r["passed"]) for r in suites.run_suites(spark.createDataFrame(rows, "suite string, case_id string, input string, expected string")).collect()}
    assert got["lost"][0].startswith("NUMERIC_MISMATCH") and not got["lost"][1]
    assert {k: v for k, v in got.items() if k != "lost"} == {"same": ("", True), "found": ("", True), "missed": ("NUMERIC_MISMATCH", False), "other": ("", True), "empty": ("", True)}
