"""Datasets of evaluation cases in JSON, JSON lines and CSV, as one schema, with rejects.

Files are found and read by Spark's own readers, so that they may lie in any store. Lines of a
JSON-lines file are split over tasks like any text; a JSON file is one row, since it cannot be
cut. A CSV file cannot be cut either, but its lines pass one task as a stream, in order, so that a
task holds a case and not the file. What does not parse costs only its own case, or its file where there is no
case to tell apart, and is kept with a reason.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.functions.canonical import dumps

#: Names of the files of each form.
GLOBS = {"json": "*.json", "jsonl": "*.jsonl", "csv": "*.csv"}
#: Characters of a CSV field, at most: what a C long of any platform holds, so no field that a row can have is refused.
FIELD = (1 << 31) - 1
CASES = "path string, suite string, case_id string, place bigint, input string, expected string, assertions array<string>, tags array<string>, metadata string, reason string"
_NAMES = [x.split()[0] for x in CASES.split(", ")]
#: Cases, and characters of them, that go back to Spark at once (one longer case goes alone).
ROWS, CHARS = 1000, 1 << 22
_LIST = pa.list_(pa.string())
_KINDS = [*[pa.string()] * 3, pa.int64(), pa.string(), pa.string(), _LIST, _LIST, pa.string(), pa.string()]


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _object(value, what: str) -> dict:
    if not isinstance(value, dict):
        raise ValueError(f"{what} must be an object")
    return value


def _case(path: str, suite: str, place: int, raw, default: str) -> tuple:
    """A row of CASES from a parsed case; the id falls back to a default."""
    name = default
    try:
        case = _object(raw, "case")
        name = str(case.get("id") or default)
        expected = case.get("expected")
        for key in ("assertions", "tags"):
            if not isinstance(case.get(key) or [], list):
                raise ValueError(f"{key} must be a list")
        assertions = [dumps(a) for a in case.get("assertions") or [] if isinstance(a, dict)]
        row = (dumps(_object(case.get("input") or {}, "input")), None if expected is None else dumps(_object(expected, "expected")), assertions, [str(t) for t in case.get("tags") or []], dumps(_object(case.get("metadata") or {}, "metadata")))
    except ValueError as e:
        return (path, suite, name, place, None, None, None, None, None, "NaN or infinity" if "JSON compliant" in str(e) else str(e))
    return (path, suite, name, place, *row, None)


def _reject(path: str, suite: str, name: str | None, place: int, reason: str) -> tuple:
    return (path, suite, name, place, None, None, None, None, None, reason)


def _of_json(path: str, text: str) -> Iterator[tuple]:
    """Cases of one JSON file: an object with a list of cases; its name is in the metadata, or is that of the file."""
    try:
        raw = json.loads(text)
    except (ValueError, RecursionError):
        yield _reject(path, _stem(path), None, 0, "file is not JSON")
        return
    if not isinstance(raw, dict) or not isinstance(raw.get("cases"), list):
        yield _reject(path, _stem(path), None, 0, "no list of cases at the top" if isinstance(raw, dict) else "top level is no object")
        return
    meta = raw.get("metadata") if isinstance(raw.get("metadata"), dict) else {}
    suite = str(meta.get("name") or raw.get("suite") or _stem(path))
    for i, case in enumerate(raw["cases"], 1):
        yield _case(path, suite, i, case, f"case_{i}")


def _of_csv(path: str, lines: Iterable[str]) -> Iterator[tuple]:
    """Cases of the lines of one CSV file with a header; input and expected hold JSON, empty ones an empty object."""
    csv.field_size_limit(FIELD)
    try:
        for i, row in enumerate(csv.DictReader(part for line in lines for part in io.StringIO(line + "\n", newline="")), 1):
            name = (row.get("id") or f"row_{i}").strip()
            try:
                case = {"id": name, "input": json.loads(row.get("input") or "{}"), "expected": json.loads(row.get("expected") or "{}")}
            except (ValueError, RecursionError):
                yield _reject(path, _stem(path), name, i, "input or expected is not JSON")
                continue
            yield _case(path, _stem(path), i, case, name)
    except csv.Error as e:
        yield _reject(path, _stem(path), None, 0, f"file is not CSV: {e}")


def _of_line(path: str, text: str, place: int) -> Iterator[tuple]:
    if text.strip():
        try:
            yield _case(path, _stem(path), place, json.loads(text), f"line_{place}")
        except (json.JSONDecodeError, RecursionError):
            yield _reject(path, _stem(path), f"line_{place}", place, "line is not JSON")


def _packed(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of CASES as batches of ROWS rows and about CHARS characters at most."""
    pack = lambda held: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], _NAMES)
    held, chars = [], 0
    for row in rows:
        size = sum(len(row[i] or "") for i in (4, 5, 8))
        if held and (len(held) == ROWS or chars + size > CHARS):
            yield pack(held)
            held, chars = [], 0
        held.append(row)
        chars += size
    if held:
        yield pack(held)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(c[at].as_py() for c in batch.columns)


def _rows(parse):
    return lambda batches: _packed(case for row in _stream(batches) for case in parse(*row))


def _csv_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = groupby(_stream(batches), lambda row: row[0])
    return _packed(case for path, rows in files for case in _of_csv(path, (line for _, line in rows)))


def _placed(files: DataFrame) -> DataFrame:
    """(path, value, block, order): lines with the block of the file that they come from and their order in it."""
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("order"))


def _lines(files: DataFrame) -> DataFrame:
    """(path, value, place): lines with their number in the file, from 1.

    A file's blocks are numbered apart; only one count a block is summed up over a file.
    """
    x = _placed(files)
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("order"))
    counts = x.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("inside", inside).join(counts.select("path", "block", before.alias("before")), ["path", "block"]).select("path", "value", (F.col("before") + F.col("inside")).cast("bigint").alias("place"))


def read_cases(spark: SparkSession, path: str, form: str, glob: str | None = None) -> DataFrame:
    """Cases of all files of one form (json, jsonl or csv) under a folder, at any depth.

    Returns path, suite, case_id, place, input, expected, assertions, tags, metadata and reason.
    Objects are canonical JSON. Rows with a reason are rejects. Blank lines are no cases; a folder
    without such files gives no rows.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob or GLOBS[form])
    if form == "jsonl":
        return _lines(reader.text(path)).mapInArrow(_rows(_of_line), CASES)
    if form == "csv":
        lines = _placed(reader.text(path, lineSep="\n")).repartition("path").sortWithinPartitions("path", "block", "order")
        return lines.select("path", "value").mapInArrow(_csv_rows, CASES)
    whole = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.mapInArrow(_rows(_of_json), CASES)


def discover_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejects) of all files under a folder whose names end in one of the known forms."""
    every = read_cases(spark, path, "json").unionByName(read_cases(spark, path, "jsonl")).unionByName(read_cases(spark, path, "csv"))
    return every.where("reason is null").drop("reason"), every.where("reason is not null").select("path", "suite", "case_id", "place", "reason")
