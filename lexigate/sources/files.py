"""File sources and sinks: text blocks, rule and glossary imports with rejects, validation, exports, office text."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Strings that mean true in an import, and file signatures by kind.
TRUTHY = ["true", "1", "yes"]
MAGIC = {"pdf": "25504446", "docx": "504B0304"}
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, order_index, text): blocks of whole text files between blank lines; one block if there is none."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    parts = F.filter(F.transform(F.split("value", r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    return whole.select("path", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array("value"))).alias("order_index", "text"))


def valid_upload(files: DataFrame, most: int = 50 << 20) -> DataFrame:
    """binaryFile rows with their kind by signature, and whether size and content are plausible."""
    head = F.hex(F.substring("content", 1, 4))
    kind = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        kind = F.when(head == magic, name).otherwise(kind)
    texty = ~F.contains(F.hex(F.substring("content", 1, 512)), F.lit("0000"))
    kind = F.coalesce(kind, F.when(texty, "txt"))
    return files.select("path", "length", kind.alias("kind"), ((F.col("length") > 0) & (F.col("length") <= most) & kind.isNotNull()).alias("valid"))


def _truth(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin(TRUTHY)


RULES = "source_pattern string, target_correction string, context_tag string, confidence_score string, is_regex string, is_strict string, priority string"


def import_rules(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, rejects) of text columns: trimmed, blanks skipped, numbers checked; a reject says why."""
    trimmed = raw.select(*[F.trim(F.col(c)).alias(c) for c in raw.columns])
    some = trimmed.where("coalesce(source_pattern, '') <> '' OR coalesce(target_correction, '') <> ''")
    why = (
        F.when(F.coalesce("source_pattern", F.lit("")) == "", "no source pattern")
        .when(F.coalesce("target_correction", F.lit("")) == "", "no correction")
        .when(F.col("confidence_score").isNotNull() & F.col("confidence_score").try_cast("double").isNull(), "bad confidence")
        .when(F.col("priority").isNotNull() & F.col("priority").try_cast("int").isNull(), "bad priority")
    )
    checked = some.withColumn("why", why)
    rules = checked.where("why is null").select(
        "source_pattern",
        "target_correction",
        "context_tag",
        F.coalesce(F.col("confidence_score").try_cast("double"), F.lit(1.0)).alias("confidence_score"),
        F.coalesce(_truth(F.col("is_regex")), F.lit(False)).alias("is_regex"),
        F.coalesce(_truth(F.col("is_strict")), F.lit(False)).alias("is_strict"),
        F.coalesce(F.col("priority").try_cast("int"), F.lit(0)).alias("priority"),
    )
    return rules, checked.where("why is not null")


def read_rules_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return import_rules(spark.read.schema(RULES).csv(path, header=True))


def read_rules_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return import_rules(spark.read.schema(RULES).json(path, multiLine=True))


def write_rules(rules: DataFrame, path: str, form: str = "csv") -> None:
    """Rules by priority, highest first."""
    ordered = rules.orderBy(F.desc("priority"), "source_pattern")
    ordered.write.mode("errorifexists").option("header", "true").format(form).save(path)


def replace_glossary(terms: DataFrame, version: tuple[str, str], fresh: DataFrame) -> DataFrame:
    """All terms after an upload: the rows of that (glossary_id, glossary_version) are marked deleted, new ones added."""
    ours = (F.col("glossary_id") == version[0]) & (F.col("glossary_version") == version[1])
    kept = terms.withColumn("is_deleted", F.col("is_deleted") | ours)
    new = fresh.where("coalesce(trim(source_text), '') <> ''").select(F.lit(version[0]).alias("glossary_id"), F.lit(version[1]).alias("glossary_version"), F.trim("source_text").alias("source_text"), F.trim("target_text").alias("target_text"), F.lit(False).alias("is_deleted"))
    return kept.unionByName(new)


def document_text(segments: DataFrame) -> DataFrame:
    """(document_id, text): translated segments in order, the source where there is no translation."""
    line = F.struct("order_index", F.coalesce("translated_text", "source_text").alias("t"))
    g = segments.groupBy("document_id").agg(F.array_sort(F.collect_list(line)).alias("s"))
    return g.select("document_id", F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("text"))


def _paragraphs(raw: bytes) -> Iterator[tuple[str, str]]:
    """(part, text) of every paragraph of a word-processing file, body first, then headers, footers and notes."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        order = ["word/document.xml", *sorted(n for n in names if n.startswith("word/header")), *sorted(n for n in names if n.startswith("word/footer")), "word/footnotes.xml", "word/endnotes.xml"]
        for name in (n for n in order if n in names and n.endswith(".xml")):
            for p in ET.fromstring(z.read(name)).iter(f"{WORD_NS}p"):
                text = "".join(t.text or "" for t in p.iter(f"{WORD_NS}t"))
                if text.strip():
                    yield name[5:-4], text


def docx_blocks(files: DataFrame) -> DataFrame:
    """(path, order_index, part, text, error) of binaryFile rows; an unreadable file gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, i, part, text, None) for i, (part, text) in enumerate(_paragraphs(bytes(content)))]
                except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
                    rows.append((path, 0, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "order_index", "part", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, order_index int, part string, text string, error string")
