"""The corpus pipeline: five stages from raw documents to tokenised ones.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and
returns the columns of documents, but for the last, which adds the tokens. Stages are
written as Parquet and read again. An empty table stays empty at every stage; null texts
and ids, repeated rows and extra columns of any name pass as each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigate.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dedup
from lexigate.llm._session import cut
from lexigate.llm.vocabularies import PATTERN, vocabulary

#: Documents whose language is less certain than this, or unknown, go.
LEAST_SCORE = 0.5
#: Jaccard similarity (per cent, five-word shingles) from which documents are near-duplicates.
SIMILARITY = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is known and certain enough.

    The network learns from all labelled rows that are given; it reads texts only. Null,
    empty and letterless texts go. Where no row has a language, nothing can be learned, and
    every document with a letter stays.
    """
    net = language_id.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    if not net.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, net, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"carry.`{c}`").alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those left without a word go."""
    removed = "n_removed"
    while removed in {c.lower() for c in docs.columns}:
        removed += "_"
    left = line_dedup.dedup_lines(docs, removed=removed)
    return left.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(removed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id."""
    return near_dedup.drop_near_duplicates(docs, SIMILARITY)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out; those that held nothing else go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that the ids decode to, of every document."""
    coded = byte_bpe.encode_texts(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.decode("decoded", "utf-8").alias("text"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("byte_bpe", tokens),
]

#: Language identification and fuzzy matching have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
