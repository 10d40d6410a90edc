"""Gates over conversation pairs: each user turn with the next turn's answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.functions import gates
from lexigate.sources.tables import table

SRC, TGT = F.col, F.col


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, source, target): a user turn and the assistant turn after it; nulls come last, as in SQL."""
    w = Window.partitionBy("conv_id").orderBy(*[F.asc_nulls_last(c) for c in ("turn", "role", "text")])
    c = table(spark, d, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("target", F.lead("text").over(w))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), "target")


def _gate(name: str, defects) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = pairs(spark, d).select("conv_id", "turn", F.explode(defects(F.col("source"), F.col("target")).cast(gates.DEFECT)).alias("x"))
        return found.select("conv_id", "turn", "x.category", "x.message", gates.severity(F.col("x.message")).alias("severity"))

    query.__name__ = query.__qualname__ = name
    query.__doc__ = f"Defects of the {name[5:]} gate over conversation pairs."
    QUERIES[name] = query


QUERIES = {}
for _name, _defects in {
    "gate_numbers": gates.numbers,
    "gate_symbols": gates.symbols,
    "gate_units": gates.units,
    "gate_placeholders_set": gates.placeholders,
    "gate_pii_target": lambda s, t: gates.pii(t),
    "gate_coverage": gates.coverage,
    "gate_complexity": lambda s, t: gates.complexity(s),
    "gate_negation_fr": lambda s, t: gates.negation(s, t, "fr"),
    "gate_sentiment_es": lambda s, t: gates.sentiment(s, t, "es"),
}.items():
    _gate(_name, _defects)


def gate_numbers_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All main gates over each pair, counted by severity, and the verdict of each conversation."""
    names = ["numbers", "pii", "complexity", "coverage"]
    found = pairs(spark, d).select("conv_id", F.explode_outer(gates.check_segment(F.col("source"), F.col("target"), names)).alias("x"))
    level = gates.severity(F.col("x.message"))
    counted = found.groupBy("conv_id").agg(*[F.count_if(F.col("x").isNotNull() & (level == s)).alias(s.lower()) for s in ("CRITICAL", "MAJOR", "MINOR")])
    verdict = F.when(F.col("critical") > 0, "BLOCKED").when(F.col("major") > 0, "REVIEW_REQUIRED").otherwise("PASS")
    return counted.withColumn("verdict", verdict).withColumn("pass_rate", F.greatest(F.lit(0), 100 - 5 * (F.col("critical") + F.col("major") + F.col("minor"))))


def gate_placeholders_multiset(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders lost between a document and its lower-cased half, as multisets."""
    docs = table(spark, d, "documents")
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    tagged = docs.select("doc_id", F.regexp_replace("text", r"([0-9])", "[$1]").alias("source"), F.regexp_replace(half, r"([0-9])", "[$1]").alias("target"))
    lost = tagged.select("doc_id", F.explode(gates.lost_copies(F.col("source"), F.col("target"))).alias("x"))
    return lost.select("doc_id", "x.value", F.col("x.lost").cast("bigint").alias("lost"))


def gate_glossary(spark: SparkSession, d: str) -> DataFrame:
    """Locked terms that a pair's source holds and its target lacks: terms as one broadcast array."""
    terms = F.broadcast(table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.lower(F.substring("n_name", 1, 2)))).alias("terms")))  # 25 rows
    hit = F.filter(F.array_distinct("terms"), lambda t: F.contains(F.lower("source"), t) & ~F.contains(F.lower("target"), t))
    return pairs(spark, d).join(terms).select("conv_id", "turn", F.explode(hit).alias("term"))


def gate_injection(spark: SparkSession, d: str) -> DataFrame:
    """Injection labels over raw pages, where role tags and the like may hide."""
    return table(spark, d, "pages").select("page_id", F.explode(gates.injection(F.col("html"))).alias("label"))


def pii_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source that hold a shape of personal data."""
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count_if(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}")).alias("emails"), F.count_if(F.col("text").rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")).alias("addresses"))


QUERIES |= {f.__name__: f for f in (gate_numbers_pairs, gate_placeholders_multiset, gate_glossary, gate_injection, pii_counts_by_source)}

_PAIRS = "pairs AS (SELECT conv_id, turn, text AS source, target FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) t WHERE role = 'user' AND next_role = 'assistant')"


def _out(body: str, category: str, severity: str) -> str:
    return f"WITH {_PAIRS} SELECT conv_id, turn, '{category}' AS category, message, '{severity}' AS severity FROM ({body}) d WHERE message IS NOT NULL"


_NUMBERS = "SELECT conv_id, turn, 'Number ' || n || ' missing in target.' AS message FROM (SELECT conv_id, turn, target, unnest(regexp_extract_all(source, '[0-9]+(?:[.,][0-9]+)?')) AS n FROM pairs) u WHERE NOT regexp_matches(target, '(^|[^0-9])' || regexp_replace(n, '[.,]', '[.,]', 'g') || '($|[^0-9])')"
_COVERAGE = r"SELECT conv_id, turn, CASE WHEN length(trim(source, ' ')) >= 40 THEN CASE WHEN trim(target, ' ') = '' THEN 'Omission: empty target.' WHEN length(regexp_replace(target, '[\x20\x09-\x0D]', '', 'g')) < 0.2 * length(regexp_replace(source, '[\x20\x09-\x0D]', '', 'g')) THEN 'Omission: target too short.' END END AS message FROM pairs"
_COMPLEXITY = r"SELECT conv_id, turn, CASE WHEN regexp_matches(source, '(\$|\\\[|\\\(|\\begin\{equation\})') THEN 'Complexity: formula for review.' WHEN length(source) - length(replace(source, '|', '')) > 4 THEN 'Complexity: table for review.' WHEN contains(source, '```') THEN 'Complexity: code for review.' END AS message FROM pairs"
_SYMBOLS = " UNION ALL ".join(f"SELECT conv_id, turn, CASE WHEN length(source) - length(replace(source, '{s}', '')) > length(target) - length(replace(target, '{s}', '')) THEN 'Symbol missing: {s}' END AS message FROM pairs" for s in gates.SYMBOLS)
_holds = lambda x, words: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"
ORACLE_SQL = {
    "gate_numbers": _out(_NUMBERS, "NUMERIC_MISMATCH", "CRITICAL"),
    "gate_coverage": _out(_COVERAGE, "OMISSION", "CRITICAL"),
    "gate_complexity": _out(_COMPLEXITY, "COMPLEXITY_WARNING", "MAJOR"),
    "gate_symbols": _out(_SYMBOLS, "FORMATTING", "MAJOR"),
    "gate_negation_fr": _out(f"SELECT conv_id, turn, CASE WHEN regexp_matches(source, '(?i)\\b(no|not|never|none|neither|nor|cannot|don''t|won''t)\\b') AND NOT {_holds('target', gates.NEGATION_MARKERS['fr'])} THEN 'Negation lost.' END AS message FROM pairs", "NEGATION_FLIP", "CRITICAL"),
    "gate_sentiment_es": _out(f"SELECT conv_id, turn, CASE WHEN {_holds('source', gates.NEGATIVE_MARKERS['en'])} <> {_holds('target', gates.NEGATIVE_MARKERS['es'])} THEN 'Sentiment shift.' END AS message FROM pairs", "SENTIMENT_SHIFT", "MAJOR"),
    "gate_glossary": f"WITH {_PAIRS}, terms AS (SELECT DISTINCT lower(substr(n_name, 1, 2)) AS term FROM nation) SELECT conv_id, turn, term FROM pairs JOIN terms ON contains(lower(source), term) AND NOT contains(lower(target), term)",
    "gate_injection": "SELECT page_id, label FROM (" + " UNION ALL ".join("SELECT page_id, '{}' AS label FROM pages WHERE regexp_matches(html, '{}')".format(k, v.replace("'", "''")) for k, v in gates.INJECTION.items()) + ") t",
    "pii_counts_by_source": r"SELECT source, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}')) AS emails, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS addresses FROM documents GROUP BY source",
    "gate_placeholders_multiset": "WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]')) AS v FROM documents), t AS (SELECT doc_id, unnest(regexp_extract_all(substr(text, 1, CAST(floor(length(text) / 2.0) AS BIGINT)), '[0-9]')) AS v FROM documents), a AS (SELECT doc_id, v, count(*) AS n FROM s GROUP BY doc_id, v), b AS (SELECT doc_id, v, count(*) AS n FROM t GROUP BY doc_id, v) SELECT a.doc_id, '[' || a.v || ']' AS value, a.n - coalesce(b.n, 0) AS lost FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.v = b.v WHERE a.n > coalesce(b.n, 0)",
}
