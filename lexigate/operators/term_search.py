"""Search for many terms at once: forbidden terms, glossaries, and rules tried on texts.

A term table becomes Aho-Corasick automata, one for each slice of at most ``SLICE`` bytes of
terms; a slice is sent to the tasks, which run every text through it once, whatever the number of
terms. All occurrences are found, also those that overlap or lie in one another, with their
places in code points of the text as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.sources.tables import table

#: Bytes of terms in a slice, about: what is sent to the tasks, and what the driver holds at a time.
SLICE = 1 << 20
#: Rows of an output batch.
ROWS = 50_000
#: Rows of an Arrow batch of texts that are searched at a time.
TEXTS = 200


def fold(text: str) -> str:
    """Small letters at the same places: a letter that becomes several stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class _Automaton:
    """The terms of a slice; a term that begins and ends with a letter or digit may be asked to stand as a word."""

    def __init__(self, terms: list[str], folded: bool, bounded: bool):
        import ahocorasick

        self.find, self.folded, same = ahocorasick.Automaton(), folded, {}
        for term in terms:
            same.setdefault(fold(term) if folded else term, []).append(term)
        for key, own in same.items():
            self.find.add_word(key, (len(key), bounded and key[0].isalnum() and key[-1].isalnum(), own))
        self.find.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[str, int, int]]:
        low = fold(text) if self.folded else text
        for last, (n, edged, own) in self.find.iter(low):
            first, end = last + 1 - n, last + 1
            if edged and ((first and _word(low[first - 1])) or (end < len(low) and _word(low[end]))):
                continue
            for term in own:
                yield term, first, end


def _searcher(terms: list[str], folded: bool, bounded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, out = _Automaton(terms, folded, bounded), []
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text:
                        for hit in find(text):
                            out.append((key, *hit))
                            if len(out) == ROWS:
                                yield _hits(out, kind)
                                out = []
            if out:
                yield _hits(out, kind)
                out = []

    return run


def _hits(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    keys, terms, first, end = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(terms, pa.string()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], ["key", "term", "start", "end"])


def find_terms(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", folded: bool = True, bounded: bool = True) -> DataFrame:
    """(key, term, start, end): every occurrence of every term in every whole text.

    ``folded`` puts case aside. ``bounded``: a term with a letter or digit at both edges counts only where
    it stands as a word; any other term, such as ``+abc`` or ``%``, counts everywhere. Null and empty
    terms match nothing, repeated terms count once, null texts are empty; rows of one key are all searched.
    The texts are read once for each slice of terms.
    """
    own = terms.select(F.col("term").cast("string").alias("term")).where("term <> ''").distinct()
    size = own.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    n = -(-size // SLICE)
    source = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    schema, out = f"key {kind}, term string, start bigint, end bigint", None
    for i in range(n):
        held = [r["term"] for r in own.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).collect()]
        hits = source.mapInArrow(_searcher(held, folded, bounded), schema)
        out = hits if out is None else out.unionByName(hits)
    return (texts.sparkSession.createDataFrame([], schema) if out is None else out).withColumnRenamed("key", key)


def glossary_findings(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(pair_id, src, tgt, severity): terms of a source whose rendering its target lacks, CRITICAL where locked.

    Pairs: pair_id, source, target. Glossary: src, tgt, locked. Both are looked for as they stand,
    anywhere. Rows of the glossary with an empty side are left out; a null target lacks every rendering.
    """
    own = glossary.where("src <> '' and tgt <> ''").groupBy("src", "tgt").agg(F.max(F.coalesce("locked", F.lit(False))).alias("locked"))
    held = find_terms(pairs, own.select(F.col("src").alias("term")), "pair_id", "source", folded=False, bounded=False).select("pair_id", F.col("term").alias("src")).distinct()
    kept = find_terms(pairs, own.select(F.col("tgt").alias("term")), "pair_id", "target", folded=False, bounded=False).select("pair_id", F.col("term").alias("tgt")).distinct()
    lacking = held.join(own, "src").join(kept, ["pair_id", "tgt"], "left_anti")
    return lacking.select("pair_id", "src", "tgt", F.when(F.col("locked"), "CRITICAL").otherwise("MAJOR").alias("severity"))


def rejected_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, reason): regular expressions that do not compile, and empty patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rule, pattern, is_regex in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not pattern:
                    out.append((rule, "empty pattern"))
                elif is_regex:
                    try:
                        re.compile(pattern, re.IGNORECASE)
                    except re.error as e:
                        out.append((rule, f"invalid regex: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in ((0, pa.int64()), (1, pa.string()))], ["rule_id", "reason"])

    return rules.select(F.col("rule_id").cast("bigint"), "pattern", "is_regex").mapInArrow(run, "rule_id bigint, reason string")


#: Letters that an ASCII letter matches too where case is put aside.
_TWINS = re.compile("[\u0130\u0131\u017f\u212a]")


def _lead(pattern: str) -> str:
    """The ASCII letters that every match of a pattern begins with; empty where that is not plain from its text."""
    word = re.match(r"[A-Za-z]*", pattern)[0]
    if "|" in pattern:
        return ""
    return word[:-1] if pattern[len(word) : len(word) + 1] in {"*", "?", "{"} else word


def _regexes(rules: list[tuple[int, str]]):
    """Matches of regular expressions; those that begin with letters are tried where the letters stand, found in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, led = [], {}
        for rule, pattern in rules:
            try:
                own = rule, re.compile(pattern, re.IGNORECASE)
            except re.error:  # told by rejected_rules
                continue
            every.append(own)
            led.setdefault(_lead(pattern).lower(), []).append(own)
        plain, leads = led.pop("", []), _Automaton(list(led), True, False) if led else None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                scanned = every if _TWINS.search(text) else plain
                out = [(key, rule, m.start(), m.end()) for rule, find in scanned for m in find.finditer(text)]
                if leads and scanned is plain:
                    behind: dict[tuple[str, int], int] = {}
                    for lead, first, _ in leads(text):
                        for j, (rule, find) in enumerate(led[lead]):
                            if first >= behind.get((lead, j), 0) and (m := find.match(text, first)):
                                out.append((key, rule, first, m.end()))
                                behind[lead, j] = m.end()
                if out:
                    keys, ids, first, end = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(x, pa.int64()) for x in (ids, first, end))], ["pair_id", "rule_id", "start", "end"])

    return run


def rule_hits(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(pair_id, rule_id, start, end, would_fire): where the pattern of each rule matches each source, case put aside.

    Pairs: pair_id, source, target. Rules: rule_id, pattern, correction, is_regex. Literal
    patterns match anywhere, overlapping ones too; a regular expression gives its leftmost matches
    one after another. A rule would fire where the target lacks its correction (an empty one is in every
    target, a null target is empty). What ``rejected_rules`` tells matches nothing.
    """
    literal = rules.where(~F.coalesce("is_regex", F.lit(False)) & (F.col("pattern") != ""))
    found = find_terms(pairs, literal.select(F.col("pattern").alias("term")), "pair_id", "source", bounded=False)
    hits = found.join(literal.select("rule_id", F.col("pattern").alias("term")), "term").select("pair_id", "rule_id", "start", "end")
    regex = rules.where("is_regex and pattern <> ''").select(F.col("rule_id").cast("bigint").alias("rule_id"), "pattern")
    n = -(-(regex.agg(F.sum(F.octet_length("pattern") + 8)).first()[0] or 0) // SLICE)
    source = pairs.select("pair_id", "source")
    kind = source.schema["pair_id"].dataType.simpleString()
    for i in range(n):
        held = [tuple(r) for r in regex.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == i).collect()]
        hits = hits.unionByName(source.mapInArrow(_regexes(held), f"pair_id {kind}, rule_id bigint, start bigint, end bigint"))
    wanted = rules.select("rule_id", F.coalesce("correction", F.lit("")).alias("tgt"))
    right = find_terms(pairs, wanted.select(F.col("tgt").alias("term")), "pair_id", "target", bounded=False).select("pair_id", F.col("term").alias("tgt"), F.lit(False).alias("lacks")).distinct()
    judged = hits.join(wanted, "rule_id").join(right, ["pair_id", "tgt"], "left")
    return judged.select("pair_id", "rule_id", "start", "end", F.coalesce("lacks", F.col("tgt") != "").alias("would_fire"))


def _words(text: str) -> F.Column:
    return F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def _term_table(spark: SparkSession, d: str) -> DataFrame:
    """Terms out of the tables: first pair of words and last word with its full stop of each benchmark item, and what documents have behind a symbol."""
    b = table(spark, d, "benchmark")
    phrase = b.select(F.regexp_extract("text", r"^([\p{L}]+ [\p{L}]+)", 1).alias("term"))
    last = b.select(F.regexp_extract("text", r"([\p{L}]+\.)$", 1).alias("term"))
    marks = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([#$%&|<>+@][A-Za-z0-9]{2})"), F.lit(1))).alias("term"))
    return phrase.unionByName(last).unionByName(marks).unionByName(b.select(F.substring("text", 2, 3).alias("term"))).where("term <> ''").distinct()


def forbidden_search(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of every forbidden term in whole documents, symbol-edged terms and phrases included."""
    return find_terms(table(spark, d, "documents"), _term_table(spark, d))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, source, target): each turn of a user and the turn that follows it; an absent one is null."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("target", F.lead("text").over(w))
    return turns.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("source"), "target")


def glossary_search(spark: SparkSession, d: str) -> DataFrame:
    """Glossary terms in turns of users whose rendering the reply lacks; neighbouring words of the benchmark are term and rendering."""
    words = _words("text")
    pairs = F.explode(F.arrays_zip(words.alias("src"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("tgt"))).alias("x")
    glossary = table(spark, d, "benchmark").select((F.col("item_id") % 2 == 0).alias("locked"), pairs).select("x.src", "x.tgt", "locked").where("length(src) >= 4 and tgt is not null")
    return glossary_findings(_replies(spark, d), glossary)


def rule_search(spark: SparkSession, d: str) -> DataFrame:
    """Every match of every rule in whole documents, and whether it would fire on the document that follows by id."""
    b = table(spark, d, "benchmark").where("text is not null")
    rules = b.select(F.col("item_id").alias("rule_id"), F.substring("text", 3, 5).alias("pattern"), F.substring("text", 12, 6).alias("correction"), F.lit(False).alias("is_regex"))
    patterns = b.select((F.col("item_id") + 1_000_000).alias("rule_id"), F.concat(F.regexp_extract("text", r"^([\p{L}]+)", 1), F.lit(r"[,.]")).alias("pattern"), F.lit("").alias("correction"), F.lit(True).alias("is_regex"))
    docs = table(spark, d, "documents")
    pairs = docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("source")).join(docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("target")), "pair_id", "left")
    return rule_hits(pairs, rules.unionByName(patterns))


QUERIES = {f.__name__: f for f in (forbidden_search, glossary_search, rule_search)}
_WORD = r"[\p{L}\p{N}_]"


def _occurrences(name: str, texts: str, terms: str) -> str:
    """Places of every term in every text: (key, term, low, pos), from 1, overlapping ones too."""
    return f"""{name} AS (
            SELECT key, term, low, strpos(t.text, low) AS pos, t.text FROM ({texts}) t JOIN ({terms}) q ON contains(t.text, low)
            UNION ALL SELECT key, term, low, pos + strpos(substr(text, pos + 1), low), text FROM {name} WHERE contains(substr(text, pos + 1), low)
        )"""


ORACLE_SQL = {
    "forbidden_search": rf"""
        WITH RECURSIVE t AS (
            SELECT regexp_extract(text, '^([\p{{L}}]+ [\p{{L}}]+)', 1) AS term FROM benchmark UNION SELECT regexp_extract(text, '([\p{{L}}]+\.)$', 1) FROM benchmark
            UNION SELECT unnest(regexp_extract_all(text, '[#$%&|<>+@][A-Za-z0-9]{{2}}')) FROM documents UNION SELECT substr(text, 2, 3) FROM benchmark
        ),
        {_occurrences("o", "SELECT doc_id AS key, lower(text) AS text FROM documents", "SELECT term, lower(term) AS low FROM t WHERE term <> ''")}
        SELECT key AS doc_id, term, pos - 1 AS start, pos - 1 + length(low) AS "end" FROM o
        WHERE NOT (regexp_matches(low, '^[\p{{L}}\p{{N}}]') AND regexp_matches(low, '[\p{{L}}\p{{N}}]$')) OR NOT (regexp_matches(substr(text, pos - 1, CASE WHEN pos > 1 THEN 1 ELSE 0 END), '{_WORD}') OR regexp_matches(substr(text, pos + length(low), 1), '{_WORD}'))
    """,
    "glossary_search": rf"""
        WITH r AS (SELECT conv_id * 1000 + turn AS pair_id, role, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations),
        w AS (SELECT item_id, regexp_extract_all(text, '{_WORD}+') AS w FROM benchmark),
        g AS (SELECT src, tgt, bool_or(item_id % 2 = 0) AS locked FROM (SELECT item_id, unnest(list_zip(w[:-2], w[2:])) AS z FROM w) x, (SELECT z[1] AS src, z[2] AS tgt) y WHERE length(src) >= 4 AND tgt IS NOT NULL GROUP BY src, tgt)
        SELECT DISTINCT pair_id, src, tgt, CASE WHEN locked THEN 'CRITICAL' ELSE 'MAJOR' END AS severity FROM r JOIN g ON contains(source, src) AND NOT coalesce(contains(target, tgt), false) WHERE role = 'user'
    """,
    "rule_search": rf"""
        WITH RECURSIVE d AS (SELECT a.doc_id AS pair_id, lower(a.text) AS text, lower(coalesce(b.text, '')) AS target FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1),
        u AS (SELECT item_id AS rule_id, lower(substr(text, 3, 5)) AS term, lower(substr(text, 12, 6)) AS tgt FROM benchmark WHERE text IS NOT NULL),
        {_occurrences("o", "SELECT pair_id AS key, text FROM d", "SELECT DISTINCT term, term AS low FROM u WHERE term <> ''")},
        x AS (SELECT item_id + 1000000 AS rule_id, lower(regexp_extract(text, '^([\p{{L}}]+)', 1)) AS term FROM benchmark WHERE text IS NOT NULL),
        {_occurrences("v", "SELECT pair_id AS key, text FROM d", "SELECT term || m AS term, term || m AS low FROM (SELECT DISTINCT term FROM x) y, (SELECT unnest([',', '.']) AS m) z")}
        SELECT key AS pair_id, rule_id, pos - 1 AS start, pos - 1 + length(o.term) AS "end", NOT contains(d.target, tgt) AS would_fire FROM o JOIN u ON u.term = o.term JOIN d ON d.pair_id = o.key
        UNION ALL SELECT key, rule_id, pos - 1, pos + length(x.term), false FROM v JOIN x ON x.term = v.term[:-2]
    """,
}
