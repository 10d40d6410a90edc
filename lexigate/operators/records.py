"""Records: lists, lookups, trails, packs, certificates, evaluation suites and small functions over them.

Orders stand for jobs, events for the activity log, conversations for segment pairs,
documents for evaluation cases; suppliers' and parts' names for glossary terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.functions import gates
from lexigate.functions import text as X
from lexigate.operators.gate_queries import pairs
from lexigate.operators.planted_gates import planted
from lexigate.sources.tables import table

# Agents of the activity feed, and the statuses that a feedback filter takes.
AGENTS = {"signup": "Intake", "click": "Translator", "purchase": "Reviewer", "error": "Guard"}
STATES = ["low", "high"]


def segment_list(spark: SparkSession, d: str) -> DataFrame:
    """Turns of every conversation with their place in it, from 1."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("bigint").alias("place"), F.length("text").cast("bigint").alias("chars"))


def job_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with the number of its events and its newest one; 0 and null where it has none."""
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "newest")


def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    """Log entries of the users that belong to five tenants."""
    members = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(members, "user_id", "left_semi").select("event_id", "user_id", "event_type")


def feedback_list(spark: SparkSession, d: str, kind: str = "error", state: str = "high") -> DataFrame:
    """Second page of a filtered list, newest first, 20 a page; unknown filter values raise."""
    if kind not in [*AGENTS, "view"] or state not in STATES:
        raise ValueError(f"no such filter: {kind}, {state}")
    e = table(spark, d, "events").where(F.col("event_type") == kind).where((F.col("value") > 50) == (state == "high"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).offset(20).limit(20).select("event_id", "user_id", "value")


def deletions_newest(spark: SparkSession, d: str) -> DataFrame:
    """The 50 newest removals (returned lines), with what was removed."""
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return gone.orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", "l_quantity")


def agent_activity(spark: SparkSession, d: str) -> DataFrame:
    """Events of the four agents only, under the agent's name, by user."""
    names = F.create_map(*[F.lit(x) for p in AGENTS.items() for x in p])
    e = table(spark, d, "events").withColumn("agent", F.try_element_at(names, F.col("event_type"))).where("agent is not null")
    return e.groupBy("user_id", "agent").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def identifier_resolves(spark: SparkSession, d: str) -> DataFrame:
    """Job of each identifier found in a payload, null where there is none."""
    ids = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("o_orderkey"))
    jobs = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return ids.join(jobs, "o_orderkey", "left").select("event_id", F.when(F.col("o_orderstatus").isNotNull(), F.col("o_orderkey")).alias("job"), "o_orderstatus")


def certificate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Certificate line of each pair: place in its conversation and 50 characters of each side."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    short = lambda c: F.substring(c, 1, 50)
    p = pairs(spark, d)
    return p.select("conv_id", "turn", F.concat(F.row_number().over(w).cast("string"), F.lit(". "), short("source"), F.lit(" -> "), short("target")).alias("line"))


def export_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a conversation's turns as it would be exported: its stored answer by trimmed text, or itself."""
    memory = pairs(spark, d).groupBy(F.trim("source").alias("k")).agg(F.max_by("target", F.struct("conv_id", "turn")).alias("stored"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.trim("text").alias("k"))
    out = F.coalesce("stored", "text")
    return turns.join(memory, "k", "left").select("conv_id", "turn", "role", F.sha2(out, 256).alias("out_sha256"))


def glossary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each nation by case-insensitive name, where the term's language is the nation's or blank."""
    terms = table(spark, d, "nation").select(F.upper("n_name").alias("term"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_regionkey").cast("string")).alias("lang"))
    asked = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("asked"), F.pmod("s_suppkey", F.lit(5)).cast("string").alias("wanted"))
    hit = asked.join(terms, F.lower("term") == F.col("asked")).where((F.col("lang") == F.col("wanted")) | (F.col("lang") == ""))
    return hit.select("s_suppkey", "term", "lang")


def glossary_latest(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each brand's latest version (versions in order of their strings): the glossary of a constraint pack."""
    t = table(spark, d, "part").select("p_brand", F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("version"), "p_name")
    latest = t.groupBy("p_brand").agg(F.max("version").alias("version"))
    return t.join(latest, ["p_brand", "version"]).groupBy("p_brand", "version").agg(F.count("*").alias("terms"), F.min("p_name").alias("first_term"))


def semver_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest version of each brand's profile by its three numbers, not by its string."""
    v = F.struct(F.floor(F.col("p_size") / 20).cast("int").alias("a"), (F.col("p_size") % 20).alias("b"), F.pmod("p_partkey", F.lit(12)).cast("int").alias("c"))
    top = table(spark, d, "part").groupBy("p_brand").agg(F.max(v).alias("v"))
    return top.select("p_brand", F.concat_ws(".", *[F.col(f"v.{x}").cast("string") for x in "abc"]).alias("version"))


def median_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Median line length of each source: of lines over 40 characters, of all where there is none."""
    lines = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n", -1)).alias("s")).select("source", F.length("s").alias("n"))
    body = F.percentile(F.when(F.col("n") > 40, F.col("n")), 0.5)
    return lines.groupBy("source").agg(F.coalesce(body, F.percentile("n", 0.5)).alias("median"))


def canonical_record(spark: SparkSession, d: str) -> DataFrame:
    """Signature of each job's canonical JSON: keys in order, no spaces."""
    body = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    return table(spark, d, "orders").select("o_orderkey", F.sha2(body, 256).alias("signature"))


def payload_check(spark: SparkSession, d: str) -> DataFrame:
    """Signed payload against the columns beside it, after planted changes: signature, and which columns drifted."""
    o = table(spark, d, "orders")
    signed = F.to_json(F.struct(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status")))
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    payload = F.when(F.col("o_orderkey") % 11 == 0, F.regexp_replace(signed, '"job":', '"job":9')).otherwise(signed)
    x = o.select("o_orderkey", status.alias("status"), F.sha2(signed, 256).alias("signature"), payload.alias("payload"))
    drift = F.array_compact(F.array(F.when(F.get_json_object("payload", "$.status") != F.col("status"), "status"), F.when(F.get_json_object("payload", "$.job") != F.col("o_orderkey").cast("string"), "job")))
    return x.select("o_orderkey", (F.sha2("payload", 256) == F.col("signature")).alias("hash_valid"), (F.size(drift) == 0).alias("index_integrity"), F.array_join(drift, ",").alias("drifted"))


def redact(x: Column, shapes: dict[str, str] = gates.PII_SHAPES, remove: bool = False) -> Column:
    """The text with every match of each shape in turn as [KIND], or taken out."""
    for kind, pattern in shapes.items():
        x = F.regexp_replace(x, pattern, "" if remove else f"[{kind}]")
    return x


def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that redaction changes: length before and after, and how many marks of each of two kinds."""
    t = table(spark, d, "documents").select("doc_id", "text", redact(F.col("text")).alias("r")).where("r <> text")
    marks = lambda k: F.floor((F.length("r") - F.length(F.replace("r", F.lit(f"[{k}]"), F.lit("")))) / (len(k) + 2))
    return t.select("doc_id", F.length("text").alias("before"), F.length("r").alias("after"), marks("EMAIL").alias("emails"), marks("IPV4").alias("addresses"))


def _places(rule: str):
    """Whether a literal is in each text, and where: offsets of every occurrence, overlapping ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                at = []
                while (i := text.find(rule, at[-1] + 1 if at else 0)) >= 0:
                    at.append(i)
                found.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([",".join(map(str, x)) for x in found], pa.string()), pa.array([bool(x) for x in found], pa.bool_())], ["doc_id", "offsets", "fires"])

    return run


def rule_test(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of every match of a rule's literal in the first line of a document, overlapping ones too, and whether it would fire."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.lower(F.substring_index("text", "\n", 1)).alias("line"))
    return lines.mapInArrow(_places("an"), f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, offsets string, fires boolean")


def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    """Flagged spans of each job (from its lines) merged where they touch: how many are left and what they cover."""
    start = F.col("l_partkey") % 200
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(start.alias("a"), (start + F.col("l_quantity").cast("bigint")).alias("b")))).alias("s"))

    def add(acc: Column, x: Column) -> Column:
        joined = x["a"] <= acc["end"]
        return F.struct((acc["n"] + F.when(joined, 0).otherwise(1)).alias("n"), (acc["covered"] + F.greatest(x["b"] - F.greatest(acc["end"], x["a"]), F.lit(0))).alias("covered"), F.greatest(acc["end"], x["b"]).alias("end"))

    first = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("covered"), F.lit(-1).cast("bigint").alias("end"))
    return s.select("l_orderkey", F.aggregate("s", first, add).alias("r")).select("l_orderkey", F.col("r.n").cast("bigint").alias("spans"), "r.covered")


def _matched(actual: Column, matcher: str, expected) -> Column:
    """One assertion of an evaluation case; null never passes."""
    tests = {
        "exact": lambda: actual == expected,
        "contains": lambda: F.contains(actual, F.lit(expected)),
        "excludes": lambda: ~F.contains(actual, F.lit(expected)),
        "range": lambda: actual.cast("double").between(*expected),
        "regex": lambda: actual.rlike(expected),
    }
    return F.coalesce(tests[matcher](), F.lit(False))


#: Assertions over a case's JSON: path, matcher, what is expected.
ASSERTIONS = [("$.lang", "exact", "en"), ("$.tags[0]", "contains", "a"), ("$.head", "excludes", "zz"), ("$.n", "range", (100, 5000)), ("$.head", "regex", "^[A-Z]")]


def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    """Documents as evaluation cases of some tags: assertions that fail, by path and matcher, and whether the case passes."""
    head = F.substring_index("text", " ", 1)
    body = F.to_json(F.struct(F.col("lang"), F.array("source", "lang").alias("tags"), head.alias("head"), F.col("n_chars").alias("n")))
    cases = table(spark, d, "documents").withColumn("body", body).where(F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("en"), F.lit("fr"))))
    failed = F.array_compact(F.array(*[F.when(~_matched(F.get_json_object("body", p), m, e), F.lit(f"{p}:{m}")) for p, m, e in ASSERTIONS]))
    return cases.select("doc_id", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passed"))


def golden_suite(spark: SparkSession, d: str) -> DataFrame:
    """Canonical cases pass without a critical finding, tampered ones with the expected one, by category: counts of both."""
    p = planted(spark, d, "units").withColumn("found", F.transform(gates.units(F.col("source"), F.col("target")), lambda x: x["category"]))
    tampered = F.col("doc_id") % 2 == 1
    ok = F.when(tampered, F.size(F.array_except(F.array(F.lit("UNIT_MISMATCH")), "found")) == 0).otherwise(F.size("found") == 0)
    return p.groupBy(F.when(tampered, "tampered").otherwise("canonical").alias("kind")).agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"))


def label_universe(spark: SparkSession, d: str) -> DataFrame:
    """Binary label of every document over the whole universe: flagged, else clean."""
    flagged = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("hit", F.lit(1))
    return table(spark, d, "documents").select("doc_id").join(flagged, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(0)).alias("label"))


def gold_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the gold set is fit for use: not empty, with planted and clean cases, every key present."""
    return table(spark, d, "labels").agg(F.count("*").alias("n"), (F.count_if(F.col("toxic") == 1) > 0).alias("has_planted"), (F.count_if(F.col("toxic") == 0) > 0).alias("has_clean"), (F.count_if(F.col("doc_id").isNull() | F.col("quality").isNull()) == 0).alias("complete"))


def parser_report(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of two ways to parse each page (by tags, by lines), tables, figures, and a mark of broken encoding."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("bigint")
    return table(spark, d, "pages").select("page_id", n("<(?:p|li|h[1-6]|td)[ >]").alias("by_tag"), F.size(F.filter(F.split("html", "\n", -1), lambda s: F.trim(s) != "")).cast("bigint").alias("by_line"), n("<table[ >]").alias("tables"), n("<img[ >]").alias("figures"), F.contains("html", F.lit("�")).alias("mojibake"))


def language_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each turn by the strategy of its language (script of the text): CJK, Latin, else split at dots; with ids."""
    cjk = F.col("text").rlike(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]")
    naive = F.filter(F.transform(F.split("text", r"\."), lambda s: F.trim(s)), lambda s: s != "")
    parts = F.when(cjk, X.cjk_sentences(F.col("text"))).when(F.col("turn") % 2 == 0, F.filter(F.split("text", r"(?<=[.!?]) +"), lambda s: s != "")).otherwise(naive)
    x = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(parts).alias("i", "s"))
    return x.select(F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit("_seg_"), F.col("i").cast("string")).alias("segment_id"), F.sha2("s", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (segment_list, job_event_counts, audit_trail, feedback_list, deletions_newest, agent_activity, identifier_resolves, certificate_lines, export_lookup, glossary_lookup, glossary_latest, semver_latest, median_sizes, canonical_record, payload_check, redacted_documents, rule_test, merged_spans, eval_cases, golden_suite, label_universe, gold_integrity, parser_report, language_dispatch)}

_PAIRS = "pairs AS (SELECT conv_id, turn, text AS source, target FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) t WHERE role = 'user' AND next_role = 'assistant')"
_red = "text"
for _k, _v in gates.PII_SHAPES.items():
    _red = f"regexp_replace({_red}, '{_v}', '[{_k}]', 'g')"
_marks = lambda k: f"CAST((length(r) - length(replace(r, '[{k}]', ''))) // {len(k) + 2} AS BIGINT)"
_UNITS = "|".join(gates.UNITS)
ORACLE_SQL = {
    "segment_list": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, length(text) AS chars FROM conversations",
    "job_event_counts": "SELECT c_custkey, count(event_id) AS n, arg_max(event_id, (ts, event_id)) AS newest FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey",
    "audit_trail": "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)",
    "feedback_list": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 50 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20",
    "deletions_newest": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 50",
    "agent_activity": "SELECT user_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AGENTS.items()) + " END AS agent, count(*) AS n, max(event_id) AS last FROM events WHERE event_type <> 'view' GROUP BY user_id, event_type",
    "identifier_resolves": "SELECT event_id, o_orderkey AS job, o_orderstatus FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e LEFT JOIN orders ON o_orderkey = k",
    "certificate_lines": f"WITH {_PAIRS} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '. ' || substr(source, 1, 50) || ' -> ' || substr(target, 1, 50) AS line FROM pairs",
    "export_lookup": f"WITH {_PAIRS}, m AS (SELECT trim(source, ' ') AS k, arg_max(target, (conv_id, turn)) AS stored FROM pairs GROUP BY 1) SELECT conv_id, turn, role, sha256(coalesce(stored, text)) AS out_sha256 FROM conversations LEFT JOIN m ON k = trim(text, ' ')",
    "glossary_lookup": "SELECT s_suppkey, upper(n_name) AS term, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_regionkey::VARCHAR END AS lang FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 OR n_regionkey = s_suppkey % 5",
    "glossary_latest": "WITH t AS (SELECT p_brand, 'v' || p_size AS version, p_name FROM part), l AS (SELECT p_brand, max(version) AS version FROM t GROUP BY p_brand) SELECT p_brand, version, count(*) AS terms, min(p_name) AS first_term FROM t JOIN l USING (p_brand, version) GROUP BY p_brand, version",
    "semver_latest": "SELECT p_brand, a || '.' || b || '.' || c AS version FROM (SELECT p_brand, p_size // 20 AS a, p_size % 20 AS b, p_partkey % 12 AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_size // 20 DESC, p_size % 20 DESC, p_partkey % 12 DESC) AS r FROM part) t WHERE r = 1",
    "median_sizes": "SELECT source, coalesce(quantile_cont(n, 0.5) FILTER (WHERE n > 40), quantile_cont(n, 0.5))::DOUBLE AS median FROM (SELECT source, length(unnest(string_split(text, chr(10)))) AS n FROM documents) t GROUP BY source",
    "canonical_record": """SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"id":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS signature FROM orders""",
    "payload_check": "SELECT o_orderkey, o_orderkey % 11 <> 0 AS hash_valid, NOT (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) AS index_integrity, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'status,job' ELSE 'status' END WHEN o_orderkey % 11 = 0 THEN 'job' ELSE '' END AS drifted FROM orders",
    "redacted_documents": f"SELECT doc_id, length(text) AS before, length(r) AS after, {_marks('EMAIL')} AS emails, {_marks('IPV4')} AS addresses FROM (SELECT doc_id, text, {_red} AS r FROM documents) t WHERE r <> text",
    "rule_test": "SELECT doc_id, array_to_string(o, ',') AS offsets, len(o) > 0 AS fires FROM (SELECT doc_id, list_filter(range(0, length(line) - 1), lambda i: substr(lower(line), i + 1, 2) = 'an') AS o FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents WHERE text IS NOT NULL) a) t",
    "merged_spans": "WITH s AS (SELECT l_orderkey, l_partkey % 200 AS a, l_partkey % 200 + CAST(l_quantity AS BIGINT) AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s) SELECT l_orderkey, count(*) FILTER (WHERE e IS NULL OR a > e) AS spans, CAST(sum(greatest(b - greatest(coalesce(e, -1), a), 0)) AS BIGINT) AS covered FROM m GROUP BY l_orderkey",
    "eval_cases": "SELECT doc_id, array_to_string(f, ',') AS failed, len(f) = 0 AS passed FROM (SELECT doc_id, list_filter([CASE WHEN lang = 'en' THEN NULL ELSE '$.lang:exact' END, CASE WHEN contains(source, 'a') THEN NULL ELSE '$.tags[0]:contains' END, CASE WHEN NOT contains(h, 'zz') THEN NULL ELSE '$.head:excludes' END, CASE WHEN n_chars BETWEEN 100 AND 5000 THEN NULL ELSE '$.n:range' END, CASE WHEN regexp_matches(h, '^[A-Z]') THEN NULL ELSE '$.head:regex' END], lambda x: x IS NOT NULL) AS f FROM (SELECT *, string_split(text, ' ')[1] AS h FROM documents WHERE lang IN ('en', 'fr') OR source IN ('en', 'fr')) a) t",
    "golden_suite": "SELECT CASE WHEN doc_id % 2 = 1 THEN 'tampered' ELSE 'canonical' END AS kind, count(*) AS cases, count(*) FILTER (WHERE (doc_id % 2 = 1) = bad) AS passed FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id // 4 % 3 <> 0 WHEN 1 THEN doc_id // 4 % 3 <> 1 WHEN 2 THEN true ELSE false END AS bad FROM documents) t GROUP BY 1",
    "label_universe": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS label FROM documents",
    "gold_integrity": "SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) > 0 AS has_planted, count(*) FILTER (WHERE toxic = 0) > 0 AS has_clean, count(*) FILTER (WHERE doc_id IS NULL OR quality IS NULL) = 0 AS complete FROM labels",
    "parser_report": "SELECT page_id, len(regexp_extract_all(html, '<(?:p|li|h[1-6]|td)[ >]')) AS by_tag, len(list_filter(string_split(html, chr(10)), lambda s: trim(s, ' ') <> '')) AS by_line, len(regexp_extract_all(html, '<table[ >]')) AS tables, len(regexp_extract_all(html, '<img[ >]')) AS figures, contains(html, '�') AS mojibake FROM pages",
}
