"""Text operators over documents, pages and conversations: sentences, masks, frequencies, tables, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.functions import text as X
from lexigate.functions.gates import PII_SHAPES
from lexigate.operators.gate_queries import pairs
from lexigate.sources.tables import table

# Doses a day of the abbreviations, and of the phrases (without accents) of each language.
ABBREVIATIONS = {
    "qd": 1.0, "once daily": 1.0, "once a day": 1.0,
    "bid": 2.0, "twice daily": 2.0, "twice a day": 2.0,
    "tid": 3.0, "three times daily": 3.0, "three times a day": 3.0,
    "qid": 4.0, "four times daily": 4.0, "four times a day": 4.0,
    "qhs": 1.0,
}
FREQUENCIES = {
    "once daily": 1.0, "twice daily": 2.0, "three times daily": 3.0, "four times daily": 4.0,
    "une fois par jour": 1.0, "deux fois par jour": 2.0, "trois fois par jour": 3.0, "quatre fois par jour": 4.0,
    "una vez al dia": 1.0, "dos veces al dia": 2.0, "tres veces al dia": 3.0, "cuatro veces al dia": 4.0,
    "einmal taglich": 1.0, "zweimal taglich": 2.0, "dreimal taglich": 3.0, "viermal taglich": 4.0,
    "una volta al giorno": 1.0, "due volte al giorno": 2.0, "tre volte al giorno": 3.0, "quattro volte al giorno": 4.0,
    "uma vez ao dia": 1.0, "uma vez por dia": 1.0, "duas vezes ao dia": 2.0, "duas vezes por dia": 2.0,
    "tres vezes ao dia": 3.0, "tres vezes por dia": 3.0, "quatro vezes ao dia": 4.0, "quatro vezes por dia": 4.0,
    "1일 1회": 1.0, "하루 한 번": 1.0, "1일 2회": 2.0, "하루 두 번": 2.0, "1일 3회": 3.0, "하루 세 번": 3.0, "1일 4회": 4.0, "하루 네 번": 4.0,
    "每日一次": 1.0, "一天一次": 1.0, "每日两次": 2.0, "每日二次": 2.0, "一天两次": 2.0, "每日三次": 3.0, "一天三次": 3.0, "每日四次": 4.0,
    "1日1回": 1.0, "一日一回": 1.0, "1日2回": 2.0, "一日二回": 2.0, "1日3回": 3.0, "一日三回": 3.0, "1日4回": 4.0, "一日四回": 4.0,
    "مرة في اليوم": 1.0, "مرة يوميا": 1.0, "مرتين في اليوم": 2.0, "مرتين يوميا": 2.0, "ثلاث مرات في اليوم": 3.0, "اربع مرات في اليوم": 4.0,
}
# Accepted renderings of the scale anchors.
ANCHORS = {
    "strongly agree": {"fr": ["tout à fait d'accord", "fortement d'accord"], "es": ["totalmente de acuerdo", "muy de acuerdo"]},
    "agree": {"fr": ["d'accord"], "es": ["de acuerdo"]},
    "neutral": {"fr": ["neutre", "ni d'accord ni pas d'accord"], "es": ["neutral", "ni de acuerdo ni en desacuerdo"]},
    "disagree": {"fr": ["pas d'accord"], "es": ["en desacuerdo"]},
    "strongly disagree": {"fr": ["pas du tout d'accord", "fortement en désaccord"], "es": ["totalmente en desacuerdo", "muy en desacuerdo"]},
}
# Pairs that are translated without a pivot.
DIRECT_PAIRS = [
    "en-fr", "fr-en", "en-de", "de-en", "en-es", "es-en", "en-pt", "pt-en", "en-it", "it-en", "en-nl", "nl-en", "en-ja", "ja-en",
    "en-zh", "zh-en", "en-ko", "ko-en", "en-ar", "ar-en", "fr-de", "de-fr", "es-pt", "pt-es", "fr-es", "es-fr", "fr-it", "it-fr",
]


def frequencies(x: Column) -> Column:
    """(name, doses a day): phrases first, the longest first, each taking its text away; then abbreviations."""
    phrases = sorted(FREQUENCIES.items(), key=lambda p: -len(p[0]))
    table_ = F.array(*[F.struct(F.lit(p).alias("name"), F.lit(n).alias("daily")) for p, n in phrases])
    found = "array<struct<name: string, daily: double>>"

    def take(acc: Column, p: Column) -> Column:
        at = F.instr(acc["rest"], p["name"])
        cut = F.concat(F.substring(acc["rest"], F.lit(1), at - 1), acc["rest"].substr(at + F.length(p["name"]), F.length(acc["rest"])))
        return F.struct(F.when(at > 0, cut).otherwise(acc["rest"]).alias("rest"), F.when(at > 0, F.array_append(acc["out"], p)).otherwise(acc["out"]).alias("out"))

    start = F.struct(X.fold(F.lower(x)).alias("rest"), F.array().cast(found).alias("out"))
    short = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(n).alias("daily")) for a, n in ABBREVIATIONS.items()])
    return F.aggregate(table_, start, take, lambda a: F.concat(a["out"], F.filter(short, lambda s: F.rlike(a["rest"], F.concat(F.lit(r"\b"), s["name"], F.lit(r"\b"))))))


def tables_of(x: Column) -> Column:
    """(rows, columns of the first) of each run of lines that begin with a pipe."""
    one = "array<struct<rows: int, columns: int>>"

    def line(acc: Column, s: Column) -> Column:
        piped = F.trim(s).startswith("|")
        columns = F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) - 1
        last = F.element_at(acc["out"], -1)
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct((last["rows"] + 1).alias("rows"), last["columns"].alias("columns"))))
        fresh = F.array_append(acc["out"], F.struct(F.lit(1).alias("rows"), columns.alias("columns")))
        return F.struct(F.when(~piped, acc["out"]).when(acc["inside"], longer).otherwise(fresh).alias("out"), piped.alias("inside"))

    return F.aggregate(F.split(F.trim(x), "\n", -1), F.struct(F.array().cast(one).alias("out"), F.lit(False).alias("inside")), line, lambda a: a["out"])


def tables_gate(source: Column, target: Column) -> Column:
    """Differences of the tables of two texts: their number, else the rows, else the columns of each."""
    a, b = tables_of(source), tables_of(target)
    each = F.filter(F.transform(F.arrays_zip(a.alias("s"), b.alias("t")), lambda p: F.when(p["s"]["rows"] != p["t"]["rows"], "Table row mismatch").when(p["s"]["columns"] != p["t"]["columns"], "Table column mismatch")), lambda m: m.isNotNull())
    return F.when(F.size(a) != F.size(b), F.array(F.lit("Table count mismatch"))).otherwise(each)


def dates_gate(x: Column, order: str) -> Column:
    """Dates whose parts do not fit the order (DD/MM/YYYY, MM/DD/YYYY or YYYY/MM/DD)."""
    pattern = r"\b(\d{1,4})[/.](\d{1,2})[/.](\d{1,4})\b"
    part = lambda k: F.regexp_extract_all(x, F.lit(pattern), F.lit(k))
    dates = F.arrays_zip(part(0).alias("text"), part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))

    def wrong(d: Column) -> Column:
        a, b, c = (d[k].cast("int") for k in "abc")
        if order == "DD/MM/YYYY":
            return ~(a.between(1, 31) & b.between(1, 12))
        if order == "MM/DD/YYYY":
            return ~(a.between(1, 12) & b.between(1, 31))
        return ~((a > 1900) & b.between(1, 12) & c.between(1, 31))

    return F.transform(F.filter(dates, wrong), lambda d: d["text"])


def anchor_gate(source: Column, target: Column, lang: str) -> Column:
    """True where the source is a scale anchor and the target none of its renderings."""
    key, value = F.lower(F.trim(source)), F.lower(F.trim(target))
    out = F.lit(False)
    for anchor, by_lang in ANCHORS.items():
        out = out | ((key == anchor) & ~value.isin(by_lang[lang]))
    return out


def sentences_regex(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each document, abbreviations minded and long ones capped."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(X.capped(X.sentences(F.col("text")))).alias("order_index", "segment"))
    return x.select("doc_id", F.col("order_index").cast("bigint").alias("order_index"), F.length("segment").cast("bigint").alias("length"))


def pii_mask(spark: SparkSession, d: str) -> DataFrame:
    """Masked documents, the tokens of each, and whether unmasking gives the text back."""
    x = table(spark, d, "documents").select("doc_id", "text", X.mask(F.col("text"), PII_SHAPES).alias("m"))
    return x.where(F.size("m.map") > 0).select("doc_id", F.size("m.map").cast("bigint").alias("tokens"), (X.unmask(F.col("m.masked"), F.reverse("m.map")) == F.col("text")).alias("reversible"))


def gate_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Dosing frequencies of pairs whose daily doses differ."""
    daily = lambda c: F.array_sort(F.transform(frequencies(F.col(c)), lambda f: f["daily"]))
    x = pairs(spark, d).select("conv_id", "turn", daily("source").alias("s"), daily("target").alias("t"))
    return x.where("s <> t").select("conv_id", "turn", F.array_join(F.transform("s", lambda v: v.cast("string")), ",").alias("s"), F.array_join(F.transform("t", lambda v: v.cast("string")), ",").alias("t"))


def gate_tables(spark: SparkSession, d: str) -> DataFrame:
    """Table differences between a page's text and itself without its first table row."""
    html = F.regexp_replace(F.regexp_replace("html", r"<tr[^>]*>", "\n|"), r"</t[dh]>", "|")
    x = table(spark, d, "pages").select("page_id", F.regexp_replace(html, r"<[^>]*>", "").alias("a"))
    return x.select("page_id", F.explode(tables_gate(F.col("a"), F.regexp_replace("a", r"\n\|.*", ""))).alias("message"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document, by the shared notion of a word."""
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("bigint").alias("n"))


def event_json(spark: SparkSession, d: str) -> DataFrame:
    """Payloads read out of fenced or wrapped text."""
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("note: "), "props", F.lit(" end")))
    return table(spark, d, "events").select("event_id", F.get_json_object(X.tolerant_json(wrapped), "$.k").cast("bigint").alias("k"))


def route_plan(spark: SparkSession, d: str) -> DataFrame:
    """Route of each language pair of documents: direct, or through English in two steps."""
    langs = table(spark, d, "documents").select("lang").distinct()
    p = langs.select(F.col("lang").alias("source")).join(langs.select(F.col("lang").alias("target")), F.col("source") != F.col("target"))
    direct = F.concat_ws("-", "source", "target").isin(DIRECT_PAIRS) | (F.col("source") == "en") | (F.col("target") == "en")
    step = lambda a, b: F.concat_ws("-", a, b)
    steps = F.when(direct, F.array(step("source", "target"))).otherwise(F.array(step("source", F.lit("en")), step(F.lit("en"), "target")))
    return p.select("source", "target", F.when(direct, "direct").otherwise("pivot").alias("route"), F.array_join(steps, ",").alias("steps"))


def conservation(spark: SparkSession, d: str) -> DataFrame:
    """Whether a revision changed text outside the flagged span (the first 20 characters)."""
    x = table(spark, d, "documents").select("doc_id", F.col("text").alias("original"))
    revised = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("changed "), F.col("original").substr(F.lit(21), F.length("original")))).otherwise(F.upper("original"))
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(20).alias("end")))
    return x.select("doc_id", X.conserved(F.col("original"), revised, spans).alias("accepted"))


def layout_disposition(spark: SparkSession, d: str) -> DataFrame:
    """Lines as layout blocks (document = source, page = document): drop, keep as they are, or translate."""
    norm = F.regexp_replace(F.regexp_replace(F.lower(F.trim("s")), r"\s+", " "), r"\d", "#")
    b = table(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n", -1)).alias("s")).where(F.trim("s") != "").withColumn("norm", norm)
    repeated = b.where(F.length("norm").between(2, 80)).groupBy("source", "norm").agg(F.count_distinct("doc_id").alias("pages")).where("pages >= 2")
    letters = F.length(F.regexp_replace("s", r"\P{L}", ""))
    identifier = (F.length(F.trim("s")) - letters) > 0.6 * F.length(F.trim("s"))
    kind = F.when(F.col("pages").isNotNull(), "repeated").when(identifier, "identifier").otherwise("content")
    return b.join(repeated, ["source", "norm"], "left").select("source", kind.alias("kind")).groupBy("source", "kind").agg(F.count("*").alias("n"))


def last_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The extra occurrences of a multiset difference, with their details: the last ones of each group."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("place", F.row_number().over(w))
    other = table(spark, d, "events").where("event_id % 5 <> 0").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return e.join(other, ["user_id", "event_type"], "left").where(F.col("place") > F.coalesce("n", F.lit(0))).select("event_id", "user_id", "event_type")


QUERIES = {f.__name__: f for f in (sentences_regex, pii_mask, gate_frequency, gate_tables, word_counts, event_json, route_plan, conservation, layout_disposition, last_per_group)}
ORACLE_SQL = {
    "word_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D\\x{A0}\\x{3000}]+')) AS BIGINT) AS n FROM documents",
    "event_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "route_plan": "WITH l AS (SELECT DISTINCT lang FROM documents), p AS (SELECT a.lang AS source, b.lang AS target FROM l a JOIN l b ON a.lang <> b.lang), r AS (SELECT *, source = 'en' OR target = 'en' OR source || '-' || target IN (" + ", ".join(f"'{x}'" for x in DIRECT_PAIRS) + ") AS direct FROM p) SELECT source, target, CASE WHEN direct THEN 'direct' ELSE 'pivot' END AS route, CASE WHEN direct THEN source || '-' || target ELSE source || '-en,en-' || target END AS steps FROM r",
    "last_per_group": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS place FROM events), o AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY user_id, event_type) SELECT e.event_id, e.user_id, e.event_type FROM e LEFT JOIN o ON e.user_id = o.user_id AND e.event_type = o.event_type WHERE place > coalesce(n, 0)",
}
