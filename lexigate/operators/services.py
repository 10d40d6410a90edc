"""Glossaries of language pairs and their export, costs of calls, routing by organisation, similarity of back-translations, results of documents and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigate.sources.tables import table

#: What may be routed, where to, who may change it, and what holds without a rule.
TASKS, COMPLEXITIES, TIERS = ("translate", "judge", "repair"), ("low", "medium", "high"), ("economy", "balanced", "premium")
MAY_ROUTE = ("ADMIN", "PROJECT_MANAGER")
DEFAULT_TIER = "balanced"
#: Rates of a thousand tokens, in and out, of models without their own, and letters of a token where none can be counted.
RATE_IN, RATE_OUT, LETTERS = 0.01, 0.03, 4


def terms_for_pairs(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Terms of every language pair: those whose languages are the pair's, or blank or null on either side.

    Terms: source_lang, target_lang and others; pairs: source, target. A pair is looked up by the four
    combinations of its languages and blanks, so that no pair meets a term of other languages. Equal pairs count once.
    """
    blank = F.lit("")
    keys = F.array_distinct(F.array(*[F.struct(a.alias("s"), b.alias("t")) for a in (F.col("source"), blank) for b in (F.col("target"), blank)]))
    asked = pairs.select("source", "target").distinct().withColumn("key", F.explode(keys)).select("source", "target", F.col("key.s").alias("s"), F.col("key.t").alias("t"))
    own = terms.withColumn("s", F.coalesce("source_lang", blank)).withColumn("t", F.coalesce("target_lang", blank))
    return asked.join(own, ["s", "t"]).drop("s", "t")


def glossary_csv(terms: DataFrame) -> DataFrame:
    """(term_id, line): each term as a line of CSV: term_id, source_text, target_text, is_forbidden, allowed_variants as a JSON list.

    Fields are quoted where they hold a comma, quote or line break; nulls are empty, null variants an empty list.
    """
    field = lambda c: F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    variants = F.to_json(F.coalesce("allowed_variants", F.array().cast("array<string>")))
    variants = F.replace(variants, F.lit('","'), F.lit('", "'))  # a space behind commas
    forbidden = F.when(F.coalesce("is_forbidden", F.lit(False)), "True").otherwise("False")
    columns = [F.col("term_id").cast("string"), F.col("source_text"), F.col("target_text"), forbidden, variants]
    return terms.select("term_id", F.concat_ws(",", *[field(c) for c in columns]).alias("line"))


def estimated_tokens(text: Column) -> Column:
    """Tokens of a text where no tokenizer is at hand: one for LETTERS letters, rounded down; a null text has none."""
    return F.floor(F.coalesce(F.char_length(text), F.lit(0)) / LETTERS)


def call_costs(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Calls (provider, model, input_tokens, output_tokens) with cost; rates: model, rate_in, rate_out for a thousand tokens, one row a model."""
    x = calls.join(F.broadcast(rates), "model", "left")
    cost = F.col("input_tokens") / 1000 * F.coalesce("rate_in", F.lit(RATE_IN)) + F.col("output_tokens") / 1000 * F.coalesce("rate_out", F.lit(RATE_OUT))
    return x.withColumn("cost", cost).select(*calls.columns, "cost")


def checked_policies(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(policies, rejects) of routing changes: org_id, at, role, enabled, overrides (a map of ``task:complexity`` to tier).

    A change counts where its role may route and all of its overrides are known; the last one of an
    organisation holds, all of it. A null map is an empty one. Rejects have a reason.
    """
    known = F.array(*[F.lit(f"{t}:{c}") for t in TASKS for c in COMPLEXITIES])
    keys, tiers = F.map_keys("overrides"), F.map_values("overrides")
    why = (
        F.when(~F.coalesce(F.col("role").isin(*MAY_ROUTE), F.lit(False)), "no permission")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown key")
        .when(F.exists(tiers, lambda t: ~F.coalesce(t.isin(*TIERS), F.lit(False))), "unknown tier")
    )
    told = changes.withColumn("reason", why)
    last = F.max_by(F.struct("enabled", "overrides"), F.struct("at", "enabled"))
    good = told.where("reason is null").groupBy("org_id").agg(last.alias("p")).select("org_id", "p.enabled", F.coalesce("p.overrides", F.create_map().cast("map<string,string>")).alias("overrides"))
    return good, told.where("reason is not null")


def routed(calls: DataFrame, policies: DataFrame, base: dict[str, str]) -> DataFrame:
    """Calls (org_id, task, complexity) with tier: of the organisation's policy where it is enabled, else of the base, else balanced."""
    key = F.concat_ws(":", "task", "complexity")
    held = F.create_map(*[F.lit(x) for item in base.items() for x in item]) if base else F.create_map().cast("map<string,string>")
    x = calls.join(policies.where("enabled").select("org_id", "overrides"), "org_id", "left")
    return x.withColumn("tier", F.coalesce(F.try_element_at("overrides", key), F.try_element_at(held, key), F.lit(DEFAULT_TIER))).select(*calls.columns, "tier")


def back_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors times 100, held between 0 and 100; null where one is null, empty, of another length, or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cosine = F.when((F.size(a) == F.size(b)) & (size > 0), F.try_divide(dot(a, b), size))
    return F.when(cosine.isNotNull() & ~F.isnan(cosine), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * cosine)))


def export_summaries(verdicts: DataFrame) -> DataFrame:
    """One row for each export: blocks, classes and strategies with their counts, font substitutions, degraded, and which blocks are.

    Verdicts: export_id, block_id, class, strategy, font_substituted, overflow. A block is degraded where it
    overflows or is escalated; null strategies are not counted, null marks are false.
    """
    bad = F.coalesce("overflow", F.lit(False)) | (F.coalesce("strategy", F.lit("")) == "ESCALATE")
    counts = lambda c, name: verdicts.where(F.col(c).isNotNull()).groupBy("export_id", c).agg(F.count("*").alias("n")).groupBy("export_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name))
    whole = verdicts.groupBy("export_id").agg(F.count("*").alias("blocks"), F.count_if(F.coalesce("font_substituted", F.lit(False))).alias("font_substitutions"), F.count_if(bad).alias("n_degraded"), F.array_sort(F.collect_list(F.when(bad, F.col("block_id")))).alias("degraded_blocks"))
    out = whole.join(counts("class", "by_class"), "export_id", "left").join(counts("strategy", "by_strategy"), "export_id", "left")
    return out.withColumn("degraded", F.col("n_degraded") > 0).drop("n_degraded")


def glossary_for_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Number of terms, and the first of them, of each pair of languages in which documents stand."""
    lang = lambda n: F.when(F.col("p_partkey") % n == 0, "").when(F.col("p_partkey") % n == 1, None).when(F.col("p_partkey") % n == 2, "en").when(F.col("p_partkey") % n == 3, "fr").otherwise("de")
    terms = table(spark, d, "part").select("p_partkey", "p_name", lang(5).alias("source_lang"), lang(7).alias("target_lang"))
    langs = table(spark, d, "documents").where("lang is not null").select("lang").distinct()
    near = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])
    pairs = langs.select(F.col("lang").alias("source"), F.explode(near).alias("target")).where("source <> target")
    return terms_for_pairs(terms, pairs).groupBy("source", "target").agg(F.count("*").alias("terms"), F.min("p_name").alias("first"))


def glossary_export(spark: SparkSession, d: str) -> DataFrame:
    """Lines of CSV of the glossary of parts, with quotes, commas and variants."""
    part = table(spark, d, "part")
    variants = F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand", F.concat(F.lit("x, "), "p_type"))).when(F.col("p_partkey") % 3 == 1, F.array().cast("array<string>"))
    source = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('5", '), "p_name")).otherwise(F.col("p_name"))
    return glossary_csv(part.select(F.col("p_partkey").alias("term_id"), source.alias("source_text"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("target_text"), (F.col("p_partkey") % 7 == 0).alias("is_forbidden"), variants.alias("allowed_variants")))


def token_cost_totals(spark: SparkSession, d: str) -> DataFrame:
    """Calls, tokens and cost of each model: a call for each turn of a conversation, its tokens estimated."""
    c = table(spark, d, "conversations")
    reply = F.col("role") == "assistant"
    n = estimated_tokens(F.col("text"))
    model = F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string"))
    calls = c.select(F.lit("p").alias("provider"), model.alias("model"), F.when(~reply, n).otherwise(0).alias("input_tokens"), F.when(reply, n).otherwise(0).alias("output_tokens"))
    rates = spark.createDataFrame([("model-0", 0.0025, 0.01), ("model-1", 0.00015, 0.0006)], "model string, rate_in double, rate_out double")
    costs = call_costs(calls, rates)
    return costs.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def routing_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each nation by tier, under the policies that its suppliers' changes leave."""
    s = table(spark, d, "supplier")
    pick = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), (c % len(xs)).cast("int"))
    k = F.col("s_suppkey")
    override = F.create_map(F.concat_ws(":", pick([*TASKS, "sing"], k), pick(COMPLEXITIES, k)), pick([*TIERS, "free"], F.floor(k / 4)))
    changes = s.select(F.col("s_nationkey").alias("org_id"), k.alias("at"), pick(["ADMIN", "PROJECT_MANAGER", "REVIEWER"], k).alias("role"), (k % 5 != 0).alias("enabled"), override.alias("overrides"))
    good, _ = checked_policies(changes)
    calls = table(spark, d, "customer").select(F.col("c_nationkey").alias("org_id"), pick(TASKS, F.col("c_custkey")).alias("task"), pick(COMPLEXITIES, F.floor(F.col("c_custkey") / 3)).alias("complexity"))
    return routed(calls, good, {"translate:low": "economy", "translate:high": "premium", "judge:high": "premium"}).groupBy("org_id", "tier").agg(F.count("*").alias("calls"))


def back_translation_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each vector to the one before it by id, null for the first of them."""
    e = table(spark, d, "embeddings")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    return e.join(before, "vec_id", "left").select("vec_id", F.round(back_similarity(F.col("embedding"), F.col("before")), 4).alias("similarity"))


def export_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Summary of every order as an export whose line items are blocks."""
    li = table(spark, d, "lineitem")
    strategy = F.when(F.col("l_quantity") > 45, "ESCALATE").when(F.col("l_quantity") > 20, "SHRINK").when(F.col("l_quantity") > 10, "FIT")
    x = export_summaries(li.select(F.col("l_orderkey").alias("export_id"), F.col("l_linenumber").alias("block_id"), F.col("l_returnflag").alias("class"), strategy.alias("strategy"), (F.col("l_linestatus") == "F").alias("font_substituted"), (F.col("l_discount") >= 0.1).alias("overflow")))
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return x.select("export_id", "blocks", F.coalesce(flat("by_class"), F.lit("")).alias("by_class"), F.coalesce(flat("by_strategy"), F.lit("")).alias("by_strategy"), "font_substitutions", "degraded", F.array_join(F.transform("degraded_blocks", lambda b: b.cast("string")), ",").alias("degraded_blocks"))


def document_results(spark: SparkSession, d: str) -> DataFrame:
    """Result of each conversation: mean confidence of its turns, number of defects, and the digest of its turns, line by line."""
    size = F.char_length(F.coalesce("text", F.lit("")))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), (size % 101).alias("confidence"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[!?]")).alias("defects"))
    g = turns.groupBy("conv_id").agg(F.round(F.avg("confidence"), 4).alias("confidence"), F.sum("defects").alias("defects"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return g.select("conv_id", "confidence", "defects", F.sha2(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), 256).alias("digest"))


QUERIES = {f.__name__: f for f in (glossary_for_pairs, glossary_export, token_cost_totals, routing_overrides, back_translation_similarity, export_fidelity, document_results)}
_lang = lambda n: f"CASE p_partkey % {n} WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'en' WHEN 3 THEN 'fr' ELSE 'de' END"
_pick = lambda xs, c: "[" + ", ".join(f"'{x}'" for x in xs) + f"][{c} % {len(xs)} + 1]"
_quote = lambda c: f"""CASE WHEN regexp_matches({c}, '[,"\\r\\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE coalesce({c}, '') END"""
ORACLE_SQL = {
    "glossary_for_pairs": f"WITH t AS (SELECT p_name, {_lang(5)} AS s, {_lang(7)} AS t FROM part), p AS (SELECT lang AS source, target FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l, (SELECT unnest(['en', 'fr', 'de', 'es']) AS target) x WHERE lang <> target) SELECT source, target, count(*) AS terms, min(p_name) AS first FROM p JOIN t ON (t.s = source OR coalesce(t.s, '') = '') AND (t.t = target OR coalesce(t.t, '') = '') GROUP BY source, target",
    "glossary_export": f"""
        WITH x AS (SELECT p_partkey AS term_id, CASE WHEN p_partkey % 4 = 0 THEN '5", ' || p_name ELSE p_name END AS s, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS t, CASE WHEN p_partkey % 7 = 0 THEN 'True' ELSE 'False' END AS f, CASE WHEN p_partkey % 3 = 0 THEN '["' || p_brand || '", "x, ' || p_type || '"]' ELSE '[]' END AS v FROM part)
        SELECT term_id, term_id || ',' || {_quote("s")} || ',' || {_quote("t")} || ',' || f || ',' || {_quote("v")} AS line FROM x
    """,
    "token_cost_totals": "WITH c AS (SELECT 'model-' || conv_id % 3 AS model, conv_id % 3 AS m, CASE WHEN role <> 'assistant' THEN length(text) // 4 ELSE 0 END AS i, CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS o FROM conversations) SELECT model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(i / 1000.0::DOUBLE * CASE m WHEN 0 THEN 0.0025 WHEN 1 THEN 0.00015 ELSE 0.01 END::DOUBLE + o / 1000.0::DOUBLE * CASE m WHEN 0 THEN 0.01 WHEN 1 THEN 0.0006 ELSE 0.03 END::DOUBLE), 6) AS cost FROM c GROUP BY model",
    "routing_overrides": f"""
        WITH s AS (SELECT s_nationkey AS org, s_suppkey AS pos, {_pick([*TASKS, "sing"], "s_suppkey")} || ':' || {_pick(COMPLEXITIES, "s_suppkey")} AS key, {_pick([*TIERS, "free"], "s_suppkey // 4")} AS tier, s_suppkey % 5 <> 0 AS enabled FROM supplier WHERE s_suppkey % 3 <> 2),
        p AS (SELECT org, arg_max(key, pos) AS key, arg_max(tier, pos) AS tier, arg_max(enabled, pos) AS enabled FROM s WHERE NOT starts_with(key, 'sing') AND tier <> 'free' GROUP BY org),
        c AS (SELECT c_nationkey AS org, {_pick(TASKS, "c_custkey")} || ':' || {_pick(COMPLEXITIES, "c_custkey // 3")} AS key FROM customer)
        SELECT c.org AS org_id, coalesce(p.tier, CASE c.key WHEN 'translate:low' THEN 'economy' WHEN 'translate:high' THEN 'premium' WHEN 'judge:high' THEN 'premium' ELSE 'balanced' END) AS tier, count(*) AS calls FROM c LEFT JOIN p ON p.org = c.org AND p.enabled AND p.key = c.key GROUP BY 1, 2
    """,
    "back_translation_similarity": "WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT a.vec_id, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS c FROM u a JOIN u b ON a.vec_id = b.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id) SELECT e.vec_id, round(greatest(0.0, least(100.0, 100 * c)), 4) AS similarity FROM embeddings e LEFT JOIN p ON p.vec_id = e.vec_id".replace("round(greatest(0.0, least(100.0, 100 * c)), 4)", "CASE WHEN c IS NOT NULL THEN round(greatest(0.0, least(100.0, 100 * c)), 4) END"),
    "export_fidelity": """
        WITH b AS (SELECT l_orderkey AS id, l_linenumber AS block, l_returnflag AS class, CASE WHEN l_quantity > 45 THEN 'ESCALATE' WHEN l_quantity > 20 THEN 'SHRINK' WHEN l_quantity > 10 THEN 'FIT' END AS strategy, l_linestatus = 'F' AS font, l_discount >= 0.1 OR l_quantity > 45 AS bad FROM lineitem),
        c AS (SELECT id, string_agg(class || ':' || n, ',' ORDER BY class) AS by_class FROM (SELECT id, class, count(*) AS n FROM b GROUP BY id, class) x GROUP BY id),
        s AS (SELECT id, string_agg(strategy || ':' || n, ',' ORDER BY strategy) AS by_strategy FROM (SELECT id, strategy, count(*) AS n FROM b WHERE strategy IS NOT NULL GROUP BY id, strategy) x GROUP BY id)
        SELECT b.id AS export_id, count(*) AS blocks, any_value(coalesce(by_class, '')) AS by_class, any_value(coalesce(by_strategy, '')) AS by_strategy, count(*) FILTER (font) AS font_substitutions, bool_or(bad) AS degraded, coalesce(string_agg(block, ',' ORDER BY block) FILTER (bad), '') AS degraded_blocks
        FROM b LEFT JOIN c ON c.id = b.id LEFT JOIN s ON s.id = b.id GROUP BY b.id
    """,
    "document_results": "SELECT conv_id, round(avg(length(coalesce(text, '')) % 101), 4) AS confidence, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[!?]'))) AS BIGINT) AS defects, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id",
}
