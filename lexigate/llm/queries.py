"""Registered queries of this subpackage: thin calls of its operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigate.llm import byte_bpe, context_tree, conversation_repair, decontaminate, language_id, line_dedup, near_dedup, pairwise_quality, piece_bpe, pii, prefix_trie, quality_rules, token_counts
from lexigate.llm.vocabularies import PATTERN, vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(parts: int, part: int) -> Column:
    """Rows whose crc32 of the doc_id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document; null texts count as empty."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose five-word shingle sets are 0.85 alike; texts without words stand alone."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), threshold=85)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document by a network that learned from rows not held out; `und` without a letter."""
    docs = _table(spark, sf_dir, "documents")
    held_out = _held_out(4, 2)
    net = language_id.fit(docs.select("doc_id", "text", "lang"), ~held_out)
    found = language_id.identify(docs, net, F.col("doc_id"))
    return found.withColumnRenamed("carry", "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of every whole document by counts and a context tree of rows not held out; null texts have the end mark only."""
    held_out = _held_out(7, 2)
    scored = context_tree.code_lengths(_table(spark, sf_dir, "documents"), ~held_out, across=True)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole document, as digests; null texts have none."""
    return pii.span_digest(pii.personal_data(_table(spark, sf_dir, "documents")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document and the bytes they decode to, as digests; null texts have none."""
    coded = byte_bpe.encode_texts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN, digest=True)
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, learned from labels of rows not held out; 0.5 where nothing can be learned."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = _held_out(3, 1)
    model = pairwise_quality.fit(docs.where(~held_out), labels.where(~held_out).withColumnRenamed("quality", "label"))
    scored = pairwise_quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole document; null texts have no words and fail."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), trusted)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines taken out of every document, and the size and digest of what is left; null texts stay null."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.dedup_lines(docs)
    return left.select("doc_id", "n_removed", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document that lie in windows of benchmark items, and those items; null texts have no words."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole document and the text they decode to, as digests; null texts have none."""
    coded = piece_bpe.encode_pieces(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), digest=True)
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after faults were planted in it; nulls are one space."""
    damaged = conversation_repair.damage(_table(spark, sf_dir, "conversations"))
    return conversation_repair.audit_repairs(damaged, F.col("present"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations, with members, children, leaves and shared bytes; nulls are empty, a null conv_id is no conversation."""
    rows = prefix_trie.turns(_table(spark, sf_dir, "conversations"))
    trie = prefix_trie.prefix_trie(prefix_trie.rebuild(rows))
    nodes = trie.nodes.join(prefix_trie.end_digests(trie.ends), "node_id", "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), digest)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_near_duplicates, op3_language_id, op4_context_tree, op5_personal_data, op6_byte_bpe, op7_pairwise_quality, op8_quality_rules, op9_line_dedup, op10_decontamination, op11_piece_bpe, op12_conversation_repair, op13_prefix_trie)}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
#: The table of crc32's bytes, and the crc32 of an ASCII string by it.
_CRC_TABLE = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS tab FROM range(256) AS r(i)"


def _crc32(ascii: str) -> str:
    codes = f"list_transform(range(1, length({ascii}) + 1), lambda i: unicode(({ascii})[i])::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])))"


ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] ELSE array_to_string(w, ' ') END AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0) t
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
        e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
    """,
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
        f AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0) t
        ),
        z AS (SELECT DISTINCT k FROM f),
        o AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, z WHERE len(w) >= k) t),
        h AS (SELECT doc_id, o.k, o.i, item_id FROM o JOIN f ON o.k = f.k AND o.g = f.g),
        p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM h) t GROUP BY doc_id),
        q AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM h) t GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id
    """,
    "op12_conversation_repair": rf"""
        WITH RECURSIVE t AS ({_CRC_TABLE}),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, t),
        d AS (
            SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM k
        ),
        f AS (
            SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
            FROM d
        ),
        x AS (SELECT *, role[1] AS r, CASE WHEN solid = '' THEN 1 WHEN again THEN 2 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM f),
        g AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
            FROM x GROUP BY conv_id
        ),
        m AS (SELECT unnest([0, 1, 2]) AS m), e AS (SELECT unnest(['D', 'K', 'R']) AS e),
        s AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, '' AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS body FROM conversations
            UNION ALL
            SELECT conv_id, n, s, cost, audit, body FROM (
                SELECT s.conv_id, x.n, CASE e WHEN 'D' THEN q WHEN 'K' THEN r ELSE p END AS s,
                    cost + 3 * m + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 3 THEN 3 ELSE 0 END AS cost, audit || repeat('I', m) || e AS audit,
                    body || i || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE p WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END AS body
                FROM (
                    SELECT *, CASE m WHEN 0 THEN s WHEN 1 THEN CASE s WHEN 'u' THEN 'a' ELSE 'u' END ELSE CASE s WHEN 'u' THEN 'u' ELSE 'a' END END AS q, CASE WHEN q = 'u' THEN 'a' ELSE 'u' END AS p,
                        CASE m WHEN 0 THEN '' WHEN 1 THEN chr(10) || CASE s WHEN 'u' THEN 'assistant:' ELSE 'user:' END ELSE chr(10) || CASE s WHEN 'u' THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END END AS i
                    FROM s, m, e
                ) s JOIN x ON x.conv_id = s.conv_id AND x.n = s.n + 1
                WHERE e = 'D' OR (fault NOT IN (1, 2) AND (e = 'R' OR r = p OR (r = 's' AND q = '')))
            ) c QUALIFY row_number() OVER (PARTITION BY conv_id, n, s ORDER BY cost, audit) = 1
        ),
        z AS (
            SELECT s.conv_id, cost + 3 * m AS cost, audit || repeat('I', m) AS audit,
                body || CASE m WHEN 0 THEN '' WHEN 1 THEN chr(10) || CASE s WHEN 'u' THEN 'assistant:' ELSE 'user:' END ELSE chr(10) || CASE s WHEN 'u' THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END END AS body
            FROM s LEFT JOIN g ON g.conv_id = s.conv_id CROSS JOIN m
            WHERE s.n = coalesce(g.n, 0) AND CASE m WHEN 0 THEN s IN ('', 'a') WHEN 1 THEN s = 'u' ELSE s <> 'u' END
            QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY cost + 3 * m, audit || repeat('I', m)) = 1
        )
        SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(body[2:]) AS repaired_sha256
        FROM z LEFT JOIN g ON g.conv_id = z.conv_id
    """,
    "op13_prefix_trie": rf"""
        WITH t AS ({_CRC_TABLE}),
        c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM c) q, t),
        r AS (
            SELECT k.conv_id, pos, role, text FROM k JOIN c ON c.conv_id = k.conv_id - k.conv_id % 5 WHERE pos < h
            UNION ALL SELECT k.conv_id, pos, role, text FROM k JOIN c ON c.conv_id = k.conv_id WHERE pos >= h
        ),
        n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, md5(length(role) || ':' || role || text) AS g, strlen(text) AS bytes FROM r),
        p AS (SELECT conv_id, d, bytes, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM n UNION ALL SELECT conv_id, 0, 0, '' FROM k),
        l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id),
        v AS (
            SELECT key, d, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(CASE WHEN d = len THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '') AS ends
            FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY key, d
        ),
        u AS (SELECT key[1:32 * (d - 1)] AS key, count(*) AS n FROM v WHERE d > 0 GROUP BY 1),
        a AS (SELECT v.key, v.n_convs, v.bytes, u.key IS NULL AS leaf, unnest(range(v.d + 1)) AS i FROM v LEFT JOIN u ON u.key = v.key),
        w AS (SELECT key[1:32 * i] AS key, count(*) FILTER (leaf) AS leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved FROM a GROUP BY 1)
        SELECT v.conv_id, v.d AS depth, parent.conv_id AS parent_conv_id, v.n_convs, coalesce(u.n, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(v.ends) AS ends_sha256
        FROM v JOIN w ON w.key = v.key LEFT JOIN u ON u.key = v.key LEFT JOIN v parent ON v.d > 0 AND parent.key = v.key[1:32 * (v.d - 1)]
    """,
}
