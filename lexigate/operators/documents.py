"""Document operators: segments, text of pages, repeated text, matches in a memory of texts, vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigate.sources.tables import table


def segments_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each document with their order, blank ones dropped."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("order_index", "segment"))
    return x.select("doc_id", F.col("order_index").cast("bigint").alias("order_index"), F.trim("segment").alias("segment")).where("segment <> ''")


def segments_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentence counts and lengths: a split after . ! ? and spaces."""
    marked = F.regexp_replace("text", r"([.!?])[\x20\x0A]+", "$1\u0001")
    x = table(spark, d, "documents").select("doc_id", F.explode(F.split(marked, "\u0001", -1)).alias("s")).where("s <> ''")
    return x.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).cast("bigint").alias("longest"))


def segment_caps(spark: SparkSession, d: str) -> DataFrame:
    """Lines over 1000 characters of each document, and the pieces that the cap makes of them."""
    x = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("s")).where(F.length("s") > 1000)
    return x.groupBy("doc_id").agg(F.count("*").alias("long_lines"), F.sum(F.ceil(F.length("s") / 1000)).cast("bigint").alias("pieces"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of raw pages: scripts, styles and tags go, spaces collapse."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>", " "), r"(?s)<[^>]*>", " ")
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " ")).alias("text"))


def structure_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Counts of structural tags of each page."""
    tags = {"paragraphs": "<p[ >]", "tables": "<table[ >]", "headings": "<h[1-6][ >]", "links": "<a[ >]", "images": "<img[ >]"}
    return table(spark, d, "pages").select("page_id", *[F.regexp_count("html", F.lit(p)).cast("bigint").alias(n) for n, p in tags.items()])


def fidelity_compare(spark: SparkSession, d: str) -> DataFrame:
    """Structure kept between each page and the next: weighted kept over possible."""
    f = structure_fingerprint(spark, d)
    weight = {"paragraphs": 1, "tables": 5, "headings": 3, "images": 4}
    other = f.select((F.col("page_id") - 1).alias("page_id"), *[F.col(c).alias(f"{c}_out") for c in weight])
    kept = sum((F.least(F.col(c), F.col(f"{c}_out")) * w for c, w in weight.items()), F.lit(0))
    possible = sum((F.col(c) * w for c, w in weight.items()), F.lit(0))
    score = F.when(possible == 0, 1.0).otherwise(F.round(kept / possible, 4))
    return f.join(other, "page_id").select("page_id", score.alias("score"), ((F.col("tables_out") < F.col("tables")) | (F.col("headings_out") < F.col("headings"))).alias("skeleton_loss"))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Short lines that two documents or more hold, digits folded."""
    norm = F.regexp_replace(F.lower(F.trim("s")), "[0-9]", "#")
    x = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("s")).where((F.trim("s") != "") & (F.length("s") <= 80))
    return x.select("doc_id", norm.alias("line")).groupBy("line").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("n")).where("docs >= 2")


def doc_exact_dups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents with one content hash: the least id keeps, the rest are counted."""
    x = table(spark, d, "documents").select("doc_id", F.sha2(F.trim("text"), 256).alias("content_hash"))
    return x.groupBy("content_hash").agg(F.min("doc_id").alias("kept"), (F.count("*") - 1).alias("copies")).where("copies > 0")


def tm_exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that are a stored text of the memory (first lines of others), by hash and language."""
    docs = table(spark, d, "documents")
    first = F.sha2(F.trim(F.substring_index("text", "\n", 1)), 256)
    last = F.sha2(F.trim(F.substring_index("text", "\n", -1)), 256)
    memory = docs.where("doc_id % 2 = 0").groupBy(first.alias("h"), "lang").agg(F.max("doc_id").alias("match_id"))
    asked = docs.where("doc_id % 2 = 1").select("doc_id", "lang", first.alias("h"))
    return asked.join(memory, ["h", "lang"], "left").select("doc_id", "match_id", F.when(F.col("match_id").isNotNull(), 100).otherwise(0).alias("score"))


def tm_exact_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of each language's texts that the memory holds."""
    x = tm_exact_lookup(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return x.groupBy("lang").agg(F.count("*").alias("asked"), F.count("match_id").alias("found"))


def tm_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Best fuzzy match of each benchmark text among first lines: token Jaccard of 0.85 or more.

    Candidates share one of a text's rarest tokens (a lossless prefix of the tokens in order
    of rarity), and are confirmed on the whole sets.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9\u0080-￿]+"), lambda t: t != ""))
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("a"), tokens(F.col("text")).alias("ta")).where(F.size("ta") > 0)
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("b"), tokens(F.regexp_replace("text", r"^[^\x20]+\x20", "")).alias("tb")).where(F.size("tb") > 0)
    seen = docs.select(F.explode("tb").alias("t")).union(bench.select(F.explode("ta").alias("t"))).groupBy("t").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, key: str, arr: str) -> DataFrame:
        size = F.size(arr)
        keep = (size - F.ceil(size * 85 / 100) + 1).cast("int")
        ranked = df.select(key, keep.alias("keep"), F.explode(arr).alias("t")).join(seen, "t")
        place = F.row_number().over(Window.partitionBy(key).orderBy("n", "t"))
        return ranked.withColumn("place", place).where("place <= keep").select(key, "t")

    cand = prefix(bench, "a", "ta").join(prefix(docs, "b", "tb"), "t").select("a", "b").distinct()
    common = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - common
    return cand.join(bench, "a").join(docs, "b").where(100 * common >= 85 * union).select("a", "b", F.round(common / union, 6).alias("similarity"))


#: Query vectors of one block, which is sent to every task, and stored vectors compared with them at a time.
BLOCK, STEP = 4096, 512
#: Vectors of one block where every vector is a query; a cell holds two blocks.
CELL = 8192


def nearest(vectors: DataFrame, queries: DataFrame, k: int, cosine: bool = False, by: str | None = None) -> DataFrame:
    """(q, vec_id, distance, place): the k vectors nearest to each query, itself left out; least id on ties.

    Both sides have vec_id and embedding; with ``by`` only vectors of the query's value in that
    column count (null is equal to nothing). Queries go to the tasks in blocks of BLOCK; a
    task compares STEP vectors with them at a time and holds the k best of each query, so
    that its memory depends on BLOCK, STEP and k only, and what is shuffled is k rows for a query and task.
    Null vectors, and distances that are no number, are near to nothing.
    Distances are squared L2, or 1 less the cosine, rounded to 6 places.
    """
    spark = vectors.sparkSession
    same = F.col(by).cast("string") if by else F.lit("")
    blocks = -(-queries.count() // BLOCK)
    out = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).where(F.col("embedding").isNotNull() & same.isNotNull()).select("vec_id", "embedding", same.alias("group")).toArrow()
        if not own.num_rows:
            continue
        ids, matrix = own.column("vec_id").to_numpy(), np.array(own.column("embedding").to_pylist(), np.float64)
        code = {g: i for i, g in enumerate(dict.fromkeys(own.column("group").to_pylist()))}
        groups = np.array([code[g] for g in own.column("group").to_pylist()])

        def best(batches, ids=ids, matrix=matrix, code=code, groups=groups):
            kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
            for batch in batches:
                batch = batch.filter(pc.is_valid(batch.column(1)))
                for at in range(0, batch.num_rows, STEP):
                    part = batch.slice(at, STEP)
                    own = np.array([code.get(g, -1) for g in part.column(2).to_pylist()])
                    kept = _keep(kept, ids, matrix, groups, part.column(0).to_numpy(), np.array(part.column(1).to_pylist(), np.float64), own, k, cosine)
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], ["q", "vec_id", "distance"])

        part = vectors.select("vec_id", "embedding", same.alias("group")).mapInArrow(best, "q bigint, vec_id bigint, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "q bigint, vec_id bigint, distance double, place bigint")
    return _places(out, k)


def _places(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id")).cast("bigint")
    return found.withColumn("place", place).where(F.col("place") <= k)


def nearest_of_each(vectors: DataFrame, k: int, by: str, cosine: bool = False) -> DataFrame:
    """(q, vec_id, distance, place): what ``nearest`` gives where every vector is a query, among those of its value in ``by``.

    All pairs of a value are compared, so the work grows with the square of its vectors. It is dealt over cells of two
    blocks of about CELL vectors: a task holds one cell, whatever the input, and a vector is sent to as many cells as its value has blocks.
    """
    x = vectors.select("vec_id", "embedding", F.col(by).cast("string").alias("group")).dropna()
    # one row for each CELL vectors at most
    many = x.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("group", F.ceil(F.col("n") / CELL).alias("parts"))
    x = x.join(F.broadcast(many), "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    x = x.withColumn("own", F.pmod(F.xxhash64("vec_id"), "parts")).withColumn("met", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    cells = x.select("vec_id", "embedding", "own", "group", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"))

    def best(cell: pa.Table) -> pa.Table:
        ids, own = cell.column("vec_id").to_numpy(), cell.column("own").to_numpy()
        matrix = np.array(cell.column("embedding").to_pylist(), np.float64)
        low, high = own == cell.column("low")[0].as_py(), own == cell.column("high")[0].as_py()
        found = []
        for asked, stored in [(low, high), (high, low)][: 2 - int(low.all())]:
            kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
            q, mine, same, rows, held = ids[asked], matrix[asked], np.zeros(asked.sum(), int), ids[stored], matrix[stored]
            for at in range(0, len(rows), STEP):
                part = slice(at, at + STEP)
                kept = _keep(kept, q, mine, same, rows[part], held[part], np.zeros(len(rows[part]), int), k, cosine)
            found.append(pa.table({"q": q[kept[0]], "vec_id": kept[1], "distance": kept[2]}))
        return pa.concat_tables(found)

    return _places(cells.groupBy("group", "low", "high").applyInArrow(best, "q bigint, vec_id bigint, distance double"), k)


def _keep(kept: tuple, ids: np.ndarray, matrix: np.ndarray, groups: np.ndarray, rows: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, cosine: bool) -> tuple:
    """The k best (query, vector, distance) of those kept and of one more step of vectors."""
    found = np.round(_block_distances(matrix, vectors, cosine), 6)
    found[(ids[:, None] == rows[None, :]) | (groups[:, None] != own[None, :]) | np.isnan(found)] = np.inf
    least = np.partition(found, min(k, found.shape[1]) - 1, axis=1)[:, min(k, found.shape[1]) - 1]
    q, v = np.nonzero((found <= least[:, None]) & (found < np.inf))
    q, v, d = np.concatenate([kept[0], q]), np.concatenate([kept[1], rows[v]]), np.concatenate([kept[2], found[q, v]])
    order = np.lexsort((v, d, q))
    q, v, d = q[order], v[order], d[order]
    first = np.concatenate([np.arange(len(q))[:1], np.flatnonzero(q[1:] != q[:-1]) + 1])
    place = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
    return q[place < k], v[place < k], d[place < k]


def _block_distances(a: np.ndarray, b: np.ndarray, cosine: bool) -> np.ndarray:
    if cosine:
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (a @ b.T) / np.sqrt((a * a).sum(axis=1)[:, None] * (b * b).sum(axis=1)[None, :])
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def vec_top3_l2(spark: SparkSession, d: str) -> DataFrame:
    """Three nearest vectors of the same label by squared L2 distance, least id on ties."""
    e = table(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 20 = 0"), 3, by="label")


def vec_top1_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vector of the same label for every vector, by cosine distance, and the similarity clamped to 0..100."""
    best = nearest_of_each(table(spark, d, "embeddings"), 1, "label", cosine=True).withColumn("cosine", F.round(1 - F.col("distance"), 6))
    return best.select("q", "vec_id", "cosine", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.col("cosine"))), 4).alias("similarity"))


def vec_nearest_all(spark: SparkSession, d: str) -> DataFrame:
    """Three nearest of all vectors for every vector whose id is divisible by 20, by squared L2 distance."""
    e = table(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 20 = 0"), 3)


def memory_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Best stored vector for every vector whose id is divisible by 20: an equal one (score 1), else the nearest
    within a cosine distance of 0.1 (score 0.9), else none."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0")
    form = F.sha2(F.array_join(F.transform("embedding", lambda v: v.cast("string")), ","), 256)
    stored = e.select(form.alias("form"), "vec_id")
    exact = asked.select(F.col("vec_id").alias("q"), form.alias("form")).join(stored, "form").where("q <> vec_id").groupBy("q").agg(F.min("vec_id").alias("exact"))
    near = nearest(e, asked, 1, cosine=True).where("distance < 0.1").select("q", F.col("vec_id").alias("near"))
    both = asked.select(F.col("vec_id").alias("q")).join(exact, "q", "left").join(near, "q", "left")
    return both.select("q", F.coalesce("exact", "near").alias("match"), F.when(F.col("exact").isNotNull(), 1.0).when(F.col("near").isNotNull(), 0.9).alias("score"))


def rebuilt_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of each conversation joined in order, as a digest."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return g.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: x["text"]), ". "), 256).alias("digest"))


QUERIES = {f.__name__: f for f in (segments_lines, segments_sentences, segment_caps, page_text, structure_fingerprint, fidelity_compare, repeated_lines, doc_exact_dups, tm_exact_lookup, tm_exact_rate, tm_jaccard, vec_top3_l2, vec_top1_cosine, vec_nearest_all, memory_best_match, rebuilt_text)}

_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents)"
_TAGS = {"paragraphs": "<p[ >]", "tables": "<table[ >]", "headings": "<h[1-6][ >]", "links": "<a[ >]", "images": "<img[ >]"}
_FINGER = "SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(html, '{p}')) AS BIGINT) AS {n}" for n, p in _TAGS.items()) + " FROM pages"
_TM = "m AS (SELECT sha256(trim(string_split(text, chr(10))[1], ' ')) AS h, lang, max(doc_id) AS match_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2), x AS (SELECT q.doc_id, q.lang, m.match_id FROM (SELECT doc_id, lang, sha256(trim(string_split(text, chr(10))[1], ' ')) AS h FROM documents WHERE doc_id % 2 = 1) q LEFT JOIN m ON q.h = m.h AND q.lang = m.lang)"
ORACLE_SQL = {
    "segments_sentences": r"SELECT doc_id, count(*) AS sentences, CAST(max(length(s)) AS BIGINT) AS longest FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[\x20\x0A]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) t WHERE s <> '' GROUP BY doc_id",
    "segment_caps": f"SELECT doc_id, count(*) AS long_lines, CAST(sum(ceil(length(s) / 1000.0)) AS BIGINT) AS pieces FROM {_LINES} t WHERE length(s) > 1000 GROUP BY doc_id",
    "page_text": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS text FROM pages",
    "structure_fingerprint": _FINGER,
    "fidelity_compare": f"WITH f AS ({_FINGER}) SELECT a.page_id, CASE WHEN a.paragraphs + 5 * a.tables + 3 * a.headings + 4 * a.images = 0 THEN 1.0 ELSE round((least(a.paragraphs, b.paragraphs) + 5 * least(a.tables, b.tables) + 3 * least(a.headings, b.headings) + 4 * least(a.images, b.images))::DOUBLE / (a.paragraphs + 5 * a.tables + 3 * a.headings + 4 * a.images), 4) END::DOUBLE AS score, b.tables < a.tables OR b.headings < a.headings AS skeleton_loss FROM f a JOIN f b ON b.page_id - 1 = a.page_id",
    "repeated_lines": f"SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS n FROM (SELECT doc_id, regexp_replace(lower(trim(s, ' ')), '[0-9]', '#', 'g') AS line FROM {_LINES} t WHERE trim(s, ' ') <> '' AND length(s) <= 80) u GROUP BY line HAVING count(DISTINCT doc_id) >= 2",
    "doc_exact_dups": "SELECT sha256(trim(text, ' ')) AS content_hash, min(doc_id) AS kept, count(*) - 1 AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "tm_exact_lookup": f"WITH {_TM} SELECT doc_id, match_id, CASE WHEN match_id IS NULL THEN 0 ELSE 100 END AS score FROM x",
    "tm_exact_rate": f"WITH {_TM} SELECT lang, count(*) AS asked, count(match_id) AS found FROM x GROUP BY lang",
    "tm_jaccard": r"WITH a AS (SELECT item_id AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{FFFF}]+')) AS ta FROM benchmark), b AS (SELECT item_id AS b, list_distinct(regexp_extract_all(lower(regexp_replace(text, '^[^ ]+ ', '')), '[a-z0-9\x{80}-\x{FFFF}]+')) AS tb FROM benchmark), p AS (SELECT a, b, len(list_intersect(ta, tb)) AS c, len(ta) + len(tb) AS t FROM a, b) SELECT a, b, round(c::DOUBLE / (t - c), 6) AS similarity FROM p WHERE 100 * c >= 85 * (t - c) AND c > 0",
    "vec_top3_l2": "WITH p AS (SELECT q.vec_id AS q, e.vec_id, round(list_sum([power(a::DOUBLE - b::DOUBLE, 2) FOR a, b IN list_zip(q.embedding, e.embedding)]), 6) AS distance FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) SELECT q, vec_id, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS place FROM p) t WHERE place <= 3",
    "rebuilt_text": "SELECT conv_id, sha256(string_agg(text, '. ' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
}
ORACLE_SQL["vec_top3_l2"] = "WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT q.vec_id AS q, e.vec_id, round(sum((q.v - e.v) * (q.v - e.v)), 6) AS distance FROM u q JOIN u e ON q.label = e.label AND q.i = e.i AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, e.vec_id) SELECT q, vec_id, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS place FROM p) t WHERE place <= 3"
ORACLE_SQL["vec_top1_cosine"] = "WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT q.vec_id AS q, e.vec_id, round(sum(q.v * e.v) / sqrt(sum(q.v * q.v) * sum(e.v * e.v)), 6) AS cosine FROM u q JOIN u e ON q.label = e.label AND q.i = e.i AND q.vec_id <> e.vec_id GROUP BY q.vec_id, e.vec_id) SELECT q, vec_id, cosine, round(greatest(0.0, least(100.0, 100 * cosine)), 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS r FROM p) t WHERE r = 1"
ORACLE_SQL["vec_nearest_all"] = "WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT q.vec_id AS q, e.vec_id, round(sum((q.v - e.v) * (q.v - e.v)), 6) AS distance FROM u q JOIN u e ON q.i = e.i AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, e.vec_id) SELECT q, vec_id, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS place FROM p) t WHERE place <= 3"
ORACLE_SQL["memory_best_match"] = "WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT q.vec_id AS q, e.vec_id, round(1 - sum(q.v * e.v) / sqrt(sum(q.v * q.v) * sum(e.v * e.v)), 6) AS distance FROM u q JOIN u e ON q.i = e.i AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, e.vec_id), n AS (SELECT q, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS k FROM p) t WHERE k = 1 AND distance < 0.1), x AS (SELECT a.vec_id AS q, min(b.vec_id) AS vec_id FROM embeddings a JOIN embeddings b ON a.embedding = b.embedding AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id) SELECT e.vec_id AS q, coalesce(x.vec_id, n.vec_id) AS match, CASE WHEN x.q IS NOT NULL THEN 1.0 WHEN n.q IS NOT NULL THEN 0.9 END::DOUBLE AS score FROM embeddings e LEFT JOIN x ON x.q = e.vec_id LEFT JOIN n ON n.q = e.vec_id WHERE e.vec_id % 20 = 0"
