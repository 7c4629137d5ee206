"""The subpackage's registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm import balltree, bpe, collocations, hnsw, htmltext, packing, periodic, pii, quality, sharding, simhash, toxicity, warc

SHARDS = 16
LINK_COSINE = 0.95


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, by the rebalanced slot map."""
    out = sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARDS)
    return out.withColumnRenamed("id", "doc_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the capture index."""
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by fingerprints at most 4 bits apart."""
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), words=4, radius=4).withColumnRenamed("id", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.detect(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens packed into sequences of 2048."""
    out = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings by cosine."""
    return hnsw.embedding_components(_table(spark, sf_dir, "embeddings"), threshold=LINK_COSINE).withColumnRenamed("id", "vec_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    return quality.judged(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "quality.*")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken")).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document; labels of the fold crc32(doc_id) mod 4 = 2 are never learnt from."""
    docs = _table(spark, sf_dir, "documents")
    score = toxicity.scorer(toxicity.train(docs, _table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of 2 to 3 words."""
    return collocations.collocations(_table(spark, sf_dir, "documents"), max_words=3, min_count=10, top=2000, cover=50)


def _planted(text: Column, key: Column) -> Column:
    """The text, or for a tenth of the keys one whose words from some place on repeat the period that the key's checksum gives."""
    h = F.crc32(key.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), (n - a).cast("int"))
    mixed = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    return F.when((h % 10 == 0) & (n > 0), mixed).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of them with one planted."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = periodic.periodic_runs(docs.withColumn("text", _planted(F.col("text"), F.col("doc_id"))))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    length, period = -F.col("best.m"), F.col("best.period")
    return out.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector whose id is divisible by 50 the 5 rows with the highest inner products."""
    return balltree.top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's packed pieces."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sharding, op2_warc, op3_simhash, op4_pii, op5_packing, op6_htmltext, op7_hnsw, op8_quality, op9_bpe, op10_toxicity, op11_collocations, op12_periodic, op13_top_k, pipeline]
    return {f.__name__: f for f in found}


#: The operators whose contract SQL expresses; the others are tested against brute force.
ORACLE_SQL = {
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT doc_id, coalesce(lang, 'und') AS lang,
                unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        words AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
        grams AS (
            SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
            FROM places, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w)),
        counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY 1),
        found AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 10),
        cuts AS (
            SELECT c.*, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail
            FROM (SELECT *, unnest(range(1, m)) AS k FROM found) AS c),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.m, c.w, k, x.f AS l, y.f AS r,
                CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM cuts AS c JOIN counts AS x ON x.lang = c.lang AND x.phrase = head JOIN counts AS y ON y.lang = c.lang AND y.phrase = tail),
        least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_parts AS (
            SELECT lang, array_to_string(w[s : s + 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT lang, w, a, unnest([1, 2]) AS s FROM found WHERE m = 3) GROUP BY ALL),
        kept AS (
            SELECT e.* FROM least AS e LEFT JOIN inner_parts AS p ON p.lang = e.lang AND p.phrase = e.phrase
            WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
        WHERE rank <= 2000
    """,
    "op12_periodic": r"""
        WITH base AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                list_reduce(
                    list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
                    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                        lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)) AS state
            FROM documents),
        hashed AS (SELECT doc_id, w, len(w) AS n, CAST(xor(state, 4294967295::UBIGINT) AS BIGINT) AS h FROM base),
        placed AS (
            SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
        period AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
        words AS (
            SELECT doc_id, n, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
            FROM (SELECT *, unnest(range(0, n)) AS i FROM period)),
        equal AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM words AS x JOIN words AS y
            ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
        stretches AS (
            SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
            HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (SELECT doc_id, s, length, min(q) AS q FROM stretches GROUP BY ALL),
        digest AS (
            SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, length := length, q := q), [-length, s, q]) AS best,
                string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines
            FROM runs GROUP BY 1),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
        texts AS (
            SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.i) AS collapsed
            FROM words AS v ANTI JOIN dropped AS d ON d.doc_id = v.doc_id AND d.i = v.i GROUP BY 1)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.length AS length, best.q AS period,
            1000 * best.length // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM hashed LEFT JOIN digest USING (doc_id) LEFT JOIN texts USING (doc_id)
    """,
    "op13_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM usable AS q JOIN usable AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op2_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN first_id IS NOT NULL AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON d = payload_digest AND payload_bytes >= 100
    """,
}
