"""From raw documents to packed training sequences.

``STAGES`` are applied in order, each to all rows that the one before kept; every
stage's result is written as Parquet and read again.  Stages but the last return
the columns of ``documents``.

* toxicity: documents that the factorization machine rejects go (score >= 0.3);
* quality: documents that the fixed rules or the robust outlier test reject go;
* near_duplicates: one document of each near-duplicate class stays (SimHash over
  five-word shingles, similarity 0.8 or more);
* pii: personal data in the texts is replaced by its kind, ``n_chars`` follows;
* packing: the texts' tokens in sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortweave.llm import packing, pii, quality, simhash, toxicity
from cohortweave.llm._store import mark, release, stored

_OWN = "__corpus_pipeline"


def _columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.3; the model is fitted on labelled documents of ``sf_dir``.

    Null and empty texts have the model's base score and stay; repeated rows are scored
    alike; an empty table gives an empty table; columns pass through untouched.
    """
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.scorer(model)
    return docs.withColumn(_OWN, score(F.col("text").cast("string"))).filter(F.col(_OWN) < toxicity.THRESHOLD).select(_columns(docs))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go; repeated rows are judged alike; null
    languages and sources are groups of their own; an empty table gives an empty table.
    """
    return quality.judged(docs, out=_OWN).filter(F.col(f"{_OWN}.kept")).select(_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class, once (repeated rows too).

    A row is known by its id and its text's hash; null ids come after all others.  Null
    and empty texts are one class; an empty table gives an empty table.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text"))
    keyed = docs.withColumn(_OWN, own)
    kept = stored(simhash.near_duplicates(keyed, id_col=_OWN).filter("keep").select(F.col("id").alias(f"{_OWN}_id")), "kept")
    found = keyed.join(kept, F.col(_OWN) == F.col(f"{_OWN}_id"), "left_semi")
    # of rows equal in id and text the one whose other columns come first, whatever the partitions
    once = F.row_number().over(Window.partitionBy(_OWN).orderBy(F.xxhash64(F.to_json(F.struct(*_columns(docs))))))
    return found.withColumn(f"{_OWN}_n", once).filter(F.col(f"{_OWN}_n") == 1).select(_columns(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; ``n_chars`` is the new text's length.

    Null texts stay null; empty texts and repeated rows stay as they are.
    """
    clean = docs.withColumn("text", pii.redactor()(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces, as ``op5`` returns them; a null or empty text is the end id alone, repeated rows are packed each."""
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("pii", redact), ("packing", pack)]

#: Fingerprints, fitted models and token ids are not expressible in SQL; tests/llm holds the stages' operators
#: against brute force or held-out labels, and the chain's columns and ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each result stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, since, keep=docs)  # the stage's intermediates and what it read
    return docs
