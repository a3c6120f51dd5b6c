"""The corpus pipeline: language, quality, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next stage's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlake.llm import langid
from varlake.llm.jaccard import jaccard_join
from varlake.llm.line_dedup import dedup_lines
from varlake.llm.packing import pack
from varlake.llm.quality import keep_good
from varlake.llm.store import stored
from varlake.session import scratch_path

# Rows that a Python worker is handed at a time: a row is a whole text, so fewer than Spark's default.
BATCH_ROWS = 1_000
# And bytes, for texts are of any length; a longer text comes alone.
BATCH_BYTES = 2 << 20
# A text is kept when one language holds at least this share of the evidence.
LEAST_SCORE = 0.5


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language, the column ``lang`` as it came."""
    _bounded(spark)
    found = langid.identify(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules keep."""
    _bounded(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document of smaller id holds; emptied documents go."""
    _bounded(spark)
    left = dedup_lines(docs, min_chars=10)
    counted = left.withColumn("n_chars", F.length("text").cast("long"))
    return counted.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that of smallest id.

    A document is told by a 64-bit hash of its id and text, so rows of null id and rows that share
    an id but not the text take part one by one. Null ids come last, ties are settled by the hash.
    Of rows alike in id and text the one of least hash over all columns stays.
    """
    _bounded(spark)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    texts = keyed.select("key", F.col("row.text").alias("text"))
    rows = docs.count()
    groups = stored(jaccard_join(texts, id_col="key", shingle=5, num=80, den=100).select("key", "component_id").distinct(), "groups", rows)
    shared = groups.where("key != component_id").select("component_id").distinct()
    members = groups.join(shared, "component_id", "left_semi").join(keyed.select("key", "row.doc_id").distinct(), "key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = members.groupBy("component_id").agg(F.min(order).alias("first"))
    gone = members.join(first, "component_id").where(F.col("key") != F.col("first.key")).select("key").distinct()
    repeated = stored(keyed.groupBy("key").count().where("count > 1").select("key"), "repeated", rows)
    kept = keyed.join(gone, "key", "left_anti")
    once = kept.join(repeated, "key", "left_anti").select("row")
    several = kept.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.unionByName(several.select("row")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept text in sequences of at most 2,048 tokens."""
    _bounded(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("best_fit_packing", packing),
]

# Tokens and learned models are beyond SQL; tests/llm/test_pipeline.py has a plain version of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
