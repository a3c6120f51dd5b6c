"""Recorded episodes in Parquet and in shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varlake.schemas import EPISODE
from varlake.session import broadcast_checked, cut_lineage, ship_package
from varlake.sources.episode_shards import SPLIT_BYTES, EpisodeShards


def read_episodes(spark: SparkSession, path) -> DataFrame:
    """Nested episodes; the schema is fixed, so a scan reads only the fields in use."""
    return spark.read.schema(EPISODE).parquet(path)


def explode_steps(episodes: DataFrame, key: str = "episode_id") -> DataFrame:
    """One row per step: (key, step_idx, fields..), ``step_idx`` from 0."""
    return episodes.select(key, F.posexplode("steps").alias("step_idx", "step")).select(
        key, "step_idx", "step.*"
    )


def read_episode_shards(
    spark: SparkSession, path: str, split: str = "train", split_bytes: int = SPLIT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Episodes of all shards, numbered in shard order, and (shard, record, error) of bad records.

    The numbers need the count of records in every block of every shard: a pass over
    record headers alone.
    """
    ship_package(spark)
    spark.dataSource.register(EpisodeShards)
    reader = spark.read.format("episode_shards").option("split", split).option("split_bytes", split_bytes)
    headers = reader.option("headers_only", "true").load(path)
    lengths = headers.groupBy("shard", "block_start").agg(F.count("*").alias("n"))
    # One row per block: these windows see no more than a file listing.
    before = Window.orderBy("shard", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = Window.partitionBy("shard").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        lengths.select(
            "shard",
            "block_start",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
            F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("in_shard"),
        )
    )
    records = reader.option("headers_only", "false").load(path)
    records = records.join(broadcast_checked(offsets), ["shard", "block_start"])
    good = records.where("error IS NULL").select(
        (F.col("offset") + F.col("record_no")).alias("episode_id"), "file_path", "steps"
    )
    bad = records.where("error IS NOT NULL").select(
        "shard", (F.col("in_shard") + F.col("record_no")).alias("record_no"), "error"
    )
    return good, bad


def write_episode_shards(
    episodes: DataFrame, path: str, split: str = "train", name: str = "episodes", shards: int | None = None
) -> None:
    """One shard per partition (``shards`` respreads them), renamed into place on success."""
    ship_package(episodes.sparkSession)
    episodes.sparkSession.dataSource.register(EpisodeShards)
    if shards:
        episodes = episodes.repartition(shards, "file_path")
    (
        episodes.select("file_path", "steps")
        .write.format("episode_shards")
        .option("split", split)
        .option("name", name)
        .mode("append")
        .save(path)
    )
