"""Keyed tables: (key, value.., seq), sharded by a hash of the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.functions.hashing import shard_of
from varlake.session import BROADCAST_BYTES, broadcast_checked


def with_shard(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.withColumn("shard", shard_of(key, n))


def _last(df: DataFrame, key: str, order) -> DataFrame:
    """The latest row of every key; each task keeps one candidate per key."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), order).alias("__v"))
        .select(*[F.col(c) if c == key else F.col(f"__v.{c}").alias(c) for c in df.columns])
    )


def upsert(
    base: DataFrame, changes: DataFrame, key: str = "key", seq: str = "seq", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Base (one row per key) with changes applied; of several to a key the one with the highest seq.

    Only the changes are aggregated. The base loses the changed keys by an anti join,
    which leaves it where it is when those keys fit a broadcast.
    """
    latest = _last(changes, key, seq)
    return delete(base, latest, key, limit).unionByName(latest)


def delete(base: DataFrame, keys: DataFrame, key: str = "key", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Base without these keys; a null key counts as a key."""
    gone = keys.select(F.col(key).alias("__gone")).distinct()
    return base.join(broadcast_checked(gone, limit), base[key].eqNullSafe(F.col("__gone")), "left_anti")


def existed(base: DataFrame, keys: DataFrame, key: str = "key", limit: int = BROADCAST_BYTES) -> DataFrame:
    """The keys asked for, each with whether the table had it."""
    wanted = keys.select(key).distinct()
    have = base.join(broadcast_checked(wanted, limit), key, "left_semi").select(key).distinct()
    return wanted.join(have.withColumn("existed", F.lit(True)), key, "left").select(
        key, F.coalesce("existed", F.lit(False)).alias("existed")
    )


def get(base: DataFrame, keys: DataFrame, key: str = "key", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every asked key with its row, or with nulls.

    The table is cut down to the keys first, which a broadcast does without a shuffle.
    """
    hits = base.join(broadcast_checked(keys.select(key).distinct(), limit), key, "left_semi")
    return keys.join(hits, key, "left")


def get_one(base: DataFrame, value, n: int, key: str = "key") -> DataFrame:
    """Rows of one key; the shard filter prunes a table partitioned by ``shard``."""
    return base.where((F.col("shard") == shard_of(F.lit(value), n)) & (F.col(key) == F.lit(value)))


def keys(base: DataFrame, key: str = "key") -> DataFrame:
    return base.select(key).distinct()


def items(base: DataFrame) -> DataFrame:
    return base


def merge_shards(*shards: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """One table of all shards; a later shard wins, then a higher seq."""
    tagged = [s.withColumn("__shard_no", F.lit(i)) for i, s in enumerate(shards)]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    return _last(union, key, F.struct("__shard_no", seq)).drop("__shard_no")


def distinct_keys(*shards: DataFrame, key: str = "key") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [s.select(key) for s in shards]).distinct()


def write_shards(df: DataFrame, path: str, key: str, n: int) -> None:
    """Overwrite only the shards present in ``df``.

    Rows of a shard are spread over a few writers by key, so no shard is one task.
    """
    spread = F.pmod(F.xxhash64(key), F.lit(8))
    (
        with_shard(df, key, n)
        .repartition("shard", spread)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )
