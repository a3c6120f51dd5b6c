"""A stored keyed table: versions of shards, updated by rewriting only the shards a change touches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlake.functions.hashing import shard_of
from varlake.operators.keyed import _last, delete, existed, upsert
from varlake.session import cut_lineage
from varlake.sources.shared_files import Conflict, VersionLog


class KeyedStore:
    """One row per key, in ``shards`` shards by the key's hash.

    A version is a record that names, for every shard, the commit that wrote it. A change reads
    and writes anew the shards of its keys only and commits a record that points the others to
    where they were; older versions stay readable. Two writers may commit at a time: the second
    one's record is put on top of the first one's where their shards differ, else it raises
    :class:`Conflict` and can be tried again.

    Files are sorted by key and each commit lists the key range of its files, so :meth:`get`
    opens only files that can hold a wanted key. A null key is a key, kept in shard 0.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = VersionLog(spark, f"{self.path}/versions")
        if not self.log.numbers():
            raise FileNotFoundError(f"no version of a keyed table in {path}")
        first = self.log.read(self.log.numbers()[0])
        self.key, self.shards = first["key"], first["shards"]

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str = "key", shards: int = 64) -> KeyedStore:
        """Store ``df``, which has one row per key, as the first version."""
        self = object.__new__(cls)
        self.spark, self.path, self.key, self.shards = df.sparkSession, path.rstrip("/"), key, shards
        self.log = VersionLog(self.spark, f"{self.path}/versions")
        commit, rows = self._write(df)
        record = {"key": key, "shards": shards, "schema": df.schema.jsonValue(), "commits": {k: commit for k in rows}, "rows": rows}
        self.log.commit(1, record | {"touched": list(range(shards))})
        return self

    def _shard(self, key: str) -> Column:
        return F.coalesce(shard_of(key, self.shards), F.lit(0))

    def _write(self, df: DataFrame) -> tuple[str, dict[str, int]]:
        """Write rows under a commit of their own; its name, and the number of rows by shard."""
        commit = uuid.uuid4().hex
        folder = f"{self.path}/data/commit={commit}"
        laid = df.withColumn("__shard", self._shard(self.key)).repartitionByRange("__shard", self.key)
        laid.sortWithinPartitions("__shard", self.key).withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(folder)
        schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType())])
        back = self.spark.read.schema(schema).parquet(folder).select("shard", self.key, F.col("_metadata.file_path").alias("file"))
        k = F.col(self.key)
        ranges = back.groupBy("shard", "file").agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.count("*").alias("rows"), F.count_if(k.isNull()).alias("nulls"))
        ranges.write.parquet(f"{self.path}/files/commit={commit}")
        written = self.spark.read.schema(ranges.schema).parquet(f"{self.path}/files/commit={commit}")
        return commit, {str(r["shard"]): r["n"] for r in written.groupBy("shard").agg(F.sum("rows").alias("n")).collect()}

    def versions(self) -> list[int]:
        return self.log.numbers()

    def _record(self, version: int | None) -> tuple[int, dict]:
        number = self.versions()[-1] if version is None else version
        return number, self.log.read(number)

    def _read(self, record: dict, shards: list[int] | None = None) -> DataFrame:
        commits = record["commits"]
        wanted = commits if shards is None else [str(k) for k in shards if str(k) in commits]
        schema = T.StructType.fromJson(record["schema"])
        paths = [f"{self.path}/data/commit={commits[k]}/shard={k}" for k in sorted(wanted, key=int)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the newest or of an older version."""
        return self._read(self._record(version)[1])

    def _touched(self, keys: DataFrame) -> list[int]:
        """Shards of these keys: at most as many numbers as there are shards."""
        return sorted(r[0] for r in keys.select(self._shard(self.key)).distinct().collect())

    def _commit(self, number: int, record: dict, touched: list[int], new: DataFrame) -> int:
        commit, rows = self._write(new)
        while True:
            mine = {k: commit for k in rows}
            kept = {k: c for k, c in record["commits"].items() if int(k) not in touched}
            counts = {k: n for k, n in record["rows"].items() if int(k) not in touched}
            number += 1
            try:
                return self.log.commit(number, record | {"commits": kept | mine, "rows": counts | rows, "touched": touched})
            except Conflict:
                record = self.log.read(number)
                if set(record["touched"]) & set(touched):
                    raise

    def upsert(self, changes: DataFrame, seq: str = "seq") -> int:
        """Apply changes, of several to a key the one of highest ``seq``; returns the new version."""
        number, record = self._record(None)
        latest = cut_lineage(_last(changes, self.key, seq))
        touched = self._touched(latest)
        if not touched:
            return number
        return self._commit(number, record, touched, upsert(self._read(record, touched), latest, self.key, seq))

    def delete(self, keys: DataFrame) -> tuple[int, DataFrame]:
        """Remove these keys; returns the new version and each key with whether it was there."""
        number, record = self._record(None)
        keys = cut_lineage(keys.select(self.key).distinct())
        touched = self._touched(keys)
        old = self._read(record, touched)
        found = existed(old, keys, self.key)
        return (self._commit(number, record, touched, delete(old, keys, self.key)) if touched else number), found

    def files(self, version: int | None = None) -> DataFrame:
        """(shard, file, lo, hi, rows, nulls) of every file of a version."""
        return self._files(self._record(version)[1])

    def _files(self, record: dict) -> DataFrame:
        kind = T.StructType.fromJson(record["schema"])[self.key].dataType
        schema = T.StructType([
            T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("lo", kind), T.StructField("hi", kind),
            T.StructField("rows", T.LongType()), T.StructField("nulls", T.LongType()), T.StructField("commit", T.StringType()),
        ])
        commits = record["commits"]
        paths = [f"{self.path}/files/commit={c}" for c in sorted(set(commits.values()))]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("commit")
        every = self.spark.read.schema(schema).option("basePath", f"{self.path}/files").parquet(*paths)
        live = self.spark.createDataFrame([(int(k), c) for k, c in commits.items()], "shard INT, commit STRING")
        return every.join(F.broadcast(live), ["shard", "commit"], "left_semi").drop("commit")

    def get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Every asked row with its key's other columns, or with nulls where there is no such key.

        Asked keys meet the key ranges of their shard's files first; the driver gets the names of
        the files to open, never more than the version has, and no row.
        """
        record = self._record(version)[1]
        schema = T.StructType.fromJson(record["schema"])
        wanted = keys.select(F.col(self.key).alias("__k")).distinct().withColumn("shard", self._shard("__k"))
        here = F.col("__k").between(F.col("lo"), F.col("hi")) | (F.col("__k").isNull() & (F.col("nulls") > 0))
        files = self._files(record).where("rows > 0").join(wanted, "shard").where(here).select("file").distinct()
        paths = sorted(r["file"] for r in files.collect())
        found = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        found = found.withColumnRenamed(self.key, "__f")
        return keys.join(found, keys[self.key].eqNullSafe(F.col("__f")), "left").drop("__f")
