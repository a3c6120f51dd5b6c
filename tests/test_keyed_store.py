"""Stored keyed tables: versions, touched shards, pruned lookups, two writers."""

from __future__ import annotations

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from varlake.functions.hashing import shard_of
from varlake.operators.keyed_store import KeyedStore
from varlake.sources.shared_files import Conflict

SCHEMA = "key STRING, v LONG, seq LONG"


def _df(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    base = _df(spark, [(f"k{i}", i, 0) for i in range(200)] + [(None, -1, 0)])
    return KeyedStore.create(base, str(tmp_path / "t"), "key", 8)


def _shards(spark, keys):
    return {r[0] for r in spark.createDataFrame([(k,) for k in keys], "key STRING").select(shard_of("key", 8)).collect()}


def test_upsert_rewrites_touched_shards_only(spark, store):
    before = store.log.read(1)["commits"]
    changes = _df(spark, [("k5", 50, 1), ("k5", 51, 3), ("k5", 52, 2), ("new", 7, 1)])
    assert store.upsert(changes) == 2
    touched = _shards(spark, ["k5", "new"])
    after = store.log.read(2)["commits"]
    assert {int(k) for k in before if before[k] != after[k]} == touched
    want = [(f"k{i}", 51 if i == 5 else i, 3 if i == 5 else 0) for i in range(200)] + [(None, -1, 0), ("new", 7, 1)]
    assert rows(store.read()) == sorted(want, key=repr)
    assert store.read(1).count() == 201 and store.versions() == [1, 2]
    assert sum(store.log.read(2)["rows"].values()) == 202
    old = store._read(store.log.read(1), sorted(touched))
    assert {int(f.split("shard=")[1].split("/")[0]) for f in old.inputFiles()} == touched
    assert "shard=" in plan(old) or "Scan parquet" in plan(old)
    assert store.upsert(changes.limit(0)) == 2


def test_delete_and_null_key(spark, store):
    version, found = store.delete(_df(spark, [("k1", None, None), ("k1", None, None), ("none", None, None), (None, None, None)]).select("key"))
    assert version == 2 and store.read().count() == 199
    assert rows(store.read().where("key IS NULL OR key = 'k1'")) == []
    assert ("k1", True) in rows(found) and ("none", False) in rows(found)
    store.delete(store.read().select("key"))
    assert store.read().count() == 0 and store.read(2).count() == 199
    assert store.get(_df(spark, [("k2", 0, 0)]).select("key")).collect()[0]["v"] is None
    store.upsert(_df(spark, [("k2", 9, 9)]))
    assert rows(KeyedStore(spark, store.path).read()) == [("k2", 9, 9)]


def test_get_opens_few_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        base = spark.range(5000).select(F.format_string("%06d", "id").alias("key"), F.col("id").alias("v"), F.lit(0).cast("long").alias("seq"))
        store = KeyedStore.create(base, str(tmp_path / "t"), "key", 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = store.files().count()
    asked = spark.createDataFrame([("000010", 1), ("000010", 2), ("nobody", 3), (None, 4)], "key STRING, a LONG")
    got = store.get(asked)
    assert rows(got.select("key", "a", "v")) == sorted([("000010", 1, 10), ("000010", 2, 10), ("nobody", 3, None), (None, 4, None)], key=repr)
    assert len([f for f in got.inputFiles() if "/data/" in f]) <= 1 < 16 < total
    every = store.get(base.select("key"))
    assert every.where("v IS NULL").count() == 0 and every.count() == 5000


def test_two_writers(spark, store):
    """A change of other shards goes on top; one of the same shards must be tried again."""
    mine, other = "k5", next(f"k{i}" for i in range(200) if not _shards(spark, [f"k{i}"]) & _shards(spark, ["k5"]))
    stale = KeyedStore(spark, store.path)
    number, record = stale._record(None)
    store.upsert(_df(spark, [(mine, 500, 1)]))
    stale._record = lambda version: (number, record)
    assert stale.upsert(_df(spark, [(other, 600, 1)])) == 3
    assert rows(store.read().where(f"key IN ('{mine}', '{other}')").select("v")) == [(500,), (600,)]
    with pytest.raises(Conflict):
        stale.upsert(_df(spark, [(mine, 501, 2)]))
    assert store.read().count() == 201


def test_no_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        KeyedStore(spark, str(tmp_path / "x"))
    empty = KeyedStore.create(_df(spark, []), str(tmp_path / "e"), "key", 4)
    assert empty.read().count() == 0 and empty.files().count() == 0
    empty.upsert(_df(spark, [("a", 1, 1)]))
    assert rows(empty.get(_df(spark, [("a", 0, 0)]).select("key"))) == [("a", 1, 1)]
