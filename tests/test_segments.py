"""Segmented windows against Spark's own windows, with one group holding a third of all rows."""

from __future__ import annotations

import random

import pytest
from conftest import plan, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from varlake.operators.segments import (
    chunk_ids,
    moving_mean,
    number_within,
    running,
    split_ids,
    with_hash_ordinal,
    with_ordinal,
)


@pytest.fixture(scope="module")
def skewed(spark):
    df = spark.range(3000).select(
        (F.col("id") * 7 % 3000).alias("id"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 31 = 1 THEN NULL ELSE string(id % 40) END").alias("g"),
        (F.col("id") % 11).cast("int").alias("v"),
    )
    return df.repartition(5).cache()


@pytest.mark.parametrize("hot_rows", [10, 200, 10**6])
def test_running_equals_window(spark, skewed, hot_rows):
    w = Window.partitionBy("g").orderBy("id")
    whole = Window.partitionBy("g")
    names = spark.createDataFrame([("hot", "h"), ("3", "three"), ("absent", "x")], "g STRING, name STRING")
    want = skewed.select(
        "id", "g", "v",
        F.row_number().over(w).cast("bigint").alias("pos"),
        F.sum("v").over(w).alias("s"),
        F.count("*").over(whole).alias("n"),
        F.min("id").over(whole).alias("m"),
    )
    kw = dict(
        span=64, hot_rows=hot_rows, position="pos", sums={"s": F.col("v")},
        group_sums={"n": F.lit(1)}, group_mins={"m": F.col("id")},
    )
    got = running(skewed, ["g"], ["id"], **kw)
    assert rows(got.select(want.columns)) == rows(want)
    both = running(skewed, ["g"], ["id"], attach=names, **kw)
    assert rows(both.select(*want.columns, "name")) == rows(want.join(names, "g", "left").select(*want.columns, "name"))


@pytest.mark.parametrize("hot_rows", [10, 200, 10**6])
def test_running_without_group_totals(spark, skewed, hot_rows):
    w = Window.partitionBy("g").orderBy("id")
    want = skewed.withColumn("pos", F.row_number().over(w))
    got = number_within(skewed, ["g"], ["id"], "pos", span=100, hot_rows=hot_rows)
    assert rows(got) == rows(want)
    names = spark.createDataFrame([("hot", 1), ("3", None)], "g STRING, k INT")
    both = number_within(skewed, ["g"], ["id"], "pos", span=100, hot_rows=hot_rows, attach=names)
    assert rows(both) == rows(want.join(names, "g", "left").select("id", "g", "v", "pos", "k"))


def test_no_task_gets_a_hot_group(skewed):
    got = number_within(skewed, ["g"], ["id"], "pos", span=100, hot_rows=300)
    # The rows' window is keyed by segment, and so is the exchange that feeds it.
    final = plan(got).split("Union")[0]
    assert "__seg" in final.split("Exchange hashpartitioning(")[1].split(")")[0]
    sizes = number_within(skewed.where("g = 'hot'"), ["g"], ["id"], "pos", span=100, hot_rows=300)
    assert sizes.count() == 1000


def test_no_hot_group_means_a_plain_window(skewed):
    text = plan(number_within(skewed, ["g"], ["id"], "pos"))
    assert "Union" not in text and text.count("Exchange hashpartitioning") == 1


def test_hot_group_of_one_order_value(spark):
    df = spark.range(50).select(F.lit("a").alias("g"), F.lit(7).alias("o"), "id")
    got = number_within(df, ["g"], ["o", "id"], "pos", hot_rows=10, span=5)
    assert [r["pos"] for r in got.orderBy("id").collect()] == list(range(1, 51))


def test_hot_group_in_time_order(spark):
    df = spark.range(300).select(
        F.lit("a").alias("g"), F.timestamp_seconds(F.col("id") * F.col("id") * 100).cast("timestamp_ntz").alias("t"), "id"
    )
    got = number_within(df, ["g"], ["t"], "pos", hot_rows=10, span=20)
    assert [r["pos"] for r in got.orderBy("id").collect()] == list(range(1, 301))


def test_order_with_ties_and_second_key(spark):
    data = [("a", i // 4, random.Random(i).random()) for i in range(200)]
    df = spark.createDataFrame(data, "g STRING, o LONG, t DOUBLE")
    got = number_within(df, ["g"], ["o", "t"], "pos", span=8, hot_rows=20)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("o", "t")))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("k", [1, 2, 5, 16])
def test_moving_mean_equals_window(skewed, k):
    base = skewed.where("g IS NOT NULL").withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1)
    w = Window.partitionBy("g").orderBy("i").rowsBetween(-(k - 1), 0)
    got = moving_mean(base, ["g"], "i", {"m": "v"}, k, span=16)
    assert rows(got) == rows(base.withColumn("m", F.avg("v").over(w)))


def test_moving_mean_rejects_long_windows(skewed):
    with pytest.raises(ValueError):
        moving_mean(skewed, ["g"], "id", {"m": "v"}, 17, span=16)


def test_ordinals_on_lopsided_keys(spark):
    # Dense low keys and a few enormous ones: equal-width cuts would put all rows in one segment.
    keys = [*range(1000), 10**15, 10**15 + 1, 2**62, -5]
    df = spark.createDataFrame([(k,) for k in keys], "k LONG").repartition(3)
    got = with_ordinal(df, "k", total="n")
    assert [(r["k"], r["ordinal"], r["n"]) for r in got.orderBy("k").collect()] == [
        (k, i + 1, len(keys)) for i, k in enumerate(sorted(keys))
    ]


def test_ordinals_of_nothing_and_of_text(spark):
    assert with_ordinal(spark.createDataFrame([], "k LONG"), "k").count() == 0
    texts = spark.createDataFrame([("b",), ("a",), (None,), ("ä",)], "k STRING")
    assert rows(with_ordinal(texts, "k", segments=3)) == sorted([(None, 1), ("a", 2), ("b", 3), ("ä", 4)], key=repr)


def _sizes(df) -> list[int]:
    return [r["count"] for r in df.groupBy("__seg").count().collect()]


def test_one_key_is_cut_like_many(spark, monkeypatch):
    """20,000 rows of one key: no partition of the order holds more than twice the span."""
    from varlake.operators import segments

    df = spark.range(20_000).select(F.lit(7).alias("k"), (F.col("id") * 7919 % 20_000).alias("t")).repartition(6)
    laid = segments._in_order(df, ["k", "t"], 20_000 // 500).withColumn("__seg", F.spark_partition_id())
    assert max(_sizes(laid)) <= 2 * 500
    got = with_ordinal(df, "k", ties=("t",), span=500)
    assert got.where("ordinal != t + 1").count() == 0 and got.count() == 20_000
    same = with_ordinal(df.select("k"), "k", span=500)
    assert same.agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal")).first() == (1, 20_000, 20_000)
    laid = segments._in_order(df.select("k"), ["k"], 40).withColumn("__seg", F.spark_partition_id())
    assert max(_sizes(laid)) <= 2 * 500


def test_a_far_value_and_a_repeated_one_leave_no_large_segment(spark, monkeypatch):
    """Equal-width cuts would put all of the group into one segment."""
    from varlake.operators import segments

    order = F.when(F.col("id") == 0, F.lit(1e18)).when(F.col("id") % 2 == 0, F.lit(5.0)).otherwise(F.col("id").cast("double"))
    df = spark.range(12_000).select(F.lit("a").alias("g"), order.alias("o"), "id").unionAll(spark.createDataFrame([("b", 1.0, -1)], "g STRING, o DOUBLE, id LONG"))
    seen = []
    keep = segments._carriers
    monkeypatch.setattr(segments, "_carriers", lambda r, *a: seen.append(max(_sizes(r))) or keep(r, *a))
    got = running(df, ["g"], ["o", "id"], position="p", sums={"s": F.col("id")}, span=400, hot_rows=1000)
    w = Window.partitionBy("g").orderBy("o", "id")
    want = df.select("g", "o", "id", F.row_number().over(w).cast("long").alias("p"), F.sum("id").over(w).alias("s"))
    assert rows(got.select(want.columns)) == rows(want)
    assert seen and seen[0] <= 2 * 400


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(size=st.integers(0, 60), n=st.integers(1, 25))
def test_split_sizes(spark, size, n):
    got = split_ids(spark.range(size), "id", n).orderBy("id").collect()
    base, extra = divmod(size, n)
    want = [p for p in range(n) for _ in range(base + (p < extra))]
    assert [r["part"] for r in got] == want


def test_chunks(spark):
    got = chunk_ids(spark.range(165).select((F.col("id") * 3).alias("id")), "id", 80).groupBy("chunk").count()
    assert rows(got) == [(0, 80), (1, 80), (2, 5)]


def test_hash_ordinal_is_a_permutation(spark):
    df = spark.range(500)
    h = F.pmod(F.xxhash64("id"), F.lit(2**60))
    got = with_hash_ordinal(df, h, 60, "p", ("id",))
    want = df.withColumn("p", F.row_number().over(Window.orderBy(h, "id")))
    assert rows(got) == rows(want)


def test_clock_changes_keep_local_times_in_order(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # Half an hour apart across the hour that this zone skips.
        texts = [f"2024-03-10 {h:02d}:{m:02d}:00" for h in range(6) for m in (0, 30)]
        df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", F.expr("CAST(t AS TIMESTAMP_NTZ)").alias("k"))
        got = with_ordinal(df, "k", segments=6).select("t", "ordinal")
        assert sorted((r["ordinal"], r["t"]) for r in got.collect()) == list(enumerate(texts, 1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
