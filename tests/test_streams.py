from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from varlake.streaming import streams as T


def drop(df, path):
    df.coalesce(1).write.mode("append").json(path)


def test_tail_goes_on_after_a_restart(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for lo, hi in ((0, 5), (5, 9), (9, 10)):
        drop(spark.range(lo, hi), src)
        T.write_rows(T.stream_jsonl(spark, src, "id LONG"), out, ckpt).awaitTermination()
        assert spark.read.parquet(out).count() == hi
    T.write_rows(T.stream_jsonl(spark, src, "id LONG"), str(tmp_path / "again"), str(tmp_path / "fresh")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "again"))) == [(i,) for i in range(10)]


def test_enrichment_skips_what_is_done(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    calls = tmp_path / "calls"
    calls.mkdir()

    def fn(row, where=str(calls)):
        open(f"{where}/{row['id']}", "x").close()  # a second call for an id would fail
        return [{"id": row["id"], "y": row["id"] + 1}]

    for ids in ([1, 2, 2], [2, 3], [3, 4, 4, 1]):
        drop(spark.createDataFrame([(i,) for i in ids], "id LONG"), src)
        T.stream_enrich(T.stream_jsonl(spark, src, "id LONG"), fn, "id LONG, y LONG", sink, ckpt).awaitTermination()
    assert rows(T.read_sink(spark, sink).select("id", "y")) == [(1, 2), (2, 3), (3, 4), (4, 5)]


def test_retried_batch_overwrites_itself(spark, tmp_path):
    sink = str(tmp_path / "out")
    for _ in range(2):
        spark.range(3).write.mode("overwrite").parquet(T._batch_path(sink, 0))
    assert T.read_sink(spark, sink).count() == 3
    assert T.read_sink(spark, str(tmp_path / "none")) is None


def test_live_success_equals_batch(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = "run_id STRING, task_name STRING, success BOOLEAN"
    all_rows = spark.range(60).select(
        F.lit("r").alias("run_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("task_name"), (F.col("id") % 4 == 0).alias("success")
    )
    for k in range(3):
        drop(all_rows.where(F.col("task_name") != f"t{k}"), src)
        T.write_changes(T.stream_success(T.stream_jsonl(spark, src, schema)), sink, ckpt, ["run_id", "task_name"]).awaitTermination()
    got = T.latest(spark, sink, ["run_id", "task_name"])
    want = T.stream_success(spark.read.schema(schema).json(src))
    assert rows(got.select(want.columns)) == rows(want)


def test_dedupe(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    df = spark.range(20).select("id", F.date_format(F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000), "yyyy-MM-dd HH:mm:ss").alias("ts"))
    drop(df.unionByName(df.where("id > 4")), src)
    rows_in = T.stream_jsonl(spark, src, "id LONG, ts STRING")
    T.write_rows(T.stream_dedupe(rows_in, "id", "ts", "1 day").select("id"), out, ckpt).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(spark.range(20))


def test_fresh_checkpoint_repeats_no_call_and_loses_no_row(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    calls = tmp_path / "calls"
    calls.mkdir()

    def fn(row, where=str(calls)):
        open(f"{where}/{row['id']}", "x").close()  # a second call for an id would fail
        return [{"id": row["id"]}]

    for ids, ckpt in (([1, 2], "a"), ([3], "a"), ([4], "b")):
        drop(spark.createDataFrame([(i,) for i in ids], "id LONG"), src)
        T.stream_enrich(T.stream_jsonl(spark, src, "id LONG"), fn, "id LONG", sink, str(tmp_path / ckpt)).awaitTermination()
    assert rows(T.read_sink(spark, sink).select("id")) == [(1,), (2,), (3,), (4,)]


def test_latest_after_a_fresh_checkpoint(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "run_id STRING, task_name STRING, success BOOLEAN"
    for ckpt in ("a", "a", "b"):
        drop(spark.createDataFrame([("r", "t", True)], schema), src)
        T.write_changes(T.stream_success(T.stream_jsonl(spark, src, schema)), sink, str(tmp_path / ckpt), ["run_id", "task_name"]).awaitTermination()
    assert rows(T.latest(spark, sink, ["run_id", "task_name"])) == [("r", "t", 3, 3)]


def test_dedupe_keeps_late_rows(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for rows_in in ([(1, "2024-03-01 00:00:00")], [(2, "2020-01-01 00:00:00"), (1, "2019-01-01 00:00:00")], [(2, None), (3, None)]):
        drop(spark.createDataFrame(rows_in, "id LONG, ts STRING"), src)
        T.write_rows(T.stream_dedupe(T.stream_jsonl(spark, src, "id LONG, ts STRING"), "id").select("id"), out, ckpt).awaitTermination()
    assert rows(spark.read.parquet(out)) == [(1,), (2,), (3,)]


def test_compaction_bounds_what_latest_reads(spark, tmp_path, monkeypatch):
    """Many batches under two checkpoints, the clock standing still: one snapshot, few deltas."""
    import time

    from varlake.sources.shared_files import VersionLog

    monkeypatch.setattr(time, "time_ns", lambda: 0)
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "run_id STRING, task_name STRING, success BOOLEAN"
    for k in range(7):
        drop(spark.createDataFrame([("r", f"t{k % 3}", k % 2 == 0)], schema), src)
        live = T.stream_success(T.stream_jsonl(spark, src, schema))
        T.write_changes(live, sink, str(tmp_path / f"ckpt{k // 4}"), ["run_id", "task_name"], compact_every=3).awaitTermination()
        last = VersionLog(spark, f"{sink}/log")
        state = last.read(last.numbers()[-1])
        assert len(state["deltas"]) < 3 and (state["snapshot"] is None) == (k < 2)
        assert len(T.latest(spark, sink, ["run_id", "task_name"]).inputFiles()) < 20
    want = T.stream_success(spark.read.schema(schema).json(src))
    assert rows(T.latest(spark, sink, ["run_id", "task_name"]).select(want.columns)) == rows(want)


def test_enrichment_does_not_read_its_own_sink(spark, tmp_path, monkeypatch):
    """The state knows what is done; only other checkpoints' outputs are ever joined."""
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    joined = []
    monkeypatch.setattr(T, "remaining", lambda fresh, done, key: joined.append(len(done.inputFiles())) or fresh.join(done.select(key).distinct(), key, "left_anti"))
    fn = lambda row: [{"id": row["id"]}]
    for ids, ckpt in (([1, 2], "a"), ([2, 3], "a"), ([3, 4], "a"), ([4, 5], "b")):
        drop(spark.createDataFrame([(i,) for i in ids], "id LONG"), src)
        T.stream_enrich(T.stream_jsonl(spark, src, "id LONG"), fn, "id LONG", sink, str(tmp_path / ckpt)).awaitTermination()
        assert bool(joined) == (ckpt == "b")
    assert rows(T.read_sink(spark, sink).select("id")) == [(i,) for i in range(1, 6)]
