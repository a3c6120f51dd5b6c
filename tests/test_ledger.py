"""Calls that store as they go, and the version log below them."""

from __future__ import annotations

import glob
import threading

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varlake.operators.ledger import enrich_stored, read_outputs
from varlake.sources.shared_files import Conflict, VersionLog

OUT = "id LONG, y STRING"


def _counting(where, fails=()):
    """Every call leaves a file of its own, so a second call of an input that worked is an error."""

    def fn(row):
        import os

        if row["id"] in fails:
            raise ValueError(f"no {row['id']}")
        name = f"{where}/{row['id']}"
        assert not os.path.exists(name), f"{row['id']} called twice"
        open(name, "x").close()
        return [{"id": row["id"], "y": f"{row['x']}{k}"} for k in range(row["id"] % 3)]

    return fn


def _inputs(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("x"), "id").alias("x"))


def _want(n):
    return sorted([(i, f"x{i}{k}") for i in range(n) for k in range(i % 3)], key=repr)


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    store, calls = str(tmp_path / "store"), tmp_path / "calls"
    calls.mkdir()
    with pytest.raises(Exception, match="no 37"):
        enrich_stored(_inputs(spark, 100), _counting(str(calls), {37}), OUT, store, buckets=5, chunk=4)
    before = len(list(calls.iterdir()))
    assert 0 < before < 100
    stored = read_outputs(spark, store, OUT).count()
    assert stored == len([1 for c in calls.iterdir() for _ in range(int(c.name) % 3)])
    log = enrich_stored(_inputs(spark, 100), _counting(str(calls)), OUT, store, chunk=4)
    assert log.agg(F.sum("inputs")).first()[0] == 100 - before
    assert rows(read_outputs(spark, store, OUT)) == _want(100)
    again = enrich_stored(_inputs(spark, 100), _counting(str(calls)), OUT, store)
    assert again.count() == 0 and rows(read_outputs(spark, store, OUT)) == _want(100)


def test_more_inputs_later(spark, tmp_path):
    store, calls = str(tmp_path / "store"), tmp_path / "calls"
    calls.mkdir()
    for n in (10, 40, 40, 55):
        enrich_stored(_inputs(spark, n).unionAll(_inputs(spark, 7)), _counting(str(calls)), OUT, store, buckets=3, chunk=4, tasks=2, threads=3)
        assert rows(read_outputs(spark, store, OUT)) == _want(n)
    names = [f.split("/")[-1] for f in glob.glob(f"{store}/outputs/bucket=*/*")]
    assert len(names) == len(set(names)) and not any(n.startswith("_") for n in names)
    assert {f.split("=")[-1] for f in glob.glob(f"{store}/outputs/*")} <= {"0", "1", "2"}


def test_failed_inputs_are_kept_and_called_again(spark, tmp_path):
    store, calls = str(tmp_path / "store"), tmp_path / "calls"
    calls.mkdir()
    log = enrich_stored(_inputs(spark, 20), _counting(str(calls), {3, 4}), OUT, store, buckets=2, on_error="keep")
    errors = rows(log.where("error IS NOT NULL").select("input", "error"))
    assert errors == [('{"id": 3, "x": "x3"}', "ValueError: no 3"), ('{"id": 4, "x": "x4"}', "ValueError: no 4")]
    enrich_stored(_inputs(spark, 20), _counting(str(calls)), OUT, store)
    assert rows(read_outputs(spark, store, OUT)) == _want(20)
    with pytest.raises(ValueError):
        enrich_stored(_inputs(spark, 1), _counting(str(calls)), OUT, store, on_error="drop")


def test_only_failed_rows_of_a_chunk_are_repeated(spark, tmp_path):
    store, where = str(tmp_path / "store"), str(tmp_path)

    def flaky(row):
        with open(f"{where}/seen-{row['id']}", "a") as f:
            f.write("x")
        if row["id"] == 5 and len(open(f"{where}/seen-5").read()) < 3:
            raise OSError("busy")
        return [{"id": row["id"], "y": None}]

    enrich_stored(spark.range(8), flaky, OUT, store, buckets=1, tries=3)
    tried = {i: len((tmp_path / f"seen-{i}").read_text()) for i in range(8)}
    assert tried == {i: 3 if i == 5 else 1 for i in range(8)}


def test_nulls_maps_and_no_inputs(spark, tmp_path):
    df = spark.createDataFrame([(None, None, None), (2**60 + 1, {"a": 1}, [1, None])] * 2, "id LONG, m MAP<STRING, LONG>, a ARRAY<LONG>")
    fn = lambda r: [{"id": r["id"], "y": repr((r["m"], r["a"]))}]
    enrich_stored(df, fn, OUT, str(tmp_path / "a"), buckets=2)
    assert rows(read_outputs(spark, str(tmp_path / "a"), OUT)) == sorted([(None, "(None, None)"), (2**60 + 1, "({'a': 1}, [1, None])")], key=repr)
    assert read_outputs(spark, str(tmp_path / "b"), OUT).count() == 0
    assert enrich_stored(df.limit(0), fn, OUT, str(tmp_path / "b")).count() == 0


def test_a_version_is_committed_once(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "log"))
    assert log.numbers() == []
    won = []

    def writer(k):
        mine = VersionLog(spark, str(tmp_path / "log"))
        try:
            mine.commit(1, {"by": k})
            won.append(k)
        except Conflict:
            pass

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.read(1) == {"by": won[0]}
    assert log.append({"é": [1]}) == 2 and log.numbers() == [1, 2] and log.read(2) == {"é": [1]}
    with pytest.raises(Conflict):
        log.commit(2, {})
