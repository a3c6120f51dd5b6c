from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from varlake.functions import text as X
from varlake.functions.hashing import draw_index, shard_of
from varlake.functions.jsontext import is_json, parse_whole, revision


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, X.task_to_sentence("t"), t="pick_up_the_cup") == "pick up the cup"
    assert one(spark, X.suite_of("t"), t="kitchen_10_no_noops") == "kitchen_10"
    assert one(spark, X.suite_of("t"), t="kitchen") == "kitchen"
    assert one(spark, X.strip_scene_prefix("t"), t="KITCHEN SCENE3 turn on the stove") == "turn on the stove"
    assert one(spark, X.strip_scene_prefix("t"), t="LIVING ROOM SCENE12 put it down") == "put it down"
    assert one(spark, X.strip_scene_prefix("t"), t="turn on SCENE3 now") == "turn on SCENE3 now"


def test_slug_cuts_at_fifty(spark):
    name = "Put The Bowl.\nthen " + "x" * 60
    assert one(spark, X.task_slug("t"), t=name) == ("put_the_bowl__then_" + "x" * 60)[:50]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("tâche".encode()),), (bytearray(b"\xff\xfe"),)], "b BINARY")
    assert [r[0] for r in df.select(X.decode_text("b")).collect()] == ["tâche", None]


def test_run_id_round_trip(spark):
    df = spark.createDataFrame(
        [("kitchen-2", "net", "one", "2025_01_02-03_04_05", None), ("a", "net", "all", "2025_01_02-03_04_05", "x--y")],
        "suite STRING, family STRING, scope STRING, at STRING, note STRING",
    )
    out = df.withColumn("run", X.run_id("suite", "family", "scope", "at", "note")).withColumn("p", X.parse_run_id("run"))
    got = out.select("run", "p.*").collect()
    assert got[0]["run"] == "EVAL-kitchen-2-net-one-2025_01_02-03_04_05"
    assert tuple(got[0])[1:] == ("kitchen-2", "net", "one", "2025_01_02-03_04_05", None)
    assert tuple(got[1])[1:] == ("a", "net", "all", "2025_01_02-03_04_05", "x--y")


def test_rollout_path_round_trip(spark):
    df = spark.createDataFrame([("EVAL-a", "2025", 7, True, "Open The.Door")], "r STRING, d STRING, e INT, s BOOLEAN, t STRING")
    p = df.select(X.rollout_path("r", "d", "e", "s", "t").alias("p"))
    assert p.first()["p"] == "./rollouts/EVAL-a/2025--episode=7--success=True--task=open_the_door.mp4"
    assert tuple(p.select(X.parse_rollout_path("p").alias("x")).first()["x"]) == ("EVAL-a", "2025", 7, True, "open_the_door")
    bad = spark.createDataFrame([("notes.txt",)], "p STRING")
    assert bad.select(X.parse_rollout_path("p")).first()[0] is None


def test_number_texts_match_python(spark):
    pairs = [(k, n) for n in (1, 3, 7, 16, 400, 1000, 2000, 4001, 30000) for k in range(0, n + 1, max(1, n // 40))]
    df = spark.createDataFrame(pairs, "k INT, n INT").withColumn("r", F.col("k") / F.col("n"))
    for k, n, pct, txt in df.select("k", "n", X.percent_text("r"), X.float_text("r")).collect():
        assert pct == f"{k / n * 100:.1f}"
        assert txt == repr(k / n)
    small = [1e-4, 5e-4, 9.99000999000999e-4, 5e-5, 1.25e-7, 3e-12, 0.1 / 3000]
    for v, txt in spark.createDataFrame([(v,) for v in small], "v DOUBLE").select("v", X.float_text("v")).collect():
        assert txt == repr(v)


def test_shard_is_md5_mod(spark):
    keys = ["", "a", "ключ", "x" * 500, *map(str, range(200))]
    df = spark.createDataFrame([(k,) for k in keys], "k STRING")
    for n in (1, 2, 97, 2**31 - 1):
        for k, s in df.select("k", shard_of("k", n)).collect():
            assert s == int(hashlib.md5(k.encode()).hexdigest(), 16) % n


def test_draw_is_uniform_and_independent_of_partitioning(spark):
    df = spark.range(6000).withColumn("d", draw_index(7, ["id"], F.lit(6)))
    a = {r["id"]: r["d"] for r in df.collect()}
    b = {r["id"]: r["d"] for r in df.repartition(13).collect()}
    assert a == b
    counts = [sum(v == i for v in a.values()) for i in range(6)]
    assert min(counts) > 850 and max(counts) < 1150


def test_json_strictness(spark):
    good = ['{"a": 1}', "[1, 2]", " 3 ", "null", '"x"', '{"a": {"b": []}}\n']
    bad = ["", " ", "{", '{"a": 1} x', '{"a": 1}}', '{"a": 1}] [', '{"a": 1}, {"b": 2}', "{'a': 1}", "```{}```", '{"a": 1}} {', None]
    df = spark.createDataFrame([(t,) for t in good + bad], "t STRING")
    assert [r[0] for r in df.select(is_json("t")).collect()] == [True] * len(good) + [False] * len(bad)


def test_parse_whole(spark):
    cases = {
        '{"a": 1}': {"a": 1, "b": None},
        '{"a": 1, "a": 2, "b": "x", "c": [1]}': {"a": 2, "b": "x"},
        ' {"b": "\u00e9"}\n': {"a": None, "b": "é"},
        '{"a": "word"}': None,
        "null": None,
        "": None,
        '{"a": 1} x': None,
        '{"a": 1}}': None,
        '{"a": 1}] [': None,
        '{"a": 1}, {"a": 2}': None,
        '{"a": 1}} {': None,
        '{"a": 1}, "y": {"a": 2}': None,
        "{'a': 1}": None,
        '[{"a": 1}]': None,
        '{"a": 1, "z": {bad}}': None,
        '{"a": 1}],"x":[{"a": 2}': None,
        '{"a": 1}]} {"x":[': None,
        '{"__mark": "m", "a": 3}': {"a": 3, "b": None},
    }
    df = spark.createDataFrame([(t,) for t in cases], "t STRING")
    got = [r[0] and r[0].asDict() for r in df.select(parse_whole("t", "STRUCT<a: INT, b: STRING>")).collect()]
    assert got == list(cases.values())


def test_revision(spark):
    cases = {
        '{"RAW": "a", "REVISED": ["b", "c"]}': ("a", ["b", "c"]),
        '{"REVISED": []}': (None, []),
        '{"RAW": "a"}': None,
        '{"RAW": "a", "REVISED": "b"}': None,
        '[{"RAW": "a", "REVISED": ["b"]}]': None,
        '```json\n{"RAW": "a", "REVISED": ["b"]}\n```': None,
        '{"RAW": "a", "REVISED": ["b"]} {"x": 1}': None,
        "{'RAW': 'a', 'REVISED': ['b']}": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t STRING")
    got = [r[0] for r in df.select(revision("t")).collect()]
    assert [None if g is None else (g["RAW"], g["REVISED"]) for g in got] == list(cases.values())


def test_maps_are_parsed_whole(spark):
    cases = {
        '{"a": "1", "b": null}': {"a": "1", "b": None},
        "{}": {},
        '{"a": "1"}, {"b": "2"}': None,
        '{"a": "1"}],"x":[{"b": "2"}': None,
        '["a"]': None,
        "null": None,
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t STRING")
    assert [r[0] for r in df.select(parse_whole("t", "MAP<STRING, STRING>")).collect()] == list(cases.values())


def test_a_reply_is_parsed_once(spark):
    """Filter and projection share one parse of the text."""
    from conftest import plan

    from varlake.operators.enrich import parse_response

    df = spark.createDataFrame([('{"RAW": "a", "REVISED": ["b"]}',), ("no",)], "content STRING")
    ok, failed = parse_response(df)
    assert plan(ok).count("from_json") == 1 and plan(failed).count("from_json") == 1
    assert [tuple(r) for r in ok.collect()] == [('{"RAW": "a", "REVISED": ["b"]}', "a", ["b"])]
    assert [r[0] for r in failed.collect()] == ["no"]
