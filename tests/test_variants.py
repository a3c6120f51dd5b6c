from __future__ import annotations

import json

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from varlake.operators import variants as V
from varlake.schemas import EPISODE
from varlake.sources import files as S
from varlake.sources.episodes import read_episodes


@pytest.fixture(scope="module")
def variants(spark):
    data = [
        ("all", "lift the cup", 0, "please lift the cup"),
        ("one", "lift the cup", 1, "raise the cup"),
        ("one", "lift the cup", 0, "lift the mug"),
        ("two", "lift the cup", 0, "raise the mug"),
        ("two", "lift the cup", 1, "lift the mug"),
        ("odd", "lift the cup", 0, "never used"),
        ("one", "open it", 0, "open it"),
    ]
    return spark.createDataFrame(data, "scope STRING, instruction STRING, pos INT, variant STRING")


def test_pool_keeps_scope_order_and_repeats(variants):
    pool = V.merge_pool(variants).where("instruction = 'lift the cup'").orderBy("idx").collect()
    assert [r["variant"] for r in pool] == ["lift the mug", "raise the cup", "raise the mug", "lift the mug", "please lift the cup"]
    assert [(r["idx"], r["n"]) for r in pool] == [(i, 5) for i in range(5)]
    distinct = V.merge_pool(variants, distinct=True).where("instruction = 'lift the cup'").orderBy("idx").collect()
    assert [r["variant"] for r in distinct] == ["lift the mug", "raise the cup", "raise the mug", "please lift the cup"]


def test_variants_of_unknown_scopes_are_listed(spark, variants):
    more = variants.union(spark.createDataFrame([(None, "open it", 2, "shut it")], variants.schema))
    bad = V.unknown_scopes(more)
    assert rows(bad.select("scope", "variant", "reason")) == [("odd", "never used", "unknown_scope"), (None, "shut it", "unknown_scope")]
    assert V.merge_pool(more).count() + bad.count() == more.count()


def test_pool_quality(variants):
    got = {(r["scope"], r["instruction"]): r for r in V.pool_quality(variants, expected=2).collect()}
    r = got["one", "lift the cup"]
    assert (r["n_variants"], r["n_distinct"], r["n_identity"], r["complete"]) == (2, 2, 0, True)
    assert got["one", "open it"]["n_identity"] == 1


def test_draw_paths_agree_and_stay_in_the_pool(spark, variants):
    pool = V.merge_pool(variants)
    episodes = spark.range(400).select(
        F.col("id").alias("episode_id"),
        F.expr("CASE WHEN id % 5 = 0 THEN 'unknown' WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 'open it' ELSE 'lift the cup' END").alias("instruction"),
    )
    small = V.draw_variant(episodes, pool, 3, ["episode_id"])
    large = V.draw_variant(episodes.repartition(7), pool, 3, ["episode_id"], limit=0)
    assert rows(small) == rows(large)
    allowed = {}
    for r in pool.collect():
        allowed.setdefault(r["instruction"], set()).add(r["variant"])
    for r in small.collect():
        assert r["new_instruction"] in allowed.get(r["instruction"], {r["instruction"]})
    drawn = {r["new_instruction"] for r in small.collect() if r["instruction"] == "lift the cup"}
    assert drawn == allowed["lift the cup"]
    other = V.draw_variant(episodes, pool, 4, ["episode_id"])
    assert rows(small) != rows(other)


def test_index_and_its_legacy_form(spark):
    df = spark.createDataFrame(
        [(i, ["b", "a", "b", "c", "b"][i]) for i in range(5)], "episode_id LONG, instruction STRING"
    )
    got = V.episodes_per_instruction(df, "episode_id", "episode_id", hot_rows=2, span=2)
    assert rows(got) == [("a", 1, 1, 1), ("b", 0, 1, 0), ("b", 0, 2, 2), ("b", 0, 3, 4), ("c", 3, 1, 3)]
    legacy = V.episodes_per_instruction(df, "episode_id", "episode_id", legacy_dup_first=True)
    lists = {}
    for ins, _, pos, key in sorted(rows(legacy), key=lambda r: r[2]):
        lists.setdefault(ins, []).append(key)
    assert lists == {"b": [0, 0, 2, 4], "a": [1, 1], "c": [3, 3]}
    chunks = V.index_chunks(got, 2).orderBy("instruction", "chunk").collect()
    assert [(r["instruction"], r["chunk"], r["keys"]) for r in chunks] == [
        ("a", 0, [1]), ("b", 0, [0, 2]), ("b", 1, [4]), ("c", 0, [3]),
    ]


def _episode(i, texts):
    steps = [
        ([0.5, float(i)], 1.0, t == 0, t == len(texts) - 1, False, x, 0.0, (bytearray(b"img"), bytearray(b"wrist"), [0.0], [1.0]))
        for t, x in enumerate(texts)
    ]
    return (i, f"file{i}", steps)


@pytest.fixture(scope="module")
def episodes(spark, tmp_path_factory):
    data = [
        _episode(0, ["lift the cup"] * 3),
        _episode(1, []),
        _episode(2, [None, "x"]),
        _episode(3, ["no pool here", "other"]),
        (4, "file4", None),
    ]
    path = str(tmp_path_factory.mktemp("episodes") / "e.parquet")
    spark.createDataFrame(data, EPISODE).write.parquet(path)
    return read_episodes(spark, path)


def test_first_instruction_and_quarantine(episodes):
    good, bad = V.first_instruction(episodes)
    assert rows(good) == [(0, "lift the cup"), (3, "no pool here")]
    assert rows(bad) == [(1, "no_steps"), (2, "unreadable_instruction"), (4, "no_steps")]


def test_first_instruction_reads_one_field(episodes):
    good, _ = V.first_instruction(episodes)
    schema = plan(good).split("ReadSchema: ")[1]
    assert "language_instruction" in schema and "image" not in schema and "action" not in schema


def test_rewrite_fills_every_step(episodes, variants):
    out, bad = V.rewrite_instructions(episodes, V.merge_pool(variants), seed=1)
    got = {r["episode_id"]: r for r in out.collect()}
    assert set(got) == {0, 3}
    texts = [s["language_instruction"] for s in got[0]["steps"]]
    assert len(texts) == 3 and len(set(texts)) == 1 and texts[0] != "lift the cup"
    assert [s["language_instruction"] for s in got[3]["steps"]] == ["no pool here", "no pool here"]
    assert bytes(got[0]["steps"][0]["observation"]["image"]) == b"img"
    assert out.schema["steps"].dataType.elementType.simpleString() == episodes.schema["steps"].dataType.elementType.simpleString()
    assert rows(bad) == [(1, "no_steps"), (2, "unreadable_instruction"), (4, "no_steps")]


def test_rewrite_of_nested_episodes_has_no_row_exchange(episodes, variants, spark, tmp_path):
    path = str(tmp_path / "pool")
    V.merge_pool(variants).write.parquet(path)
    out, _ = V.rewrite_instructions(episodes, spark.read.parquet(path), seed=1)
    text = plan(out)
    assert "BroadcastHashJoin" in text
    stream_side = text.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in stream_side and "SortMergeJoin" not in text


def test_epochs_draw_anew(spark, variants):
    pool = V.merge_pool(variants)
    e = spark.range(50).select(F.col("id").alias("episode_id"), F.lit("lift the cup").alias("instruction"))
    a = V.draw_variant(e, pool, 1, [F.lit("0"), "episode_id"])
    b = V.draw_variant(e, pool, 1, [F.lit("1"), "episode_id"])
    assert rows(a) != rows(b)


def test_rewrite_long_matches_nested(spark, variants):
    pool = V.merge_pool(variants)
    steps = spark.range(60).select(
        F.expr("id div 6").alias("episode_id"), F.expr("id % 6").alias("step_idx"),
        F.expr("CASE WHEN id % 6 = 0 THEN 'lift the cup' ELSE 'later text' END").alias("language_instruction"),
    )
    out, unread = V.rewrite_long(steps.repartition(4), pool, 9)
    assert unread.count() == 0
    per = out.groupBy("episode_id").agg(F.count_distinct("new_instruction").alias("d"), F.count("*").alias("n"))
    assert {(r["d"], r["n"]) for r in per.collect()} == {(1, 6)}
    heads = steps.where("step_idx = 0").select("episode_id", F.col("language_instruction").alias("instruction"))
    want = V.draw_variant(heads, pool, 9, ["episode_id"]).select("episode_id", "new_instruction")
    assert rows(out.select("episode_id", "new_instruction").distinct()) == rows(want)


def test_blocks_of_an_episode_share_its_draw(spark, variants):
    """Episode 1: text changes after step 500 of 1,030; 2: first text null; 3: no steps."""
    steps = spark.range(1030).select(
        F.lit(1).alias("e"), (F.col("id") + 1).alias("i"), F.expr("if(id < 500, 'lift the cup', 'open it')").alias("language_instruction")
    )
    unread = spark.range(2000).select(F.lit(2), F.col("id") + 1, F.expr("if(id < 1, NULL, 'open it')"))
    nested = V.nest_steps(steps.union(unread), "e", "i", ["language_instruction"], block=1024)
    nested = nested.union(nested.limit(1).select(F.lit(3), F.lit(0), F.slice("steps", 1, 0)))
    pool = V.merge_pool(variants)
    for limit in (1 << 26, 0):
        out, bad = V.rewrite_instructions(nested, pool, 1, key="e", block="block", limit=limit)
        got = out.select("e", "block", F.explode("steps").alias("s")).select("e", "block", "s.*").collect()
        assert sorted(r["i"] for r in got) == list(range(1, 1031)) and {r["block"] for r in got} == {0, 1}
        head = spark.createDataFrame([(1, "lift the cup")], "e INT, instruction STRING")
        assert {r["language_instruction"] for r in got} == {V.draw_variant(head, pool, 1, ["e"]).first()["new_instruction"]}
        assert rows(bad) == [(2, "unreadable_instruction"), (3, "no_steps")]


def test_nest_steps_of_whole_episodes(spark):
    steps = spark.range(3000).select(F.expr("id % 2").alias("e"), F.expr("id div 2 + 1").alias("i"))
    out = V.nest_steps(steps.repartition(5), "e", "i", [], block=None).orderBy("e").collect()
    assert [[s["i"] for s in r["steps"]] for r in out] == [list(range(1, 1501))] * 2


def test_nest_steps_bounds_rows(spark):
    steps = spark.range(25).select(F.lit(1).alias("e"), (F.col("id") + 1).alias("i"), F.col("id").alias("v"))
    out = V.nest_steps(steps, "e", "i", ["v"], block=10).orderBy("block").collect()
    assert [len(r["steps"]) for r in out] == [10, 10, 5]
    assert [s["v"] for r in out for s in r["steps"]] == list(range(25))


def test_variant_files(spark, tmp_path):
    for scope in ("one", "two"):
        (tmp_path / f"{scope}_kitchen.json").write_text(json.dumps({"b": [f"{scope} b", "x"], "a": [f"{scope} a"]}, indent=4))
    (tmp_path / "all_kitchen.json").write_text("{broken")
    got = S.read_variants(spark, f"{tmp_path}/*.json").select("suite", "scope", "ord", "instruction", "pos", "variant")
    assert rows(got) == [
        ("kitchen", "one", 0, "b", 0, "one b"), ("kitchen", "one", 0, "b", 1, "x"), ("kitchen", "one", 1, "a", 0, "one a"),
        ("kitchen", "two", 0, "b", 0, "two b"), ("kitchen", "two", 0, "b", 1, "x"), ("kitchen", "two", 1, "a", 0, "two a"),
    ]
    lacking = S.missing_scopes(got, suites=["kitchen", "garden"])
    assert rows(lacking) == [("garden", ["one", "two", "all"]), ("kitchen", ["all"])]
    with pytest.raises(Exception, match="not a JSON object"):
        S.read_variants(spark, f"{tmp_path}/*.json", strict=True).count()
    with pytest.raises(FileNotFoundError, match="kitchen has no file for all"):
        S.read_variants(spark, [f"{tmp_path}/one_*.json", f"{tmp_path}/two_*.json"], strict=True)


def test_variant_files_of_many_suites(spark, tmp_path):
    data = [
        (suite, scope, o, f"{suite} {o}", p, f"{scope} {o} {p}")
        for suite in ("kitchen", "living_room") for scope in ("one", "all") for o in range(5) for p in range(2)
    ]
    df = spark.createDataFrame(data, "suite STRING, scope STRING, ord INT, instruction STRING, pos INT, variant STRING")
    S.write_variants(df.repartition(3), str(tmp_path / "v"))
    names = {p.name for p in (tmp_path / "v").iterdir() if p.is_dir()}
    assert names == {f"file={s}_{u}.json" for s in ("one", "all") for u in ("kitchen", "living_room")}
    got = S.read_variants(spark, str(tmp_path / "v"))
    assert rows(got.drop("ord")) == rows(df.drop("ord"))
    assert {(r["suite"], tuple(r["missing"])) for r in S.missing_scopes(got).collect()} == {("kitchen", ("two",)), ("living_room", ("two",))}


def test_shuffle_is_seeded(spark):
    df = spark.range(200)
    a, b, c = (rows(V.shuffle_rows(d, "id", s)) for d, s in ((df, 1), (df.repartition(9), 1), (df, 2)))
    assert a == b != c
    assert sorted(p for _, p in a) == list(range(1, 201))


def test_blocks_must_be_named(spark):
    """Blocks taken for episodes would draw once each; that is an error, not a silent result."""
    steps = spark.range(30).select(F.lit(1).alias("e"), (F.col("id") + 1).alias("i"), F.lit("go").alias("language_instruction"))
    pool = V.merge_pool(spark.createDataFrame([("go", "one", 0, "walk")], "instruction STRING, scope STRING, pos INT, variant STRING"))
    with pytest.raises(ValueError, match="block"):
        V.rewrite_instructions(V.nest_steps(steps, "e", "i", ["language_instruction"], block=10), pool, 1, key="e")
    out, _ = V.rewrite_instructions(V.nest_steps(steps, "e", "i", ["language_instruction"]), pool, 1, key="e")
    assert {s["language_instruction"] for r in out.collect() for s in r["steps"]} == {"walk"}


def test_long_form_reports_episodes_without_an_instruction(spark):
    steps = spark.createDataFrame([(1, 0, None), (1, 1, "go"), (2, 0, "go"), (2, 1, None)], "episode_id INT, step_idx INT, language_instruction STRING")
    pool = V.merge_pool(spark.createDataFrame([("go", "one", 0, "walk")], "instruction STRING, scope STRING, pos INT, variant STRING"))
    out, bad = V.rewrite_long(steps, pool, 1)
    assert sorted((r["episode_id"], r["step_idx"], r["new_instruction"]) for r in out.collect()) == [(2, 0, "walk"), (2, 1, "walk")]
    assert [tuple(r) for r in bad.collect()] == [(1, "unreadable_instruction")]
