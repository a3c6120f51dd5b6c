from __future__ import annotations

from collections import Counter

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from varlake.operators import enrich as X
from varlake.operators import keyed as K
from varlake.operators import lookups as L

KEYED = "key STRING, value STRING, seq LONG"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([("a", "1", 0), ("b", "2", 0), ("c", "3", 0)], KEYED)


@pytest.fixture(scope="module")
def changes(spark):
    return spark.createDataFrame([("b", "x", 1), ("b", "y", 3), ("b", "z", 2), ("d", "w", 1), (None, "n", 1)], KEYED)


def test_upsert_delete_get(spark, base, changes):
    merged = K.upsert(base, changes)
    assert rows(merged) == [("a", "1", 0), ("b", "y", 3), ("c", "3", 0), ("d", "w", 1), (None, "n", 1)]
    assert rows(K.upsert(merged, changes)) == rows(merged)
    keys = changes.select("key").where("key IS NOT NULL")
    assert rows(K.delete(merged, keys)) == [("a", "1", 0), ("c", "3", 0), (None, "n", 1)]
    assert rows(K.existed(base, keys)) == [("b", True), ("d", False)]
    assert rows(K.get(base, keys.distinct())) == [("b", "2", 0), ("d", None, None)]
    assert rows(K.delete(K.upsert(base, changes), K.keys(merged).where("key IS NOT NULL"))) == [(None, "n", 1)]
    assert rows(K.delete(base, keys, limit=0)) == rows(K.delete(base, keys))


def test_merge_shards_later_wins(spark, base, changes):
    late = spark.createDataFrame([("b", "last", 0), ("e", "5", 0)], KEYED)
    got = K.merge_shards(base, changes.where("key IS NOT NULL"), late)
    assert rows(got) == [("a", "1", 0), ("b", "last", 0), ("c", "3", 0), ("d", "w", 1), ("e", "5", 0)]
    assert rows(K.distinct_keys(base, late)) == [("a",), ("b",), ("c",), ("e",)]


def test_single_key_reads_one_shard(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("key"), F.col("id").alias("v"))
    K.write_shards(df, str(tmp_path), "key", 8)
    one = K.get_one(spark.read.parquet(str(tmp_path)), "42", 8)
    assert [r["v"] for r in one.collect()] == [42]
    assert "PartitionFilters: [isnotnull(shard" in plan(one)
    K.write_shards(spark.createDataFrame([("42", 1)], "key STRING, v LONG"), str(tmp_path), "key", 8)
    left = spark.read.parquet(str(tmp_path))
    assert rows(left.where("key = '42'").select("v")) == [(1,)]
    assert left.select("shard").distinct().count() == 8


def test_resume(spark):
    inputs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "id LONG, x STRING")
    done = spark.createDataFrame([(2,), (2,), (9,)], "id LONG")
    assert rows(X.remaining(inputs, done, "id")) == [(1, "a"), (1, "b"), (3, "d")]
    assert rows(X.already_done(inputs, done, "id")) == [(2, "c")]
    both = X.append_outputs(done, inputs)
    assert both.count() == 7


def test_resume_twice_is_once(spark):
    inputs = spark.range(20)
    call = lambda df: X.map_batches(df, lambda r: [{"id": r["id"], "y": r["id"] * 2}], "id LONG, y LONG")
    half = X.append_outputs(call(inputs.where("id < 7")), call(X.remaining(inputs, inputs.where("id < 7"), "id")))
    assert rows(half) == rows(call(inputs))


def test_filter_stays_below_the_call(spark):
    left = X.remaining(spark.range(9), spark.range(4), "id")
    text = plan(X.map_batches(left, lambda r: [r], "id LONG"))
    assert text.index("MapInArrow") < text.index("LeftAnti")


def test_batches_flatten_and_retry(spark, tmp_path):
    flag = str(tmp_path / "tried")

    def flaky(row):
        import os

        if row["id"] == 3 and not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("busy")
        return [{"id": row["id"], "k": k} for k in range(row["id"] % 3)]

    got = X.map_batches(spark.range(6), flaky, "id LONG, k LONG", key="id", concurrency=2, tries=2)
    assert rows(got) == [(1, 0), (2, 0), (2, 1), (4, 0), (5, 0), (5, 1)]


def test_batches_fail_or_keep(spark):
    def bad(row):
        if row["id"] == 2:
            raise KeyError("two")
        return [{"id": row["id"]}]

    with pytest.raises(Exception, match="two"):
        X.map_batches(spark.range(4), bad, "id LONG").collect()
    kept = X.map_batches(spark.range(4), bad, "id LONG", key="id", chunk=1, on_error="keep")
    assert rows(kept) == [(0, None), (1, None), (2, "KeyError: 'two'"), (3, None)]
    with pytest.raises(ValueError):
        X.map_batches(spark.range(1), bad, "id LONG", on_error="keep")


@pytest.mark.parametrize("key", ["id", "same", None])
def test_bounded_calls_read_bounded_parts(spark, monkeypatch, key):
    def where(row):
        from pyspark import TaskContext

        task = TaskContext.get()
        return [{"id": row["id"], "task": task.taskAttemptId(), "place": task.partitionId()}]

    df = spark.range(4000).select("id", F.lit(None).cast("long").alias("same"), F.repeat(F.lit("x"), 100).alias("text"))
    df = df.unionByName(df)
    monkeypatch.setattr(X, "TASK_BYTES", 60_000)
    got = X.map_batches(df, where, "id LONG, task LONG, place INT", key=key, concurrency=2).collect()
    assert sorted(r["id"] for r in got) == sorted([*range(4000)] * 2)
    sizes = Counter(r["task"] for r in got)
    # About 1.1 MB: two tasks at a time, none of which reads much more than its bytes.
    assert len(sizes) > 8 and max(sizes.values()) <= 2 * 60_000 / 120
    assert {r["place"] for r in got} <= {0, 1}


@pytest.mark.parametrize("key", ["id", None])
def test_bounded_calls_of_few_large_rows_and_errors(spark, monkeypatch, key):
    monkeypatch.setattr(X, "TASK_BYTES", 100)
    df = spark.range(3).select("id", F.create_map(F.lit("a"), F.repeat(F.lit("y"), 900)).alias("m"), F.lit(1).alias("wave"))

    def call(row):
        if row["id"] == 1:
            raise ValueError("one")
        return [{"id": row["id"], "n": len(row["m"]["a"]) + row["wave"]}]

    kept = X.map_batches(df, call, "id LONG, n LONG", key="id", concurrency=2, chunk=1, on_error="keep")
    assert sorted(tuple(r) for r in kept.collect()) == [(0, 901, None), (1, None, "ValueError: one"), (2, 901, None)]
    with pytest.raises(Exception, match="one"):
        X.map_batches(df, call, "id LONG, n LONG", key=key, concurrency=2).collect()


def test_rerequests_of_a_large_input_read_bounded_parts(spark, monkeypatch):
    def client(prompt, rnd):
        from pyspark import TaskContext

        task = TaskContext.get().taskAttemptId()
        return f'{{"RAW": "{task}", "REVISED": ["{rnd}"]}}' if rnd > 1 or "!" not in prompt else "no"

    text = F.concat(F.repeat(F.lit("x"), 100), F.when(F.col("id") % 2 == 0, "!").otherwise(""))
    df = spark.range(4000).select(F.col("id").alias("request_id"), text.alias("prompt"))
    monkeypatch.setattr(X, "TASK_BYTES", 30_000)
    good, failed = X.rephrase_until_parsed(df, client, max_rounds=3, concurrency=2)
    got = good.collect()
    assert {(r["request_id"], r["revised"][0]) for r in got} == {(i, "2" if i % 2 == 0 else "1") for i in range(4000)}
    assert len(got) == 4000 and failed.count() == 0
    for rnd in (1, 2):  # about 520 and 260 kB
        sizes = Counter(r["raw"] for r in got if r["round"] == rnd)
        assert len(sizes) > 4 and max(sizes.values()) <= 2 * 30_000 / 120


def test_rephrase_skips_rows_without_prompt(spark):
    df = L.render_prompts(
        spark.createDataFrame([("open it",)], "instruction STRING"), {"one": "say: {sentence}"}, identity=True
    ).withColumn("request_id", F.monotonically_increasing_id())
    asked = X.rephrase(df, lambda p: p.upper())
    assert [r["content"] for r in asked.collect()] == ["SAY: OPEN IT"]
    out = X.join_responses(df, asked).orderBy("scope").collect()
    assert [(r["scope"], r["content"], r["new_instruction"]) for r in out] == [
        ("one", "SAY: OPEN IT", None), ("zero", None, "open it"),
    ]


def test_revise_texts(spark):
    df = spark.createDataFrame([("a", "open it"), ("b", "shut it")], "task STRING, instruction STRING")
    assert rows(X.revise_texts(df, None, None)) == [("a", "open it", "open it"), ("b", "shut it", "shut it")]
    got = X.revise_texts(df, lambda p: p.upper(), "now {sentence}!")
    assert rows(got) == [("a", "open it", "NOW OPEN IT!"), ("b", "shut it", "NOW SHUT IT!")]


def test_rerequest_asks_only_for_failures(spark, tmp_path):
    log = str(tmp_path)

    def client(prompt, rnd):
        with open(f"{log}/{prompt}-{rnd}", "x"):
            pass
        n = int(prompt)
        return '{"RAW": "r", "REVISED": ["v"]}' if rnd > n % 4 else "no"

    df = spark.range(8).select(F.col("id").alias("request_id"), F.col("id").cast("string").alias("prompt"))
    good, failed = X.rephrase_until_parsed(df, client, max_rounds=3)
    assert rows(good) == [(i, "r", ["v"], i % 4 + 1) for i in range(8) if i % 4 < 3]
    assert rows(failed) == [(3, "no"), (7, "no")]
    calls = sorted(p.name for p in tmp_path.iterdir())
    assert calls == sorted(f"{i}-{r}" for i in range(8) for r in range(1, min(i % 4 + 1, 3) + 1))


def test_templates():
    from string import Formatter

    for text in L.TEMPLATES.values():
        assert [f for _, f, _, _ in Formatter().parse(text) if f is not None] == ["sentence"]


def test_template_is_str_format(spark):
    t = 'Say {{"x": "{sentence}"}} {{{sentence}}}'
    s = "a {sentence} }} {{ b"
    got = spark.createDataFrame([(s,)], "s STRING").select(L.fill_template(t, "s")).first()[0]
    assert got == t.format(sentence=s)
    with pytest.raises(ValueError):
        L.fill_template("{other}", "s")


def test_lookup_text(spark):
    tasks = spark.createDataFrame([("a", "own a"), ("b", "own b")], "task STRING, language STRING")
    texts = spark.createDataFrame([("a", "new 1", 0), ("a", "new 2", 1), ("c", "x", 0)], "task STRING, new_instruction STRING, ord INT")
    for limit in (0, 10**6):
        assert rows(L.lookup_text(tasks, texts, limit=limit).select("task", "new_instruction")) == [("a", "new 2"), ("b", "own b")]


def test_suffix_fallback(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key STRING")
    stats = spark.createDataFrame([("a",), ("a_no_noops",), ("b_no_noops",), ("b_no_noops",)], "key STRING")
    found, missing = L.lookup_with_suffix(keys, stats)
    assert rows(found) == [("a", "a"), ("b", "b_no_noops")] and rows(missing) == [("c",)]


def test_scope_check(spark):
    df = spark.createDataFrame([("one",), ("five",), (None,)], "scope STRING")
    ok, bad = L.check_scope(df, ("one", "two"))
    assert rows(ok) == [("one",)] and rows(bad) == [("five",), (None,)]


def test_routing_and_defaults(spark):
    df = spark.createDataFrame([("gpt-4o", None), ("claude-3-5-sonnet-20240620", 0.1), ("mine", 0.0), (None, None)], "model_id STRING, temperature DOUBLE")
    got = L.route_models(L.with_defaults(df, max_tokens=7)).collect()
    assert [(r["model_id"], r["temperature"], r["max_tokens"], r["provider"]) for r in got] == [
        ("gpt-4o", 0.7, 7, "openai"), ("claude-3-5-sonnet-20240620", 0.1, 7, "anthropic"),
        ("mine", 0.0, 7, "openai_compatible"), ("gpt-4o", 0.7, 7, "openai"),
    ]
    with pytest.raises(ValueError):
        L.with_defaults(df, api_key="secret")
    think = spark.createDataFrame([("anthropic", "on", 0.2), ("anthropic", None, 0.2), ("openai", "on", 0.2)], "provider STRING, thinking STRING, temperature DOUBLE")
    assert [r["temperature"] for r in L.thinking_temperature(think).collect()] == [1.0, 0.2, 0.2]


def test_calls_see_plain_values(spark):
    big = 9007199254740993
    df = spark.createDataFrame(
        [(big, None, {"a": 1}, [1, None]), (None, 2, None, None)], "id LONG, n LONG, m MAP<STRING, LONG>, a ARRAY<LONG>"
    ).coalesce(1)

    def fn(r):
        assert r["id"] is None or type(r["id"]) is int
        return [{"id": r["id"], "seen": repr((r["n"], r["m"], r["a"]))}]

    want = {(big, "(None, {'a': 1}, [1, None])"), (None, "(2, None, None)")}
    assert {tuple(x) for x in X.map_batches(df, fn, "id LONG, seen STRING").collect()} == want

    def bad(r):
        raise ValueError("no")

    kept = X.map_batches(df, bad, "id LONG", key="id", on_error="keep")
    assert {tuple(x) for x in kept.collect()} == {(big, "ValueError: no"), (None, "ValueError: no")}


def test_rows_without_a_prompt_are_reported(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "request_id STRING, prompt STRING")
    good, failed = X.rephrase_until_parsed(df, lambda text, rnd: '{"RAW": "x", "REVISED": ["y"]}')
    assert [r["request_id"] for r in good.collect()] == ["a"]
    assert [tuple(r) for r in failed.collect()] == [("b", None)]
