from __future__ import annotations

import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from varlake.functions.arrays import gripper_to_env, state_vector
from varlake.operators import metrics as M
from varlake.operators import rollouts as R
from varlake.sources import files as S

RUN = "EVAL-kitchen-net-one-2025_01_02-03_04_05"


def episode(task, text, n, i, won, done, total, extra=""):
    """A log block, written out here so that the parser is tested against plain text."""
    return (
        f"\nTask: {text}\nStarting episode {n}...\n{extra}"
        f"Saved rollout MP4 at path ./rollouts/{RUN}/2025_01_02-03_04_05--episode={i}--success={won}--task={task}.mp4\n"
        f"Success: {won}\n# episodes completed so far: {i}\n# successes: {done} ({total}%)\n"
    )


def rates(task, total):
    return f"Current task success rate: {task}\nCurrent total success rate: {total}\n"


LOG = (
    "Task suite: kitchen\n"
    + episode("open_it", "open it", 1, 1, True, 1, "100.0")
    + episode("open_it", "open it", 2, 2, False, 1, "50.0", "Caught exception: lost\n")
    + episode("open_it", "open it", 3, 3, False, 1, "33.3")
    + rates("0.3333333333333333", "0.3333333333333333")
    + episode("shut_it", "Shut it, please.", 1, 4, True, 2, "50.0")
    + rates("1.0", "0.5")
)


@pytest.fixture(scope="module")
def log_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    (d / f"{RUN}.txt").write_text(LOG)
    return str(d)


def test_rollouts_without_a_result_are_listed(spark, tmp_path):
    cut = "\nTask: shut it\nStarting episode 2...\nCaught exception: stopped\n"
    (tmp_path / f"{RUN}.txt").write_text(LOG + cut)
    blocks = S.read_eval_logs(spark, str(tmp_path))
    got = R.unfinished_rollouts(blocks).collect()
    assert [(r["run_id"], r["episode_in_task"], r["exception"], r["reason"]) for r in got] == [(RUN, 2, "stopped", "no_success_line")]
    assert R.parse_eval_logs(blocks).count() == 4


def test_parse(spark, log_dir):
    got = R.parse_eval_logs(S.read_eval_logs(spark, log_dir)).orderBy("episode_in_run").collect()
    assert [(r["task_name"], r["task_text"], r["episode_in_task"], r["episode_in_run"], r["success"], r["exception"]) for r in got] == [
        ("open_it", "open it", 1, 1, True, None),
        ("open_it", "open it", 2, 2, False, "lost"),
        ("open_it", "open it", 3, 3, False, None),
        ("shut_it", "Shut it, please.", 1, 4, True, None),
    ]
    assert {(r["run_id"], r["suite"], r["model_family"], r["scope"], r["started_at"]) for r in got} == {
        (RUN, "kitchen", "net", "one", "2025_01_02-03_04_05")
    }


def test_parse_across_splits(spark, log_dir):
    want = rows(R.parse_eval_logs(S.read_eval_logs(spark, log_dir)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        blocks = S.read_eval_logs(spark, log_dir)
        assert blocks.rdd.getNumPartitions() > 3
        assert rows(R.parse_eval_logs(blocks)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_context(spark, log_dir):
    lines = R.log_lines(S.read_eval_logs(spark, log_dir)).where("line LIKE 'Success%'")
    got = sorted((r["task_text"], r["episode_in_task"], r["line"]) for r in lines.collect())
    assert got == [
        ("Shut it, please.", 1, "Success: True"), ("open it", 1, "Success: True"),
        ("open it", 2, "Success: False"), ("open it", 3, "Success: False"),
    ]


def test_report_gives_the_log_back(spark, log_dir, tmp_path):
    episodes = R.parse_eval_logs(S.read_eval_logs(spark, log_dir))
    blocks = R.report_blocks(R.running_success(episodes, hot_rows=1, span=2))
    S.write_report(blocks, str(tmp_path / "out"), episodes_per_file=3)
    parts = sorted((tmp_path / "out" / f"run_id={RUN}").glob("part=*/part*"))
    assert len(parts) == 2
    assert "".join(p.read_text() for p in parts) == LOG.replace("Caught exception: lost\n", "")
    again = R.parse_eval_logs(S.read_eval_logs(spark, str(tmp_path / "out")))
    assert rows(again.drop("exception")) == rows(episodes.drop("exception"))


def test_no_logs(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert R.parse_eval_logs(S.read_eval_logs(spark, str(tmp_path / "none"))).count() == 0


def test_rates(spark, log_dir):
    episodes = R.parse_eval_logs(S.read_eval_logs(spark, log_dir))
    out = R.success_rates(episodes)
    assert {(r["run_id"], r["task_name"], r["num_episodes"], r["num_successes"], r["success_rate"], r["level"]) for r in out.collect()} == {
        (RUN, "open_it", 3, 1, 1 / 3, 0), (RUN, "shut_it", 1, 1, 1.0, 0), (RUN, None, 4, 2, 0.5, 1), (None, None, 4, 2, 0.5, 3),
    }
    metrics = {r["metric"]: r["value"] for r in R.metric_rows(out).collect()}
    assert metrics == {
        "success_rate/open_it": 1 / 3, "num_episodes/open_it": 3.0, "success_rate/shut_it": 1.0,
        "num_episodes/shut_it": 1.0, "success_rate/total": 0.5, "num_episodes/total": 4.0,
    }
    cube = {(r["suite"], r["scope"]): r["num_successes"] for r in R.compare_scopes(episodes).collect()}
    assert cube == {("kitchen", "one"): 2, ("kitchen", None): 2, (None, "one"): 2, (None, None): 2}


def test_rates_count_before_they_expand(spark, log_dir):
    text = plan(R.success_rates(R.parse_eval_logs(S.read_eval_logs(spark, log_dir))))
    assert text.index("Expand") < text.index("partial_count")  # printed top down: Expand sits above the counts


def test_outcome_needs_done_inside_the_budget(spark):
    data = [("a", t, t in (3, 12)) for t in range(20)] + [("b", t, t == 9) for t in range(20)] + [("c", t, t == 15) for t in range(20)]
    df = spark.createDataFrame(data, "e STRING, t INT, done BOOLEAN")
    got = R.rollout_outcome(df, ["e"], F.lit(5), wait=10)
    assert rows(got) == [("a", 12, 20, True), ("b", None, 20, False), ("c", None, 20, False)]


def test_budgets(spark):
    df = spark.createDataFrame([("libero_10",), ("libero_goal",), ("else",)], "s STRING")
    assert [r[0] for r in df.select(R.step_budget("s")).collect()] == [520, 300, None]


def test_first_trials_limit_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("task"), F.col("id").alias("e"))
    out = R.first_trials(df, 2, ["task"], "e")
    assert rows(out) == [(0, 0, 1), (0, 3, 2), (1, 1, 1), (1, 4, 2), (2, 2, 1), (2, 5, 2)]
    many = R.first_trials(df, 1001, ["task"], "e")
    assert many.count() == 100 and many.dtypes == out.dtypes
    # Once before the exchange, once after it.
    assert plan(R.first_trials(df, 2, ["task"], "e")).count("WindowGroupLimit") == 2


def test_smoothing_and_checkpoints(spark):
    df = spark.range(30).select(
        F.lit("r").alias("run_id"), F.col("id").alias("batch_idx"), F.col("id").cast("double").alias("loss"),
        F.lit(1.0).alias("action_accuracy"), F.lit(0.5).alias("l1_loss"),
    )
    got = M.smooth_metrics(df, 2, every=5).orderBy("batch_idx").collect()
    assert [(r["batch_idx"], r["grad_step"], r["smooth_loss"]) for r in got] == [
        (0, 0, 0.0), (1, 0, 0.5), (10, 5, 9.5), (11, 5, 10.5), (20, 10, 19.5), (21, 10, 20.5),
    ]
    saved = M.checkpoint_rows(df, 2, 5).orderBy("batch_idx").collect()
    assert [(r["batch_idx"], r["grad_step"]) for r in saved] == [(10, 5), (20, 10)]


def test_masked_metrics(spark):
    df = spark.createDataFrame(
        [("a", 5, 9, 1.0, 2.0), ("a", 9, 9, 1.0, 1.5), ("a", 1, 1, 0.0, 9.0), ("b", 1, 1, 0.0, 1.0)],
        "k STRING, pred INT, label INT, pv DOUBLE, lv DOUBLE",
    )
    assert rows(M.masked_accuracy(df, 4, ["k"])) == [("a", 2, 0.5), ("b", 0, None)]
    assert rows(M.masked_l1(df, 4, ["k"], "pv", "lv")) == [("a", 0.75), ("b", None)]


@pytest.mark.parametrize("accuracy", [10, 50, 10_000])
def test_quantiles_are_exact_however_coarse_the_sketch(spark, accuracy):
    """Ties, a value that half of the rows share, skew, nulls, and groups of one and of none."""
    rng = random.Random(accuracy)
    data = [("a", [rng.gauss(0, 1), float(rng.randrange(4)), 7.0 if i % 2 else float(i), 10.0 ** rng.randrange(-300, 300)]) for i in range(3001)]
    data += [("b", [1.0, None]), (None, [float("-inf"), 2.0]), ("c", [None]), ("d", None)]
    got = M.action_stats(spark.createDataFrame(data, "dataset STRING, action ARRAY<DOUBLE>").repartition(4), accuracy=accuracy)
    seen = {(r["dataset"], r["dim"]): (r["n"], r["q01"], r["q99"]) for r in got.collect()}
    want = {}
    for name, vector in data:
        for dim, x in enumerate(vector or []):
            want.setdefault((name, dim), []).extend([] if x is None else [x])
    for key, xs in want.items():
        xs.sort()
        n = len(xs)
        want[key] = (n, xs[-(-n // 100) - 1], xs[-(-99 * n // 100) - 1]) if n else (0, None, None)
    assert seen == want


def test_action_stats(spark):
    df = spark.createDataFrame([("d", [float(i), -1.0]) for i in range(101)], "dataset STRING, action ARRAY<FLOAT>")
    got = {r["dim"]: r for r in M.action_stats(df, "dataset").collect()}
    assert (got[0]["n"], got[0]["mean"], got[0]["min"], got[0]["max"], got[0]["q01"], got[0]["q99"]) == (101, 50.0, 0.0, 100.0, 1.0, 99.0)
    assert got[1]["std"] == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([([0.3, 0.9],), ([0.3, 0.1],), ([0.3, 0.5],), ([],)], "a ARRAY<DOUBLE>")
    assert [r[0] for r in df.select(gripper_to_env("a")).collect()] == [[0.3, -1.0], [0.3, 1.0], [0.3, 0.0], None]
    assert df.select(state_vector("a", "a")).first()[0] == [0.3, 0.9, 0.3, 0.9]
