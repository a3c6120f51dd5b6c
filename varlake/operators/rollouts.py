"""Rollout results: logs, running counts, rates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlake.fixed_values import SETTLING_STEPS, STEP_BUDGETS
from varlake.functions.text import (
    bool_text,
    float_text,
    parse_rollout_path,
    percent_text,
    rollout_path,
)
from varlake.operators.segments import running

# --- logs -------------------------------------------------------------------------


def _logged_rollouts(blocks: DataFrame) -> DataFrame:
    """One row per rollout begun; ``success`` is null where no line tells it."""
    text = F.col("block")
    saved = parse_rollout_path(F.regexp_extract(text, r"Saved rollout MP4 at path (.*)", 1))
    failed = r"(?m)^Caught exception: (.*)$"
    picked = blocks.where(text.rlike(r"(?m)^Starting episode \d+\.\.\.$")).select(
        "run_id",
        "suite",
        "model_family",
        "scope",
        "started_at",
        saved.alias("s"),
        F.regexp_extract(text, r"(?s)^(.*?)\nStarting episode \d+\.\.\.", 1).alias("task_text"),
        F.regexp_extract(text, r"(?m)^Starting episode (\d+)\.\.\.$", 1).cast("int").alias("episode_in_task"),
        F.regexp_extract(text, r"(?m)^# episodes completed so far: (\d+)$", 1).alias("done"),
        F.regexp_extract(text, r"(?m)^Success: (True|False)$", 1).alias("flag"),
        F.when(text.rlike(failed), F.regexp_extract(text, failed, 1)).alias("exception"),
    )
    return picked.select(
        "run_id",
        "suite",
        "model_family",
        "scope",
        "started_at",
        F.col("s.slug").alias("task_name"),
        "task_text",
        "episode_in_task",
        F.coalesce(F.col("s.episode"), F.expr("try_cast(done AS INT)")).alias("episode_in_run"),
        F.when(F.col("flag") != "", F.col("flag") == "True").alias("success"),
        "exception",
    )


def parse_eval_logs(blocks: DataFrame) -> DataFrame:
    """One row per finished rollout from log blocks (see ``sources.read_eval_logs``).

    A block holds everything about one rollout, so its context needs no window. Rollouts
    without a result are those of :func:`unfinished_rollouts`.
    """
    return _logged_rollouts(blocks).where("success IS NOT NULL")


def unfinished_rollouts(blocks: DataFrame) -> DataFrame:
    """Rollouts that began but have no ``Success:`` line, as of an interrupted run, with the reason."""
    open_ones = _logged_rollouts(blocks).where("success IS NULL").drop("success")
    return open_ones.withColumn("reason", F.lit("no_success_line"))


def log_lines(blocks: DataFrame) -> DataFrame:
    """Every line with the task and episode it belongs to."""
    context = blocks.select(
        "run_id",
        "block_start",
        "block_no",
        F.regexp_extract("block", r"(?s)^(.*?)\nStarting episode \d+\.\.\.", 1).alias("task_text"),
        F.regexp_extract("block", r"(?m)^Starting episode (\d+)\.\.\.$", 1).cast("int").alias("episode_in_task"),
        F.posexplode(F.split("block", "\n")).alias("line_in_block", "line"),
    )
    return context.where("line <> ''")


# --- rates ------------------------------------------------------------------------


def running_success(
    episodes: DataFrame, run: str = "run_id", task: str = "task_name", order: str = "episode_in_run", **cut
) -> DataFrame:
    """Counts as they stood after each episode, for the run and for its task."""
    won = F.col("success").cast("int")
    in_run = running(
        episodes, [run], [order], position="episodes_so_far", sums={"successes_so_far": won}, **cut
    )
    in_task = running(
        in_run,
        [run, task],
        [order],
        position="task_episode",
        sums={"task_successes": won},
        group_sums={"task_episodes": F.lit(1)},
        **cut,
    )
    return in_task.withColumn(
        "percent", percent_text(F.col("successes_so_far") / F.col("episodes_so_far"))
    )


def success_rates(episodes: DataFrame, run: str = "run_id", task: str = "task_name") -> DataFrame:
    """Rate and counts per task, per run (task null) and over all (both null).

    Rows are counted per task first; the rollup works on those counts.
    """
    per_task = episodes.groupBy(run, task).agg(
        F.count("*").alias("n"), F.sum(F.col("success").cast("bigint")).alias("k")
    )
    return per_task.rollup(run, task).agg(
        F.sum("n").alias("num_episodes"),
        F.sum("k").alias("num_successes"),
        (F.sum("k") / F.sum("n")).alias("success_rate"),
        F.grouping_id().cast("int").alias("level"),
    )


def metric_rows(rates: DataFrame, run: str = "run_id", task: str = "task_name") -> DataFrame:
    """(run, metric, value) rows: success rate and episode count of every task and of the run."""
    name = F.when(F.col("level") == 1, F.lit("total")).otherwise(F.col(task))
    pair = F.array(
        F.struct(F.concat(F.lit("success_rate/"), name).alias("metric"), F.col("success_rate").alias("value")),
        F.struct(
            F.concat(F.lit("num_episodes/"), name).alias("metric"),
            F.col("num_episodes").cast("double").alias("value"),
        ),
    )
    return rates.where("level < 3").select(run, F.inline(pair))


def compare_scopes(episodes: DataFrame, suite: str = "suite", scope: str = "scope") -> DataFrame:
    """Success by suite and scope with all subtotals, from counts made in one pass."""
    cells = episodes.groupBy(suite, scope).agg(
        F.count("*").alias("n"), F.sum(F.col("success").cast("bigint")).alias("k")
    )
    return cells.cube(suite, scope).agg(
        F.sum("n").alias("num_episodes"),
        F.sum("k").alias("num_successes"),
        (F.sum("k") / F.sum("n")).alias("success_rate"),
        F.grouping_id().cast("int").alias("level"),
    )


# --- single rollouts ----------------------------------------------------------------


def step_budget(suite, budgets: dict[str, int] | None = None) -> Column:
    """Longest rollout of a suite; null when unknown."""
    budgets = STEP_BUDGETS if budgets is None else budgets
    c = F.col(suite) if isinstance(suite, str) else suite
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), c)


def rollout_outcome(
    steps: DataFrame, keys: list[str], budget, t: str = "t", done: str = "done", wait: int = SETTLING_STEPS
) -> DataFrame:
    """First time a rollout was done within its budget, and whether it was.

    The settling steps never count as success.
    """
    b = F.col(budget) if isinstance(budget, str) else budget
    counts = F.col(done) & (F.col(t) >= wait) & (F.col(t) < b + wait)
    return (
        steps.groupBy(*keys)
        .agg(F.min(F.when(counts, F.col(t))).alias("done_at"), F.count("*").alias("n_steps"))
        .withColumn("success", F.col("done_at").isNotNull())
    )


# Spark keeps this many rows per group before a shuffle when it ranks (its own default).
_GROUP_LIMIT = 1000


def first_trials(df: DataFrame, n: int, keys: list[str], order: str) -> DataFrame:
    """The first ``n`` trials of each task.

    Up to a thousand, each task of the job passes on at most ``n`` rows per group. More
    are numbered in segments, so that a hot group is not one task.
    """
    if n <= _GROUP_LIMIT:
        w = Window.partitionBy(*keys).orderBy(order)
        ranked = df.withColumn("trial", F.row_number().over(w))
    else:
        ranked = running(df, keys, [order], position="trial").withColumn("trial", F.col("trial").cast("int"))
    return ranked.where(F.col("trial") <= n)


# --- report ---------------------------------------------------------------------------


def report_blocks(progress: DataFrame) -> DataFrame:
    """Log text of each rollout, from the result of :func:`running_success`.

    The rates of a task follow its last rollout.
    """
    line = lambda label, value: F.concat(F.lit(label), value)
    path = rollout_path("run_id", "started_at", "episode_in_run", "success", "task_name")
    rates = F.when(
        F.col("task_episode") == F.col("task_episodes"),
        F.concat_ws(
            "\n",
            line("Current task success rate: ", float_text(F.col("task_successes") / F.col("task_episode"))),
            line("Current total success rate: ", float_text(F.col("successes_so_far") / F.col("episodes_so_far"))),
        ),
    )
    block = F.concat_ws(
        "\n",
        line("Task: ", F.col("task_text")),
        F.concat(F.lit("Starting episode "), F.col("task_episode").cast("string"), F.lit("...")),
        line("Saved rollout MP4 at path ", path),
        line("Success: ", bool_text("success")),
        line("# episodes completed so far: ", F.col("episodes_so_far").cast("string")),
        F.concat(
            F.lit("# successes: "),
            F.col("successes_so_far").cast("string"),
            F.lit(" ("),
            F.col("percent"),
            F.lit("%)"),
        ),
        rates,
    )
    return progress.select("run_id", "suite", "episode_in_run", block.alias("block"))
