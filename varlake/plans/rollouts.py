"""Rollout, metric and streaming queries over ``events``.

A day is a run, a user a task, an event an episode, a purchase a success.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.fixed_values import STEP_BUDGETS
from varlake.functions.arrays import gripper_to_env, state_vector
from varlake.operators import metrics as M
from varlake.operators import rollouts as R
from varlake.operators.segments import number_within
from varlake.plans.registry import query, table
from varlake.session import scratch_path
from varlake.sources.files import read_eval_logs, write_report


def rollout_events(spark, sf_dir) -> DataFrame:
    at = F.date_format("ts", "yyyy_MM_dd")
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("EVAL-shop-web-one-"), at, F.lit("-00_00_00")).alias("run_id"),
        F.lit("shop").alias("suite"),
        F.concat(at, F.lit("-00_00_00")).alias("started_at"),
        F.concat(F.lit("user_"), user).alias("task_name"),
        F.concat(F.lit("Serve user "), user, F.lit(".")).alias("task_text"),
        "event_id",
        (F.col("event_type") == "purchase").alias("success"),
    )


EPISODES_SQL = """
ep AS (
  SELECT 'EVAL-shop-web-one-' || strftime(ts, '%Y_%m_%d') || '-00_00_00' AS run_id,
         strftime(ts, '%Y_%m_%d') || '-00_00_00' AS started_at, 'user_' || user_id AS task_name,
         'Serve user ' || user_id || '.' AS task_text, event_id, event_type = 'purchase' AS success FROM events)"""
PROGRESS_SQL = EPISODES_SQL + """,
pr AS (
  SELECT *, row_number() OVER r AS episodes_so_far, (sum(success::INT) OVER r)::BIGINT AS successes_so_far,
         row_number() OVER t AS task_episode, (sum(success::INT) OVER t)::BIGINT AS task_successes,
         count(*) OVER (PARTITION BY run_id, task_name) AS task_episodes
  FROM ep
  WINDOW r AS (PARTITION BY run_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
         t AS (PARTITION BY run_id, task_name ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""
RATES_SQL = EPISODES_SQL + """,
rates AS (
  SELECT run_id, task_name, count(*) AS num_episodes, sum(success::INT)::BIGINT AS num_successes,
         sum(success::INT)::DOUBLE / count(*) AS success_rate, grouping(run_id, task_name)::INT AS level
  FROM ep GROUP BY ROLLUP (run_id, task_name))"""


@query(
    "WITH" + PROGRESS_SQL + """
SELECT run_id, event_id, episodes_so_far, successes_so_far, task_episode, task_successes, task_episodes,
       printf('%.1f', successes_so_far::DOUBLE / episodes_so_far * 100) AS percent FROM pr"""
)
def running_success(spark, sf_dir):
    return R.running_success(rollout_events(spark, sf_dir), order="event_id").select(
        "run_id", "event_id", "episodes_so_far", "successes_so_far", "task_episode", "task_successes",
        "task_episodes", "percent",
    )


@query(
    "WITH" + EPISODES_SQL + """ SELECT run_id, task_name, count(*) AS num_episodes,
  sum(success::INT)::BIGINT AS num_successes, avg(success::INT) AS success_rate FROM ep GROUP BY run_id, task_name"""
)
def task_success_rate(spark, sf_dir):
    rates = R.success_rates(rollout_events(spark, sf_dir)).where("level = 0")
    return rates.select("run_id", "task_name", "num_episodes", "num_successes", "success_rate")


@query("WITH" + RATES_SQL + " SELECT * FROM rates")
def run_success_rollup(spark, sf_dir):
    return R.success_rates(rollout_events(spark, sf_dir))


@query(
    "WITH" + RATES_SQL + """, named AS (
  SELECT run_id, coalesce(task_name, 'total') AS name, success_rate, num_episodes FROM rates WHERE level < 3)
SELECT run_id, 'success_rate/' || name AS metric, success_rate AS value FROM named
UNION ALL SELECT run_id, 'num_episodes/' || name, num_episodes::DOUBLE FROM named"""
)
def metric_rows(spark, sf_dir):
    return R.metric_rows(R.success_rates(rollout_events(spark, sf_dir)))


@query(
    """SELECT lang AS suite, source AS scope, count(*) AS num_episodes, sum(quality)::BIGINT AS num_successes,
  sum(quality)::DOUBLE / count(*) AS success_rate, grouping(lang, source)::INT AS level
FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, source)"""
)
def scope_suite_cube(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("suite"), F.col("source").alias("scope"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("success"))
    return R.compare_scopes(docs.join(labels, "doc_id"))


_SUITES = list(STEP_BUDGETS)
_SUITE_SQL = "[" + ", ".join(f"'{s}'" for s in _SUITES) + "][(user_id % 5)::INT + 1]"
_BUDGET_SQL = "CASE suite " + " ".join(f"WHEN '{s}' THEN {b}" for s, b in STEP_BUDGETS.items()) + " END"


@query(
    f"""WITH s AS (
  SELECT user_id, {_SUITE_SQL} AS suite, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t,
         event_type = 'purchase' AS done FROM events),
b AS (SELECT *, {_BUDGET_SQL} AS budget FROM s),
o AS (SELECT user_id, suite, min(t) FILTER (WHERE done AND t >= 10 AND t < budget + 10) AS done_at, count(*) AS n_steps
      FROM b GROUP BY user_id, suite)
SELECT *, done_at IS NOT NULL AS success FROM o"""
)
def rollout_outcome(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("done"))
    suite = F.element_at(F.array(*[F.lit(s) for s in _SUITES]), (F.col("user_id") % 5 + 1).cast("int"))
    steps = number_within(events, ["user_id"], ["event_id"], "n").withColumns(
        {"t": F.col("n") - 1, "suite": suite}
    )
    return R.rollout_outcome(steps, ["user_id", "suite"], R.step_budget("suite"))


@query(
    """SELECT user_id, event_id, trial FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS trial FROM events)
WHERE trial <= 3"""
)
def first_trials(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return R.first_trials(events, 3, ["user_id"], "event_id")


# --- logs and reports --------------------------------------------------------------------


def _blocks(spark, sf_dir, rollouts: DataFrame | None = None) -> DataFrame:
    progress = R.running_success(rollout_events(spark, sf_dir) if rollouts is None else rollouts, order="event_id")
    return R.report_blocks(progress.withColumn("episode_in_run", F.col("episodes_so_far")))


@query(
    "WITH" + PROGRESS_SQL + """
SELECT run_id, episodes_so_far AS episode_in_run, 'shop' AS suite,
  'Task: ' || task_text || chr(10) || 'Starting episode ' || task_episode || '...' || chr(10)
  || 'Saved rollout MP4 at path ./rollouts/' || run_id || '/' || started_at || '--episode=' || episodes_so_far
  || '--success=' || CASE WHEN success THEN 'True' ELSE 'False' END || '--task=' || task_name || '.mp4' || chr(10)
  || 'Success: ' || CASE WHEN success THEN 'True' ELSE 'False' END || chr(10)
  || '# episodes completed so far: ' || episodes_so_far || chr(10)
  || '# successes: ' || successes_so_far || ' (' || printf('%.1f', successes_so_far::DOUBLE / episodes_so_far * 100) || '%)'
  || CASE WHEN task_episode = task_episodes THEN chr(10) || 'Current task success rate: '
       || (task_successes::DOUBLE / task_episode) || chr(10) || 'Current total success rate: '
       || (successes_so_far::DOUBLE / episodes_so_far) ELSE '' END AS block
FROM pr"""
)
def report_lines(spark, sf_dir):
    return _blocks(spark, sf_dir).withColumn("episode_in_run", F.col("episode_in_run").cast("bigint"))


_LOG_SQL = "WITH" + PROGRESS_SQL


@query(
    _LOG_SQL + """
SELECT run_id, 'shop' AS suite, 'web' AS model_family, 'one' AS scope, started_at, task_name, task_text,
       task_episode::INT AS episode_in_task, episodes_so_far::INT AS episode_in_run, success FROM pr"""
)
def log_parse(spark, sf_dir):
    """Logs of every run are written, read back in splits, and parsed."""
    path = scratch_path(spark, "logs")
    write_report(_blocks(spark, sf_dir), path)
    return R.parse_eval_logs(read_eval_logs(spark, path)).drop("exception")


@query(
    """WITH e AS (
  SELECT ['one', 'two', 'all'][(user_id % 3 + 1)::INT] AS scope, 'shop' AS suite, event_type = 'purchase' AS success FROM events)
SELECT suite, scope, count(*) AS num_episodes, sum(success::INT)::BIGINT AS num_successes,
  sum(success::INT)::DOUBLE / count(*) AS success_rate, grouping(suite, scope)::INT AS level FROM e GROUP BY CUBE (suite, scope)"""
)
def log_to_cube(spark, sf_dir):
    """Logs of runs of three scopes, written, parsed, and compared by scope and suite."""
    scope = F.element_at(F.array(F.lit("one"), F.lit("two"), F.lit("all")), (F.substring_index("task_name", "_", -1).cast("int") % 3 + 1))
    run = F.replace(F.col("run_id"), F.lit("-one-"), F.concat(F.lit("-"), scope, F.lit("-")))
    path = scratch_path(spark, "logs")
    write_report(_blocks(spark, sf_dir, rollout_events(spark, sf_dir).withColumn("run_id", run)), path)
    return R.compare_scopes(R.parse_eval_logs(read_eval_logs(spark, path)))


@query(
    _LOG_SQL + """, lines AS (
  SELECT run_id, task_text, task_episode::INT AS episode_in_task,
    unnest(['Success: ' || CASE WHEN success THEN 'True' ELSE 'False' END,
            '# episodes completed so far: ' || episodes_so_far]) AS line FROM pr)
SELECT * FROM lines"""
)
def log_line_context(spark, sf_dir):
    """Two kinds of log lines, each with the task and episode it belongs to."""
    path = scratch_path(spark, "logs")
    write_report(_blocks(spark, sf_dir), path)
    lines = R.log_lines(read_eval_logs(spark, path))
    wanted = F.col("line").startswith("Success: ") | F.col("line").startswith("# episodes")
    return lines.where(wanted).select("run_id", "task_text", "episode_in_task", "line")


# --- training metrics ------------------------------------------------------------------------


def _batches(spark, sf_dir) -> DataFrame:
    k = F.from_json("props", "k INT")["k"]
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        "event_id",
        F.col("value").alias("loss"),
        (k / 100).alias("action_accuracy"),
        (F.col("value") / 10).alias("l1_loss"),
    )
    numbered = number_within(events, ["run_id"], ["event_id"], "n")
    return numbered.withColumn("batch_idx", F.col("n") - 1).drop("n")


_BATCH_SQL = """
b AS (
  SELECT event_type AS run_id, event_id, value AS loss, regexp_extract(props, '[0-9]+')::INT / 100 AS action_accuracy,
         value / 10 AS l1_loss, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS batch_idx FROM events)"""


@query(
    "WITH" + _BATCH_SQL + """, m AS (
  SELECT run_id, batch_idx, batch_idx // 4 AS grad_step, avg(loss) OVER w AS a, avg(action_accuracy) OVER w AS b,
         avg(l1_loss) OVER w AS c
  FROM b WINDOW w AS (PARTITION BY run_id ORDER BY batch_idx ROWS 3 PRECEDING))
SELECT run_id, batch_idx, grad_step, round(a, 6) AS smooth_loss, round(b, 6) AS smooth_action_accuracy,
       round(c, 6) AS smooth_l1_loss FROM m WHERE grad_step % 10 = 0"""
)
def moving_loss(spark, sf_dir):
    out = M.smooth_metrics(_batches(spark, sf_dir), 4)
    names = ("smooth_loss", "smooth_action_accuracy", "smooth_l1_loss")
    return out.select("run_id", "batch_idx", "grad_step", *[F.round(n, 6).alias(n) for n in names])


@query(
    "WITH" + _BATCH_SQL + """
SELECT run_id, batch_idx, batch_idx // 4 AS grad_step, loss FROM b
WHERE batch_idx // 4 > 0 AND (batch_idx // 4) % 25 = 0 AND batch_idx % 4 = 0"""
)
def checkpoint_rows(spark, sf_dir):
    out = M.checkpoint_rows(_batches(spark, sf_dir), 4, 25)
    return out.select("run_id", "batch_idx", "grad_step", "loss")


def _predictions(spark, sf_dir) -> DataFrame:
    label = F.from_json("props", "k INT")["k"]
    return table(spark, sf_dir, "events").select(
        "event_type", label.alias("label"), F.floor("value").cast("int").alias("pred"), "value"
    )


_PRED_SQL = """WITH p AS (SELECT event_type, regexp_extract(props, '[0-9]+')::INT AS label, floor(value)::INT AS pred,
  value FROM events) """


@query(
    _PRED_SQL + """SELECT event_type, count(*) FILTER (WHERE label > 50) AS n_masked,
  count(*) FILTER (WHERE label > 50 AND pred = label)::DOUBLE / count(*) FILTER (WHERE label > 50) AS accuracy
FROM p GROUP BY event_type"""
)
def masked_accuracy(spark, sf_dir):
    return M.masked_accuracy(_predictions(spark, sf_dir), 50, ["event_type"])


@query(
    _PRED_SQL + """SELECT event_type, round(avg(abs(value - label)) FILTER (WHERE label > 50), 6) AS l1_loss
FROM p GROUP BY event_type"""
)
def masked_l1(spark, sf_dir):
    out = M.masked_l1(_predictions(spark, sf_dir), 50, ["event_type"], "value", "label")
    return out.select("event_type", F.round("l1_loss", 6).alias("l1_loss"))


@query(
    """WITH v AS (SELECT label, generate_subscripts(embedding, 1)::INT - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max,
  quantile_disc(x, 0.01) AS q01, quantile_disc(x, 0.99) AS q99 FROM v GROUP BY label, dim"""
)
def action_stats(spark, sf_dir):
    out = M.action_stats(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    """WITH v AS (SELECT l_linestatus, generate_subscripts(a, 1)::INT - 1 AS dim, unnest(a) AS x
  FROM (SELECT l_linestatus, [l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE] AS a FROM lineitem))
SELECT l_linestatus, dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max,
  quantile_disc(x, 0.01) AS q01, quantile_disc(x, 0.99) AS q99 FROM v GROUP BY l_linestatus, dim"""
)
def action_stats_large(spark, sf_dir):
    """Groups far beyond what a sketch holds exactly; few and many different values."""
    d = lambda c: F.col(c).cast("double")
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", F.array(d("l_quantity"), d("l_extendedprice"), d("l_discount"), d("l_tax")).alias("a"))
    out = M.action_stats(lines, "l_linestatus", "a")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    """WITH a AS (SELECT vec_id, embedding[1:7] AS a FROM embeddings),
v AS (SELECT vec_id, generate_subscripts(a, 1)::INT - 1 AS pos, unnest(a)::DOUBLE AS x FROM a)
SELECT vec_id, pos, CASE WHEN pos < 6 THEN x WHEN 2 * x - 1 > 0 THEN -1.0 WHEN 2 * x - 1 < 0 THEN 1.0 ELSE 0.0 END AS x FROM v"""
)
def gripper_transform(spark, sf_dir):
    action = gripper_to_env(F.slice("embedding", 1, 7))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(action).alias("pos", "x"))


@query(
    """WITH a AS (SELECT vec_id, list_concat(list_concat(embedding[1:3], embedding[10:12]), embedding[63:64]) AS a FROM embeddings)
SELECT vec_id, generate_subscripts(a, 1)::INT - 1 AS pos, unnest(a)::DOUBLE AS x FROM a"""
)
def state_concat(spark, sf_dir):
    e = F.col("embedding")
    state = state_vector(F.slice(e, 1, 3), F.slice(e, 10, 3), F.slice(e, 63, 2))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(F.transform(state, lambda x: x.cast("double"))).alias("pos", "x")
    )
