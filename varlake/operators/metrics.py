"""Training metrics and action statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varlake.operators.segments import SPAN, moving_mean
from varlake.session import broadcast_checked, cut_lineage


def masked_accuracy(
    df: DataFrame, threshold, keys=("run_id", "batch_idx"), pred: str = "pred", label: str = "label"
) -> DataFrame:
    """Share of right predictions among labels above ``threshold``; null where none is."""
    mask = F.col(label) > threshold
    hit = mask & (F.col(pred) == F.col(label))
    return df.groupBy(*keys).agg(
        F.count_if(mask).alias("n_masked"),
        F.try_divide(F.count_if(hit).cast("double"), F.count_if(mask)).alias("accuracy"),
    )


def masked_l1(
    df: DataFrame,
    threshold,
    keys=("run_id", "batch_idx"),
    pred_value: str = "pred_value",
    label_value: str = "label_value",
    label: str = "label",
) -> DataFrame:
    """Mean absolute difference of the values whose label is above ``threshold``."""
    gap = F.abs(F.col(pred_value) - F.col(label_value))
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(label) > threshold, gap)).alias("l1_loss"))


def action_stats(df: DataFrame, dataset: str = "dataset", vector: str = "action", accuracy: int = 10_000) -> DataFrame:
    """Per dataset and dimension: count, mean, std, min, max, and exact q01 and q99.

    A quantile is the smallest value that at least that share of the values don't exceed. The
    first pass brackets it between two quantiles of a mergeable sketch, whose error is known; the
    second counts the values below the bracket and each value within it, combined map-side. So
    only about 4 / accuracy of a dimension's values are ever sorted together, and a value that
    many rows share is one row.
    """
    values = df.select(dataset, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    slack = 2 / accuracy
    shares = [max(0.0, 0.01 - slack), min(1.0, 0.01 + slack), max(0.0, 0.99 - slack), min(1.0, 0.99 + slack)]
    stats = values.groupBy(dataset, "dim").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.percentile_approx("x", shares, accuracy).alias("near"),
    )
    stats = cut_lineage(stats)
    near = lambda i: F.struct(F.lit(i).alias("which"), F.col("near")[2 * i].alias("lo"), F.col("near")[2 * i + 1].alias("hi"))
    brackets = stats.select(F.col(dataset).alias("__d"), F.col("dim").alias("__m"), "n", F.array(near(0), near(1)).alias("near"))
    met = values.join(broadcast_checked(brackets), F.col(dataset).eqNullSafe(F.col("__d")) & (F.col("dim") == F.col("__m")))
    each = met.where("x IS NOT NULL").select("__d", "__m", "n", "x", F.explode("near").alias("b")).where(F.col("x") <= F.col("b.hi"))
    inside = F.when(F.col("x") >= F.col("b.lo"), F.col("x"))  # null: below the bracket
    counts = each.groupBy("__d", "__m", "n", F.col("b.which").alias("which"), inside.alias("x")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy("__d", "__m", "which").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.expr("(n * IF(which = 0, 1, 99) + 99) DIV 100")
    found = counts.withColumn("upto", F.sum("c").over(upto)).where((F.col("upto") >= rank) & F.col("x").isNotNull())
    quantile = lambda i: F.min(F.when(F.col("which") == i, F.col("x")))
    exact = found.groupBy("__d", "__m").agg(quantile(0).alias("q01"), quantile(1).alias("q99"))
    same = F.col(dataset).eqNullSafe(F.col("__d")) & (F.col("dim") == F.col("__m"))
    return stats.drop("near").join(exact, same, "left").drop("__d", "__m")


def gradient_step(batch_idx: str, k: int):
    return F.floor(F.col(batch_idx) / k).cast("bigint")


def smooth_metrics(
    df: DataFrame,
    k: int,
    every: int = 10,
    run: str = "run_id",
    batch_idx: str = "batch_idx",
    columns: tuple[str, ...] = ("loss", "action_accuracy", "l1_loss"),
    span: int = SPAN,
) -> DataFrame:
    """Means over the last ``k`` batches, for the batches of every ``every``-th gradient step."""
    smooth = moving_mean(df, [run], batch_idx, {f"smooth_{c}": c for c in columns}, k, span)
    stepped = smooth.withColumn("grad_step", gradient_step(batch_idx, k))
    return stepped.where(F.pmod("grad_step", F.lit(every)) == 0)


def checkpoint_rows(df: DataFrame, k: int, save_steps: int, batch_idx: str = "batch_idx") -> DataFrame:
    """The first batch of every gradient step at which a checkpoint is due."""
    stepped = df.withColumn("grad_step", gradient_step(batch_idx, k))
    due = (F.col("grad_step") > 0) & (F.pmod("grad_step", F.lit(save_steps)) == 0)
    return stepped.where(due & (F.col(batch_idx) == F.col("grad_step") * k))
