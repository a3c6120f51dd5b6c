"""Running totals and positions that survive a hot group.

A window over a whole group puts the group into one task. That is fine for a group of
ordinary size, so those are windowed as they are. A *hot* group, one of more than
``HOT_ROWS`` rows, is cut into segments along its order, every segment is windowed on
its own, and what came before a segment enters it as one extra *carrier* row:

1. rows per group, combined map-side; only the hot groups are kept, at most
   rows / HOT_ROWS of them;
2. their rows are range-partitioned by group and whole order, so that neither far values nor
   repeated ones make a segment larger than others, and stored once: a partition is a segment;
3. totals per segment, and running sums over those few totals;
4. the totals join the rows as carriers, and one window per (group, segment) finishes.

Rows of other groups are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlake.session import broadcast_checked, cut_lineage

# Rows of a segment, and rows beyond which a group is cut into segments.
SPAN = 1 << 16
HOT_ROWS = 1 << 20

_SEG, _CARRY, _HOT = "__seg", "__carrier", "__hot"


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _hot_groups(df: DataFrame, group: list[str], hot_rows: int) -> DataFrame:
    """(group.., n) of the groups with more than ``hot_rows`` rows, materialised."""
    sizes = df.groupBy(*[_quoted(g) for g in group]).agg(F.count("*").alias("__n"))
    return cut_lineage(sizes.where(F.col("__n") > hot_rows))


def _in_order(df: DataFrame, order: list[str], pieces: int) -> DataFrame:
    """Rows in ``pieces`` range partitions of their whole order; equal rows may be parted.

    Spark cuts at sampled rows, so a piece holds about as many rows as any other, whatever the
    values are.
    """
    keys = [*[_quoted(o) for o in order], F.col("__row")]
    laid = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(max(1, pieces), *keys)
    return laid.sortWithinPartitions(*keys).drop("__row")


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    *,
    segment: Column | None = None,
    span: int = SPAN,
    hot_rows: int | None = HOT_ROWS,
    position: str | None = None,
    sums: dict[str, Column] | None = None,
    group_sums: dict[str, Column] | None = None,
    group_mins: dict[str, Column] | None = None,
    attach: DataFrame | None = None,
) -> DataFrame:
    """Add columns that depend on a row's place in its group.

    ``position``    one-based place in ``order``
    ``sums``        running sums up to and including the row
    ``group_sums``, ``group_mins``  whole-group aggregates on every row
    ``attach``      a table with one row per group: its other columns, on every row

    Groups of more than ``hot_rows`` rows are cut into segments; None cuts all of them.
    ``segment`` must not decrease along ``order``; by default a hot group is cut into ranges of
    its whole order of about ``span`` rows each. Ties in ``order`` are broken arbitrarily, so
    make it unique for a reproducible result. All columns of ``df`` travel with the rows, so
    leave images out and join them back by key. ``attach`` rides in on carriers too, so the
    rows are not shuffled for it and a hot group is no hot join key.
    """
    run = dict(sums or {})
    if position:
        run[position] = F.lit(1)
    whole = {n: (F.sum, e) for n, e in (group_sums or {}).items()}
    whole |= {n: (F.min, e) for n, e in (group_mins or {}).items()}
    keys = [_quoted(g) for g in group]
    attached = [] if attach is None else [c for c in attach.columns if c not in group]

    if hot_rows is None:
        if segment is None:
            raise ValueError("cutting every group needs a segment")
        hot, rows = None, df.withColumn(_SEG, segment)
    else:
        hot = _hot_groups(df, group, hot_rows)
        if hot.isEmpty():
            hot, rows = None, df.withColumn(_SEG, F.lit(0).cast("bigint"))
            if attach is None:
                return _whole_groups(df, keys, order, run, whole)
            segment = None
        else:
            flagged = _join_hot(df, hot, group)
            crowded = flagged.where(F.col("__n").isNotNull())
            if segment is None:
                pieces = -(-hot.agg(F.sum("__n")).first()[0] // span)
                cut = cut_lineage(_in_order(crowded, [*group, *order], pieces).withColumn(_SEG, F.spark_partition_id().cast("bigint")))
            else:
                cut = crowded.withColumn(_SEG, F.coalesce(segment, F.lit(0)).cast("bigint"))
            rows = flagged.where(F.col("__n").isNull()).withColumn(_SEG, F.lit(0).cast("bigint")).unionByName(cut)

    # Values each row brings in; carriers bring the same columns with what came before.
    body = rows.select(
        *[_quoted(c) for c in df.columns],
        _SEG,
        F.lit(False).alias(_CARRY),
        *[e.cast("bigint").alias(f"__r_{n}") if n == position else e.alias(f"__r_{n}") for n, e in run.items()],
        *[e.alias(f"__x_{n}") for n, (_, e) in whole.items()],
    )
    out = body
    if segment is not None or hot is not None:
        carriers = _carriers(rows if hot is None else cut, group, run, whole)
        if attached:
            carriers = carriers.join(_prefixed(attach, group, attached), group, "left")
        out = out.unionByName(carriers, allowMissingColumns=True)
    if attached and hot_rows is not None:
        cold = _prefixed(attach, group, attached)
        if hot is not None:
            cold = _join_hot(cold, hot, group).where(F.col("__n").isNull()).drop("__n")
        cold = cold.withColumns({_SEG: F.lit(0).cast("bigint"), _CARRY: F.lit(True)})
        out = out.unionByName(cold, allowMissingColumns=True)

    inside = Window.partitionBy(*keys, _SEG)
    upto = inside.orderBy(F.col(_CARRY).desc(), *[_quoted(o) for o in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    added = {n: F.sum(f"__r_{n}").over(upto) for n in run}
    for n, (agg, _) in whole.items():
        # From the carrier where the group was cut, else from the group itself.
        here = agg(f"__x_{n}").over(inside)
        added[n] = F.coalesce(F.first(f"__w_{n}").over(upto), here) if out is not body and f"__w_{n}" in out.columns else here
    for n in attached:
        added[n] = F.first(f"`__a_{n}`").over(upto)
    kept = [c for c in df.columns if c not in added]
    return (
        out.select(*[_quoted(c) for c in kept], _CARRY, *[e.alias(n) for n, e in added.items()])
        .where(~F.col(_CARRY))
        .drop(_CARRY)
    )


def _whole_groups(df: DataFrame, keys: list[Column], order: list[str], run: dict, whole: dict) -> DataFrame:
    """Plain windows: no group is hot."""
    inside = Window.partitionBy(*keys)
    upto = inside.orderBy(*[_quoted(o) for o in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {n: F.sum(e).over(upto) for n, e in run.items()}
    added |= {n: agg(e).over(inside) for n, (agg, e) in whole.items()}
    return df.select(
        *[_quoted(c) for c in df.columns if c not in added], *[e.alias(n) for n, e in added.items()]
    )


def _join_hot(df: DataFrame, hot: DataFrame, group: list[str]) -> DataFrame:
    """Rows with the size of their group where it is hot; nulls are a group too."""
    other = hot.select(*[_quoted(g).alias(f"__h_{g}") for g in group], "__n")
    same = F.lit(True)
    for g in group:
        same = same & _quoted(g).eqNullSafe(_quoted(f"__h_{g}"))
    return df.join(broadcast_checked(other), same, "left").drop(*[f"__h_{g}" for g in group])


def _prefixed(attach: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    return attach.select(*[_quoted(g) for g in group], *[_quoted(c).alias(f"__a_{c}") for c in columns])


def _carriers(rows: DataFrame, group: list[str], run: dict, whole: dict) -> DataFrame:
    """One row per segment: sums of all segments before it, and whole-group values."""
    keys = [_quoted(g) for g in group]
    totals = rows.groupBy(*keys, _SEG).agg(
        *[F.sum(e).alias(f"__r_{n}") for n, e in run.items()],
        *[agg(e).alias(f"__w_{n}") for n, (agg, e) in whole.items()],
    )
    per_group = Window.partitionBy(*keys)
    before = per_group.orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys,
        _SEG,
        F.lit(True).alias(_CARRY),
        *[F.sum(f"__r_{n}").over(before).alias(f"__r_{n}") for n in run],
        *[agg(f"__w_{n}").over(per_group).alias(f"__w_{n}") for n, (agg, _) in whole.items()],
    )


def number_within(df: DataFrame, group: list[str], order: list[str], name: str, **kw) -> DataFrame:
    """One-based ``row_number`` per group, without a whole group in one task."""
    return running(df, group, order, position=name, **kw)


def segment_of(order: str, span: int = SPAN) -> Column:
    """Segment number of a column that counts rows."""
    return F.floor(_quoted(order) / F.lit(span)).cast("bigint")


def moving_mean(
    df: DataFrame, group: list[str], index: str, columns: dict[str, str], k: int, span: int = SPAN
) -> DataFrame:
    """Mean of the last ``k`` rows (fewer at the start) per group.

    ``index`` counts the rows of a group without gaps. The last k-1 rows of a segment
    are also sent to the next one, so a single shuffle suffices.
    """
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and the segment span")
    here = segment_of(index, span)
    own = F.struct(here.alias("seg"), F.lit(False).alias("halo"))
    ahead = F.struct((here + 1).alias("seg"), F.lit(True).alias("halo"))
    near_end = F.pmod(_quoted(index), F.lit(span)) >= F.lit(span - (k - 1))
    rows = df.withColumn("__at", F.explode(F.when(near_end, F.array(own, ahead)).otherwise(F.array(own))))
    w = (
        Window.partitionBy(*[_quoted(g) for g in group], F.col("__at.seg"))
        .orderBy(_quoted(index))
        .rowsBetween(-(k - 1), Window.currentRow)
    )
    return (
        rows.select("*", *[F.avg(_quoted(c)).over(w).alias(n) for n, c in columns.items()])
        .where(~F.col("__at.halo"))
        .drop("__at")
    )


def with_ordinal(
    df: DataFrame,
    key: str,
    name: str = "ordinal",
    ties: tuple[str, ...] = (),
    segments: int | None = None,
    total: str | None = None,
    span: int = SPAN,
) -> DataFrame:
    """One-based global position in ``key`` order (``ties`` break equal keys), nulls first.

    Rows are range-partitioned by the whole order, one partition per ``span`` rows, and stored
    once; a row's position is its place in its partition and the rows of the partitions before.
    A key that many rows share is cut like any other. ``total`` adds the number of all rows.
    """
    pieces = segments or -(-df.count() // span)
    laid = _in_order(df, [key, *ties], pieces).withColumn("__at", F.monotonically_increasing_id())
    laid = cut_lineage(laid).withColumn("__part", F.shiftright("__at", 33))
    cells = laid.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    every = Window.partitionBy()
    before = F.sum("__n").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = F.coalesce(before, F.lit(0)) - F.col("__first") + 1
    cells = cells.select("__part", shift.alias("__shift"), F.sum("__n").over(every).alias("__total"))
    out = laid.join(broadcast_checked(cells), "__part")
    added = {name: F.col("__at") + F.col("__shift")} | ({total: F.col("__total")} if total else {})
    return out.withColumns(added).drop("__part", "__at", "__shift", "__total" if total != "__total" else "__part")


def with_hash_ordinal(df: DataFrame, hashed: Column, bits: int, name: str, ties: tuple[str, ...]) -> DataFrame:
    """Global position in the order of a uniform hash of ``bits`` bits; ``ties`` break equal ones."""
    return with_ordinal(df.withColumn("__hash", hashed), "__hash", name, ties).drop("__hash")


def chunk_ids(df: DataFrame, key: str, size: int = 80, name: str = "chunk", **kw) -> DataFrame:
    """Zero-based number of the contiguous chunk of ``size`` rows; the last may be short."""
    out = with_ordinal(df, key, "__ordinal", **kw)
    return out.withColumn(name, F.floor((F.col("__ordinal") - 1) / size).cast("bigint")).drop("__ordinal")


def split_ids(df: DataFrame, key: str, n: int, name: str = "part", **kw) -> DataFrame:
    """Zero-based number of one of ``n`` contiguous parts whose sizes differ by at most one.

    The first ``rows mod n`` parts get the extra row.
    """
    out = with_ordinal(df, key, "__ordinal", total="__total", **kw)
    at = F.col("__ordinal") - 1
    base, extra = F.expr(f"__total div {n}"), F.expr(f"__total % {n}")
    big = extra * (base + 1)
    part = F.when(at < big, F.floor(at / (base + 1))).otherwise(
        extra + F.floor(F.try_divide(at - big, base))
    )
    return out.withColumn(name, part.cast("int")).drop("__ordinal", "__total")
