"""Merkle manifest of a table: levels as strings of concatenated digests.

Rows are leaves, ordered by id within their group. Every aligned block of ``FANOUT ** 2`` nodes
keeps its level as one string of 64-character digests; fixed-width substrings of it are hashed to
the level above, and what flanks a node's substring within its run are its siblings. The top of
each block is a node of the next round, until one node per group is left; the groups' tops form
one more tree of the same kind. Proofs are put together on the way down.

Nothing is collected beyond a block, so a group may hold any share of the rows; places within a
group come from a range sort and the counts of its partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlake.llm.store import stored

FANOUT = 16
BLOCK = FANOUT**2
DIGEST = 64
RUN = FANOUT * DIGEST
_STEPS = "array<struct<left: string, right: string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: sha256 of its framed values."""
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def siblings(steps) -> Column:
    """All siblings of a proof as one text, from the leaf up to the root."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def fold(digest, steps) -> Column:
    """The root that a digest and the steps of its proof lead to."""
    return F.aggregate(steps, digest, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def _above(level: str) -> Column:
    """The level above one that is a string of digests."""
    runs = F.sequence(F.lit(0), F.expr(f"CAST((length({level}) - 1) DIV {RUN} AS INT)"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(F.col(level), i * RUN + 1, F.lit(RUN)), 256)), "")


def _step(level: str, at: Column) -> Column:
    """What flanks the node at place ``at`` of a level within its run."""
    run = F.substring(F.col(level), F.floor(at / FANOUT).cast("int") * RUN + 1, F.lit(RUN))
    here = (at % FANOUT).cast("int") * DIGEST
    return F.struct(
        F.substring(run, F.lit(1), here).alias("left"),
        F.substring(run, here + DIGEST + 1, F.lit(RUN)).alias("right"),
    )


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``rank`` (from 0) and ``size`` within their group ``g``, without a group in a task."""
    laid = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    # The place in the sorted table: partition and row; fixed once the table is written.
    laid = stored(laid.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    laid = laid.withColumn("part", F.shiftright("at", 33))
    cells = laid.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size")
    )
    return laid.join(cells, ["g", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """(g, size, block, nodes, level0, level1, top), one row per aligned block of a group."""
    node = F.struct((F.col("rank") % BLOCK).alias("pos"), "digest", *carry)
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    rows = nodes.groupBy("g", "size", block.alias("block")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    rows = rows.withColumn("level0", F.array_join(F.transform("nodes", lambda x: x["digest"]), ""))
    rows = rows.withColumn("level1", F.when(F.col("size") > 1, _above("level0")))
    return rows.withColumn("top", F.coalesce(F.when(F.col("size") > FANOUT, _above("level1")), "level1", "level0"))


def _rounds(nodes: DataFrame, carry: list[str]) -> list[DataFrame]:
    """The blocks of every round, those of the leaves first."""
    out: list[DataFrame] = []
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest:
        out.append(stored(_blocks(nodes, [] if out else carry), "merkle-blocks"))
        going = out[-1].where(F.col("size") > BLOCK)
        nodes = going.select("g", F.col("block").alias("rank"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("top").alias("digest"))
        largest = 0 if largest <= BLOCK else -(-largest // BLOCK)
    return out


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """(g, last, digest): the top node of every group and the round in which it is reached."""
    out = None
    for i, blocks in enumerate(rounds):
        done = blocks.where(F.col("size") <= BLOCK).select("g", F.lit(i).alias("last"), F.col("top").alias("digest"))
        out = done if out is None else out.unionAll(done)
    return out


def _proofs(rounds: list[DataFrame], above: DataFrame, carry: list[str]) -> DataFrame:
    """(g, digest, carry.., above's columns, steps) of every leaf.

    ``above`` has one row per group: ``last``, the steps above its top, and columns to hand down.
    """
    handed = [c for c in above.columns if c not in ("g", "last", "steps")]
    down = None
    for i in range(len(rounds) - 1, -1, -1):
        blocks = rounds[i]
        start = above.where(F.col("last") == i).select("g", F.lit(0).cast("long").alias("block"), *handed, "steps")
        tails = start if down is None else start.unionByName(down)
        each = blocks.join(tails, ["g", "block"])
        kept = carry if i == 0 else []
        each = each.select("g", "block", "size", "level0", "level1", *handed, "steps", F.explode("nodes").alias("node"))
        pos = F.col("node.pos")
        none = F.array().cast(_STEPS)
        low = F.when(F.col("size") > 1, F.array(_step("level0", pos))).otherwise(none)
        high = F.when(F.col("size") > FANOUT, F.array(_step("level1", F.floor(pos / FANOUT)))).otherwise(none)
        down = each.select(
            "g",
            (F.col("block") * BLOCK + pos).alias("block"),
            F.col("node.digest").alias("digest"),
            *[F.col(f"node.{c}").alias(c) for c in kept],
            *handed,
            F.concat(low, high, "steps").alias("steps"),
        )
        if i:
            down = down.drop("digest")
    return down.drop("block")


def manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, steps, and the columns of ``carry``.

    ``leaf`` is the digest of a row, see :func:`leaf_digest`; ``carry`` names further digests or
    narrow values of the row that come through with its proof. Other columns are not read, so
    their names cannot clash. ``steps`` are the siblings left and right of the row's node, level
    by level up to the root; :func:`fold` climbs them.

    Within a group (null is a group of its own) leaves ascend by id, null ids first; rows that
    share an id ascend by leaf. Every run of 16 nodes becomes the sha256 of their digests' hex
    text, also a last run of one node, until one is left. The groups' tops, null first, then by
    the bytes of their names, form one more such tree. A lone leaf is its group's top, a lone
    group's top the root. Null and empty values have framings of their own; a text is hashed
    whole. Repeated rows are leaves of their own. No row: no row.
    """
    extra = carry or {}
    if clash := {"g", "pos", "digest", "rank", "size", "nth", "at", "part"} & set(extra):
        raise ValueError(f"reserved names: {sorted(clash)}")
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(group.alias("g"), F.col(id_col).cast("long").alias("id"), leaf.alias("digest"), *[v.alias(c) for c, v in extra.items()])
    # Whole texts are read once; from here on only digests move.
    leaves = stored(leaves.withColumn("nth", F.monotonically_increasing_id()), "merkle-leaves")
    kept = ["id", *extra]
    rounds = _rounds(_numbered(leaves, "id", "digest", "nth").drop("nth"), kept)
    if not rounds:
        empty = leaves.select("id", F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_STEPS).alias("steps"), *extra)
        return empty.withColumnRenamed("id", id_col)
    tops = _tops(rounds)
    groups = _numbered(tops.select(F.lit(0).alias("g"), F.col("g").alias("name"), "last", "digest"), "name")
    upper = _rounds(groups, ["name", "last"])
    crown = _tops(upper).select("g", "last", F.col("digest").alias("root"), F.array().cast(_STEPS).alias("steps"))
    above = _proofs(upper, crown, ["name", "last"])
    above = stored(above.select(F.col("name").alias("g"), "last", F.col("digest").alias("subroot"), "root", "steps"), "merkle-groups")
    out = _proofs(rounds, above, kept)
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "steps", *extra)
