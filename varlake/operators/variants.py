"""Instructions of episodes, pools of variants, and the rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlake.fixed_values import SCOPES
from varlake.functions.hashing import SHUFFLE_KEY_BITS, draw_index, shuffle_key
from varlake.operators.segments import SPAN, running, with_hash_ordinal
from varlake.session import BROADCAST_BYTES, small_enough


# --- instructions of episodes -------------------------------------------------


def first_instruction(
    episodes: DataFrame, key: str = "episode_id", steps: str = "steps", text: str = "language_instruction"
) -> tuple[DataFrame, DataFrame]:
    """(key, instruction) of nested episodes, and (key, reason) of those without one.

    Only the instruction field of the steps is read; image bytes stay on disk.
    """
    found = episodes.select(
        F.col(key),
        F.size(F.col(f"{steps}.{text}")).alias("n"),
        F.try_element_at(F.col(f"{steps}.{text}"), F.lit(1)).alias("instruction"),
    )
    good = F.col("instruction").isNotNull()
    reason = F.when(F.coalesce(F.col("n"), F.lit(0)) <= 0, "no_steps").otherwise("unreadable_instruction")
    return (
        found.where(good).select(key, "instruction"),
        found.where(~good).select(key, reason.alias("reason")),
    )


def first_instruction_long(steps: DataFrame, key: str, order: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The same from one row per step; each task keeps one candidate per episode."""
    found = steps.groupBy(key).agg(F.min_by(text, order).alias("instruction"))
    bad = found.where("instruction IS NULL").select(key, F.lit("unreadable_instruction").alias("reason"))
    return found.where("instruction IS NOT NULL"), bad


def episodes_per_instruction(
    df: DataFrame,
    key: str,
    order: str,
    instruction: str = "instruction",
    legacy_dup_first: bool = False,
    **cut,
) -> DataFrame:
    """Inverted index in long form: (instruction, first_ord, pos, key).

    ``first_ord`` is where the instruction first appears, ``pos`` the place of the key in
    its list. ``legacy_dup_first`` lists each first key twice. No list is ever
    collected, so an instruction may own any share of the episodes.
    """
    out = running(
        df.select(F.col(instruction).alias("instruction"), F.col(order).alias("ord"), F.col(key).alias("key")),
        ["instruction"],
        ["ord"],
        position="pos",
        group_mins={"first_ord": F.col("ord")},
        **cut,
    )
    if legacy_dup_first:
        places = F.when(F.col("pos") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col("pos") + 1))
        out = out.withColumn("pos", F.explode(places))
    return out.select("instruction", "first_ord", F.col("pos").cast("bigint").alias("pos"), "key")


def index_chunks(index: DataFrame, size: int = 10_000) -> DataFrame:
    """Lists for export, cut into chunks of at most ``size`` keys: whole, yet bounded."""
    chunk = F.floor((F.col("pos") - 1) / size).cast("bigint").alias("chunk")
    return (
        index.groupBy("instruction", "first_ord", chunk)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("entries"))
        .select("instruction", "first_ord", "chunk", F.col("entries.key").alias("keys"))
    )


# --- pools ----------------------------------------------------------------------


def scope_order(scope, scopes=SCOPES) -> Column:
    c = F.col(scope) if isinstance(scope, str) else scope
    return F.array_position(F.array(*[F.lit(s) for s in scopes]), c).cast("int")


def merge_pool(
    variants: DataFrame, keys: tuple[str, ...] = ("instruction",), distinct: bool = False, scopes=SCOPES
) -> DataFrame:
    """All variants of an instruction as (keys.., idx, n, variant), one row each.

    ``idx`` runs from 0 in scope order, then list order; repeats count unless ``distinct``.
    Rows of unknown scopes have no place in the order; :func:`unknown_scopes` lists them.
    """
    rows = variants.select(
        *keys, scope_order("scope", scopes).alias("scope_ord"), F.col("pos").cast("bigint").alias("pos"), "variant"
    ).where(F.col("scope_ord") > 0)
    if distinct:
        rows = (
            rows.groupBy(*keys, "variant")
            .agg(F.min(F.struct("scope_ord", "pos")).alias("at"))
            .select(*keys, "at.scope_ord", "at.pos", "variant")
        )
    width = F.lit(1 << 40)
    numbered = running(
        rows,
        list(keys),
        ["scope_ord", "pos"],
        segment=F.col("scope_ord") * width + F.floor(F.col("pos") / SPAN),
        position="idx",
        group_sums={"n": F.lit(1)},
    )
    return numbered.select(*keys, (F.col("idx") - 1).cast("bigint").alias("idx"), F.col("n").cast("bigint").alias("n"), "variant")


def unknown_scopes(variants: DataFrame, scopes=SCOPES) -> DataFrame:
    """The rows that :func:`merge_pool` has no place for, null scopes included, with the reason."""
    known = F.coalesce(scope_order("scope", scopes) > 0, F.lit(False))
    return variants.where(~known).withColumn("reason", F.lit("unknown_scope"))


def pool_arrays(pool: DataFrame, keys: tuple[str, ...] = ("instruction",)) -> DataFrame:
    """(keys.., variants) lists. Only for pools measured to be small."""
    return (
        pool.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("idx", "variant"))).alias("entries"))
        .select(*keys, F.col("entries.variant").alias("variants"))
    )


def pool_quality(variants: DataFrame, expected: int = 3, keys: tuple[str, ...] = ("scope", "instruction")) -> DataFrame:
    """Per instruction and scope: how many variants, how many differ, how many changed nothing."""
    return variants.groupBy(*keys).agg(
        F.count("*").alias("n_variants"),
        F.count_distinct("variant").alias("n_distinct"),
        F.count_if(F.col("variant") == F.col("instruction")).alias("n_identity"),
        (F.count("*") == expected).alias("complete"),
    )


# --- draw and rewrite -------------------------------------------------------------


def draw_from(variants, seed, *keys) -> Column:
    """One element of an array column, fixed by ``seed`` and ``keys``."""
    v = F.col(variants) if isinstance(variants, str) else variants
    return F.try_element_at(v, (draw_index(seed, keys, F.size(v)) + 1).cast("int"))


def draw_variant(
    df: DataFrame,
    pool: DataFrame,
    seed,
    draw_keys: list,
    on: tuple[str, ...] = ("instruction",),
    name: str = "new_instruction",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add a variant drawn from the row's pool; a row without a pool keeps its instruction.

    A pool measured to fit ``limit`` is broadcast as lists and nothing is shuffled. A
    larger one is looked up twice in long form: the size of the pool, then the drawn
    place in it, so no list is built and a hot instruction spreads over its variants.
    """
    own = F.col(on[-1])
    if small_enough(pool, limit):
        lists = pool_arrays(pool, on).withColumnRenamed("variants", "__variants")
        joined = df.join(F.broadcast(lists), list(on), "left")
        drawn = joined.withColumn(name, F.coalesce(draw_from("__variants", seed, *draw_keys), own))
        return drawn.drop("__variants").select(*df.columns, name)
    sizes = pool.where("idx = 0").select(*on, F.col("n").alias("__n"))
    placed = df.join(sizes, list(on), "left").withColumn("__i", draw_index(seed, draw_keys, F.col("__n")))
    texts = pool.select(*on, F.col("idx").alias("__i"), F.col("variant").alias("__v"))
    drawn = placed.join(texts, [*on, "__i"], "left").withColumn(name, F.coalesce("__v", own))
    return drawn.select(*df.columns, name)


def _draw_keys(key: str, epoch) -> list:
    return [F.col(key)] if epoch is None else [F.lit(str(epoch)), F.col(key)]


def rewrite_instructions(
    episodes: DataFrame,
    pool: DataFrame,
    seed,
    epoch=None,
    key: str = "episode_id",
    limit: int = BROADCAST_BYTES,
    block: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nested episodes with a drawn instruction in every step, and (key, reason) of the rest.

    With a broadcast pool this is one scan and one write, without any shuffle. Episodes
    with no steps are dropped as such and listed with their reason.

    Where an episode is several rows (see :func:`nest_steps`), ``block`` is the column that
    orders them: the first of them has the episode's instruction, one draw is made on a
    narrow row per episode and joined back to all of its rows.
    """
    if block is None and "block" in episodes.columns:
        raise ValueError("an episode is several rows here: name their order, block='block'")
    if block is not None:
        return _rewrite_blocks(episodes, pool, seed, epoch, key, limit, block)
    instructions = F.col("steps.language_instruction")
    first = F.try_element_at(instructions, F.lit(1))
    usable = (F.size("steps") > 0) & first.isNotNull()
    good = episodes.where(usable).withColumn("instruction", first)
    drawn = draw_variant(good, pool, seed, _draw_keys(key, epoch), limit=limit)
    reason = F.when(F.coalesce(F.size("steps"), F.lit(-1)) <= 0, "no_steps").otherwise("unreadable_instruction")
    bad = episodes.where(~F.coalesce(usable, F.lit(False))).select(key, reason.alias("reason"))
    return _fill_steps(drawn), bad


def _fill_steps(drawn: DataFrame) -> DataFrame:
    return drawn.withColumn(
        "steps",
        F.transform("steps", lambda s: s.withField("language_instruction", F.col("new_instruction"))),
    ).drop("instruction", "new_instruction")


def _rewrite_blocks(episodes, pool, seed, epoch, key, limit, block) -> tuple[DataFrame, DataFrame]:
    # Blocks without steps say nothing; an episode of nothing else has none.
    filled = F.when(F.size("steps") > 0, F.col(block))
    first = F.try_element_at(F.col("steps.language_instruction"), F.lit(1))
    firsts = episodes.groupBy(key).agg(F.min_by(first, filled).alias("instruction"), F.count(filled).alias("n"))
    drawn = draw_variant(firsts.where("instruction IS NOT NULL"), pool, seed, _draw_keys(key, epoch), limit=limit)
    texts = drawn.select(F.col(key).alias("__key"), "instruction", "new_instruction")
    joined = episodes.join(texts, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    reason = F.when(F.col("n") == 0, "no_steps").otherwise("unreadable_instruction")
    return _fill_steps(joined), firsts.where("instruction IS NULL").select(key, reason.alias("reason"))


def rewrite_long(
    steps: DataFrame,
    pool: DataFrame,
    seed,
    key: str = "episode_id",
    order: str = "step_idx",
    text: str = "language_instruction",
    epoch=None,
    limit: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """The rewrite for one row per step, and (key, reason) of episodes without an instruction.

    The draw is made on (key, instruction) pairs, one narrow row per episode; the join
    back to the steps is the only exchange of wide rows and splits a hot episode.
    """
    firsts, bad = first_instruction_long(steps, key, order, text)
    drawn = draw_variant(firsts, pool, seed, _draw_keys(key, epoch), limit=limit)
    return steps.join(drawn.select(key, "new_instruction"), key), bad


def nest_steps(steps: DataFrame, key: str, order: str, fields: list[str], block: int | None = None) -> DataFrame:
    """(key, steps): an episode is one row, as recorded episodes and shards have it.

    With ``block``, (key, block, steps): at most that many steps to a row, in order; ``order``
    then counts the steps of an episode from 1, and :func:`rewrite_instructions` must be told.
    """
    if block is None:
        return steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("steps"))
    at = F.floor((F.col(order) - 1) / block).cast("bigint").alias("block")
    entries = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return steps.groupBy(key, at).agg(entries.alias("steps"))


def shuffle_rows(df: DataFrame, key: str, seed, name: str = "shuffled_pos") -> DataFrame:
    """Give every row its place in a full shuffle fixed by ``seed``."""
    return with_hash_ordinal(df, shuffle_key(seed, key), SHUFFLE_KEY_BITS, name, (key,))


__all__ = [
    "draw_from",
    "draw_variant",
    "episodes_per_instruction",
    "first_instruction",
    "first_instruction_long",
    "index_chunks",
    "merge_pool",
    "nest_steps",
    "pool_arrays",
    "pool_quality",
    "rewrite_instructions",
    "rewrite_long",
    "scope_order",
    "shuffle_rows",
    "unknown_scopes",
]
