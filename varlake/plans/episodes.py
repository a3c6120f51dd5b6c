"""Instruction and rewrite queries: ``part`` plays the episodes, ``lineitem`` their steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlake.functions.text import (
    decode_text,
    matches_any,
    rollout_path,
    run_id,
    stamp_columns,
    strip_scene_prefix,
    suite_of,
    task_slug,
    task_to_sentence,
)
from varlake.operators.lookups import TEMPLATES, check_scope, render_prompts
from varlake.operators.segments import number_within
from varlake.operators.variants import (
    draw_variant,
    episodes_per_instruction,
    first_instruction,
    first_instruction_long,
    index_chunks,
    merge_pool,
    nest_steps,
    pool_quality,
    rewrite_instructions as rewrite_episodes,
    rewrite_long,
    shuffle_rows,
)
from varlake.plans.registry import query, table
from varlake.session import cut_lineage

SEED = 7
STEP_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]

# --- shared inputs -------------------------------------------------------------------


def numbered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, step_idx, quantity, price, discount, tax, language_instruction), step_idx from 1."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", *STEP_ORDER, "l_discount", "l_tax")
    names = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("language_instruction")
    )
    steps = number_within(lines, ["l_partkey"], STEP_ORDER, "step_idx", attach=names)
    return steps.where("language_instruction IS NOT NULL").select(
        F.col("l_partkey").alias("episode_id"),
        "step_idx",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        "language_instruction",
    )


def derived_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants per scope of every name, made in SQL where a model would be asked.

    Names that begin with "red" get none, so the default of the lookup is used.
    """
    names = (
        table(spark, sf_dir, "part").select(F.col("p_name").alias("instruction")).distinct()
        .where(~F.col("instruction").startswith("red"))
    )
    a, b = F.substring_index("instruction", " ", 1), F.substring_index("instruction", " ", -1)
    texts = {
        "one": [F.concat(F.lit("new "), "instruction"), F.concat(a, F.lit(" spare "), b), F.concat("instruction", F.lit(" unit"))],
        "two": [F.concat(F.lit("pick "), b, F.lit(" "), a), F.concat(a, F.lit(" and "), b), F.concat("instruction", F.lit(" unit"))],
        "all": [
            F.concat(F.lit("please find the "), "instruction"),
            F.concat(F.lit("could you get the "), "instruction", F.lit("?")),
            F.col("instruction"),
        ],
    }
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("scope"), F.lit(i).alias("pos"), t.alias("variant"))
            for s, ts in texts.items()
            for i, t in enumerate(ts)
        ]
    )
    return names.select("instruction", F.inline(rows))


VARIANTS_SQL = """
names AS (SELECT DISTINCT p_name AS instruction FROM part WHERE NOT starts_with(p_name, 'red')),
words AS (SELECT instruction, split_part(instruction, ' ', 1) AS a, split_part(instruction, ' ', -1) AS b FROM names),
variants AS (
  SELECT instruction, 1 AS scope_ord, 'one' AS scope, 0 AS pos, 'new ' || instruction AS variant FROM words
  UNION ALL SELECT instruction, 1, 'one', 1, a || ' spare ' || b FROM words
  UNION ALL SELECT instruction, 1, 'one', 2, instruction || ' unit' FROM words
  UNION ALL SELECT instruction, 2, 'two', 0, 'pick ' || b || ' ' || a FROM words
  UNION ALL SELECT instruction, 2, 'two', 1, a || ' and ' || b FROM words
  UNION ALL SELECT instruction, 2, 'two', 2, instruction || ' unit' FROM words
  UNION ALL SELECT instruction, 3, 'all', 0, 'please find the ' || instruction FROM words
  UNION ALL SELECT instruction, 3, 'all', 1, 'could you get the ' || instruction || '?' FROM words
  UNION ALL SELECT instruction, 3, 'all', 2, instruction FROM words)"""
POOL_SQL = VARIANTS_SQL + """,
pool AS (
  SELECT instruction, row_number() OVER (PARTITION BY instruction ORDER BY scope_ord, pos) - 1 AS idx,
         count(*) OVER (PARTITION BY instruction) AS n, variant
  FROM variants)"""
STEPS_SQL = """
steps AS (
  SELECT l_partkey AS episode_id, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
         l_tax AS tax, p_name AS language_instruction,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey,
                            l_quantity, l_extendedprice, l_shipdate) AS step_idx
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _drawn_sql(draw_text: str, episodes: str) -> str:
    """Each episode's drawn variant; ``draw_text`` is what is hashed."""
    return f"""
drawn AS (
  SELECT e.episode_id, e.instruction, coalesce(p.variant, e.instruction) AS new_instruction
  FROM (SELECT x.*, (SELECT max(n) FROM pool q WHERE q.instruction = x.instruction) AS n FROM {episodes} x) e
  LEFT JOIN pool p ON p.instruction = e.instruction
    AND p.idx = ('0x' || substr(md5({draw_text}), 1, 8))::BIGINT % e.n)"""


# --- the rewrite -----------------------------------------------------------------------

_REWRITE_SQL = (
    "WITH" + STEPS_SQL + "," + POOL_SQL + """,
firsts AS (SELECT episode_id, arg_min(language_instruction, step_idx) AS instruction FROM steps GROUP BY episode_id),"""
    + _drawn_sql(f"'{SEED}:' || e.episode_id", "firsts")
    + """
SELECT s.episode_id, s.step_idx, s.language_instruction AS old_text, d.new_instruction AS new_text
FROM steps s JOIN drawn d USING (episode_id)"""
)


@query(_REWRITE_SQL)
def rewrite_instructions(spark, sf_dir):
    """Flagship: draw a variant per episode, number the steps, put the variant in every step.

    The draw is made on one narrow row per episode and rides in on the segment
    carriers, so the steps are shuffled once, for their numbering, and never by
    episode alone.
    """
    pool = merge_pool(derived_variants(spark, sf_dir))
    drawn = draw_variant(_part_episodes(spark, sf_dir), pool, SEED, ["episode_id"])
    texts = drawn.select(
        F.col("episode_id").alias("l_partkey"),
        F.col("instruction").alias("old_text"),
        F.col("new_instruction").alias("new_text"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", *STEP_ORDER)
    steps = number_within(lines, ["l_partkey"], STEP_ORDER, "step_idx", attach=texts)
    return steps.where("old_text IS NOT NULL").select(
        F.col("l_partkey").alias("episode_id"), "step_idx", "old_text", "new_text"
    )


@query(_REWRITE_SQL)
def rewrite_nested(spark, sf_dir):
    """The same on nested episodes in blocks of steps, with one draw per episode."""
    steps = numbered_steps(spark, sf_dir).withColumn("old_text", F.col("language_instruction"))
    nested = nest_steps(steps, "episode_id", "step_idx", ["language_instruction", "old_text"], block=1024)
    out, _ = rewrite_episodes(nested, merge_pool(derived_variants(spark, sf_dir)), SEED, block="block")
    return out.select("episode_id", F.explode("steps").alias("s")).select(
        "episode_id", "s.step_idx", "s.old_text", F.col("s.language_instruction").alias("new_text")
    )


_LONG_SQL = """WITH s AS (
  SELECT conv_id AS episode_id, turn AS step_idx, split_part(text, ' ', 1) AS word FROM conversations),
firsts AS (SELECT episode_id, arg_min(word, step_idx) AS w FROM s GROUP BY episode_id),
drawn AS (
  SELECT episode_id, CASE WHEN length(w) <= 3 THEN w
    WHEN ('0x' || substr(md5('7:' || episode_id), 1, 8))::BIGINT % 2 = 0 THEN 'to ' || w ELSE 'please ' || w END AS new
  FROM firsts)
SELECT episode_id, step_idx, word AS language_instruction, new AS new_instruction FROM s JOIN drawn USING (episode_id)"""


@query(_LONG_SQL)
def rewrite_steps(spark, sf_dir):
    """The rewrite of a step table: a conversation is an episode, a turn's first word its instruction."""
    word = F.substring_index("text", " ", 1)
    steps = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.col("turn").alias("step_idx"), word.alias("language_instruction")
    )
    words = steps.select(F.col("language_instruction").alias("instruction")).distinct().where(F.length("instruction") > 3)
    texts = F.array(
        F.struct(F.lit("one").alias("scope"), F.lit(0).alias("pos"), F.concat(F.lit("to "), "instruction").alias("variant")),
        F.struct(F.lit("all").alias("scope"), F.lit(0).alias("pos"), F.concat(F.lit("please "), "instruction").alias("variant")),
    )
    pool = merge_pool(words.select("instruction", F.inline(texts)))
    return rewrite_long(steps, pool, SEED)[0]


_PART_EPISODES = "(SELECT p_partkey AS episode_id, p_name AS instruction FROM part)"


def _part_episodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("episode_id"), F.col("p_name").alias("instruction")
    )


_DRAW_SQL = "WITH" + POOL_SQL + "," + _drawn_sql(f"'{SEED}:' || e.episode_id", _PART_EPISODES) + " SELECT * FROM drawn"


@query(_DRAW_SQL)
def variant_draw(spark, sf_dir):
    pool = merge_pool(derived_variants(spark, sf_dir))
    return draw_variant(_part_episodes(spark, sf_dir), pool, SEED, ["episode_id"])


@query(_DRAW_SQL)
def variant_draw_spread(spark, sf_dir):
    """The draw as it runs when the pool is too large to broadcast."""
    pool = merge_pool(derived_variants(spark, sf_dir))
    return draw_variant(_part_episodes(spark, sf_dir), pool, SEED, ["episode_id"], limit=0)


@query(
    "WITH" + POOL_SQL + "," + _drawn_sql(f"'{SEED}:' || '2:' || e.episode_id", _PART_EPISODES) + " SELECT * FROM drawn"
)
def variant_draw_epoch(spark, sf_dir):
    pool = merge_pool(derived_variants(spark, sf_dir))
    return draw_variant(_part_episodes(spark, sf_dir), pool, SEED, [F.lit("2"), "episode_id"])


# --- instructions of episodes -----------------------------------------------------------


@query(
    """SELECT conv_id, arg_min(text, turn) AS instruction FROM conversations GROUP BY conv_id"""
)
def first_instruction_steps(spark, sf_dir):
    return first_instruction_long(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")[0]


@query(
    """WITH f AS (SELECT conv_id, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id)
SELECT conv_id, 'unreadable_instruction' AS reason FROM f WHERE length(first) % 2 = 0"""
)
def first_instruction_steps_quarantine(spark, sf_dir):
    """Texts of even length get a stray byte and can't be decoded; a first one takes its episode out."""
    raw = F.encode("text", "UTF-8")
    text = decode_text(F.when(F.length("text") % 2 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw))
    steps = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return first_instruction_long(steps, "conv_id", "turn", "text")[1]


def _nested_turns(spark, sf_dir) -> DataFrame:
    """A record per turn whose steps are the lines of its text; tool turns and empty texts have none."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    steps = F.transform(
        lines,
        lambda x: F.struct(
            F.when(x.startswith("É"), F.lit(None)).otherwise(x).alias("language_instruction"),
            F.length(x).alias("size"),
        ),
    )
    empty = F.array().cast("array<struct<language_instruction:string,size:int>>")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("episode_id"),
        F.when(F.length("text") < 40, empty).otherwise(steps).alias("steps"),
    )


_NESTED_SQL = """WITH e AS (
  SELECT conv_id * 1000000 + turn AS episode_id, length(text) AS n,
         list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM conversations),
f AS (SELECT episode_id, CASE WHEN n < 40 THEN 0 ELSE len(lines) END AS n, lines[1] AS first FROM e) """


@query(_NESTED_SQL + "SELECT episode_id, first AS instruction FROM f WHERE n > 0 AND NOT starts_with(first, 'É')")
def first_instruction_nested(spark, sf_dir):
    return first_instruction(_nested_turns(spark, sf_dir))[0]


@query(
    _NESTED_SQL
    + """SELECT episode_id, CASE WHEN n = 0 THEN 'no_steps' ELSE 'unreadable_instruction' END AS reason
FROM f WHERE n = 0 OR starts_with(first, 'É')"""
)
def first_instruction_quarantine(spark, sf_dir):
    return first_instruction(_nested_turns(spark, sf_dir))[1]


_INDEX_SQL = """WITH i AS (
  SELECT p_name AS instruction, p_partkey AS key, min(p_partkey) OVER (PARTITION BY p_name) AS first_ord,
         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS pos FROM part) """


@query(_INDEX_SQL + "SELECT instruction, first_ord, pos, key FROM i")
def episodes_per_instruction_long(spark, sf_dir):
    return episodes_per_instruction(table(spark, sf_dir, "part"), "p_partkey", "p_partkey", "p_name")


@query(
    _INDEX_SQL
    + """SELECT instruction, first_ord, pos + 1 AS pos, key FROM i
UNION ALL SELECT instruction, first_ord, 1, key FROM i WHERE pos = 1"""
)
def episodes_per_instruction_legacy(spark, sf_dir):
    return episodes_per_instruction(
        table(spark, sf_dir, "part"), "p_partkey", "p_partkey", "p_name", legacy_dup_first=True
    )


@query(
    _INDEX_SQL
    + """SELECT instruction, first_ord, (pos - 1) // 100 AS chunk,
  string_agg(key::VARCHAR, ',' ORDER BY pos) AS keys FROM i GROUP BY ALL"""
)
def episode_index_chunks(spark, sf_dir):
    index = episodes_per_instruction(table(spark, sf_dir, "part"), "p_partkey", "p_partkey", "p_name")
    keys = F.array_join(F.transform("keys", lambda k: k.cast("string")), ",")
    return index_chunks(index, 100).withColumn("keys", keys)


# --- pools ----------------------------------------------------------------------------------


@query("WITH" + POOL_SQL + " SELECT instruction, idx, n, variant FROM pool")
def pool_merge(spark, sf_dir):
    return merge_pool(derived_variants(spark, sf_dir))


@query(
    "WITH" + VARIANTS_SQL + """, d AS (
  SELECT instruction, variant, min(scope_ord * 10 + pos) AS place FROM variants GROUP BY ALL)
SELECT instruction, row_number() OVER (PARTITION BY instruction ORDER BY place) - 1 AS idx,
       count(*) OVER (PARTITION BY instruction) AS n, variant FROM d"""
)
def pool_merge_distinct(spark, sf_dir):
    return merge_pool(derived_variants(spark, sf_dir), distinct=True)


@query(
    "WITH" + VARIANTS_SQL + """
SELECT scope, instruction, count(*) AS n_variants, count(DISTINCT variant) AS n_distinct,
       count(*) FILTER (WHERE variant = instruction) AS n_identity, count(*) = 3 AS complete
FROM variants GROUP BY scope, instruction"""
)
def pool_quality_counts(spark, sf_dir):
    return pool_quality(derived_variants(spark, sf_dir))


# --- names and prompts -------------------------------------------------------------------------


@query("SELECT p_partkey, replace(replace(p_name, ' ', '_'), '_', ' ') AS sentence FROM part")
def task_sentence(spark, sf_dir):
    tasks = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("t"))
    return tasks.select("p_partkey", task_to_sentence("t").alias("sentence"))


@query(
    """WITH d AS (SELECT doc_id, source || '_' || lang || '_no_noops' AS name FROM documents)
SELECT doc_id, array_to_string(string_split(name, '_')[1:2], '_') AS suite FROM d"""
)
def suite_name(spark, sf_dir):
    name = F.concat_ws("_", "source", "lang", F.lit("no_noops"))
    return table(spark, sf_dir, "documents").select("doc_id", suite_of(name).alias("suite"))


@query(
    """SELECT doc_id, substr(translate(lower(text), ' ' || chr(10) || '.', '___'), 1, 50) AS slug
FROM documents"""
)
def task_slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", task_slug("text").alias("slug"))


@query(
    """WITH d AS (SELECT conv_id, turn, upper(role) || ' ROOM SCENE' || turn || ' ' || text AS s FROM conversations)
SELECT conv_id, turn, regexp_replace(s, '^([A-Z]+ )+SCENE[0-9]+ ', '') AS sentence FROM d"""
)
def scene_prefix(spark, sf_dir):
    marked = F.concat(F.upper("role"), F.lit(" ROOM SCENE"), F.col("turn").cast("string"), F.lit(" "), "text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", strip_scene_prefix(marked).alias("sentence")
    )


@query(
    """WITH e AS (SELECT event_id, 'EVAL-' || event_type || '-web-one-' || strftime(ts, '%Y_%m_%d-%H_%M_%S')
    || CASE WHEN value > 50 THEN '--user ' || user_id ELSE '' END AS run, event_type, user_id, value, ts FROM events)
SELECT event_id, run AS run_id,
  './rollouts/' || run || '/' || strftime(ts, '%Y_%m_%d-%H_%M_%S') || '--episode=' || event_id || '--success='
  || CASE WHEN event_type = 'purchase' THEN 'True' ELSE 'False' END || '--task=user_' || user_id || '_no_' || event_type
  || '.mp4' AS path FROM e"""
)
def run_and_rollout_ids(spark, sf_dir):
    at = F.date_format("ts", "yyyy_MM_dd-HH_mm_ss")
    note = F.when(F.col("value") > 50, F.concat(F.lit("user "), F.col("user_id").cast("string")))
    run = run_id("event_type", F.lit("web"), F.lit("one"), at, note)
    task = F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" no."), "event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        run.alias("run_id"),
        rollout_path(run, at, "event_id", F.col("event_type") == "purchase", task).alias("path"),
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PROMPTS_SQL = " UNION ALL ".join(
    f"SELECT item_id, '{scope}' AS scope, replace({_sql_text(t.replace('{{', '{').replace('}}', '}'))}, '{{sentence}}', text) AS prompt, "
    "NULL AS new_instruction FROM benchmark"
    for scope, t in TEMPLATES.items()
) + " UNION ALL SELECT item_id, 'zero', NULL, text FROM benchmark"


@query(_PROMPTS_SQL)
def prompt_cross(spark, sf_dir):
    prompts = render_prompts(table(spark, sf_dir, "benchmark"), column="text", identity=True)
    return prompts.select("item_id", "scope", "prompt", "new_instruction")


_SCOPES = ("src0", "src1", "src2")


@query("SELECT doc_id, source AS scope, source NOT IN ('src0', 'src1', 'src2') AS unknown FROM documents")
def scope_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scope"))
    known, unknown = check_scope(docs, _SCOPES)
    return known.withColumn("unknown", F.lit(False)).unionByName(unknown.withColumn("unknown", F.lit(True)))


@query("SELECT doc_id, CASE WHEN lang <> 'fr' THEN text END AS text FROM documents")
def decoded_text(spark, sf_dir):
    """French texts get a stray byte, so they cannot be decoded."""
    raw = F.encode("text", "UTF-8")
    broken = F.concat(raw, F.unhex(F.lit("FF")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", decode_text(F.when(F.col("lang") == "fr", broken).otherwise(raw)).alias("text")
    )


@query("SELECT doc_id, TRUE AS own_id, TRUE AS version_4, TRUE AS in_time FROM documents")
def stamped_rows(spark, sf_dir):
    """Fresh ids differ and have the form of random ones; times are those of the run."""
    stamped = cut_lineage(table(spark, sf_dir, "documents").select("doc_id", *stamp_columns()))
    shared = stamped.groupBy("id").agg(F.count("*").alias("n"))
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("created_at", "yyyy-MM-dd HH:mm:ss")
    return stamped.join(shared, "id").select(
        "doc_id",
        (F.col("n") == 1).alias("own_id"),
        F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("version_4"),
        age.between(-5, 3600).alias("in_time"),
    )


@query(
    """SELECT part.p_partkey AS p_partkey, regexp_matches(p_type, '^(SMALL|[A-Z]* BRUSHED|PROMO.*STEEL)') OR starts_with(p_type, 'LARGE')
  AS trained FROM part"""
)
def trained_modules(spark, sf_dir):
    """Names that begin with one of several patterns."""
    patterns = ["SMALL", "[A-Z]* BRUSHED", "PROMO.*STEEL", "LARGE"]
    return table(spark, sf_dir, "part").select("p_partkey", matches_any("p_type", patterns).alias("trained"))


_STEP_SAMPLES = """(SELECT o_orderkey AS episode_id, o_custkey AS step_idx, p_name AS instruction
  FROM orders JOIN part ON p_partkey = o_custkey % 100 + 1)"""


@query(
    "WITH" + POOL_SQL + "," + _drawn_sql(f"'{SEED}:' || e.episode_id || ':' || e.step_idx", _STEP_SAMPLES) + " SELECT * FROM drawn"
)
def variant_draw_steps(spark, sf_dir):
    """A draw for every sample, by episode and step, instead of one for the episode."""
    names = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("instruction"))
    samples = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("step_idx"), (F.col("o_custkey") % 100).alias("k")
    )
    pool = merge_pool(derived_variants(spark, sf_dir))
    drawn = draw_variant(samples.join(names, "k").drop("k"), pool, SEED, ["episode_id", "step_idx"])
    return drawn.drop("step_idx")


@query(
    """SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('3:' || doc_id), 1, 15))::BIGINT, doc_id)
  AS shuffled_pos FROM documents"""
)
def shuffle_epoch(spark, sf_dir):
    return shuffle_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3)
