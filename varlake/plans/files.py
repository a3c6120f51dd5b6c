"""Round trips through every source and sink, and the streams.

All files go to fresh folders below the shared folder of the session.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.functions.text import task_to_sentence
from varlake.operators.enrich import rephrase_until_parsed, reply_variants, revise_texts
from varlake.operators.keyed import get_one, write_shards
from varlake.operators.keyed_store import KeyedStore
from varlake.operators.ledger import enrich_stored, read_outputs
from varlake.operators.lookups import render_prompts
from varlake.functions.hashing import SHUFFLE_KEY_BITS, shuffle_key
from varlake.operators.segments import with_hash_ordinal, with_ordinal
from varlake.operators.variants import episodes_per_instruction, first_instruction, merge_pool, nest_steps, rewrite_instructions
from varlake.plans.episodes import POOL_SQL, SEED, STEPS_SQL, VARIANTS_SQL, _drawn_sql, derived_variants, numbered_steps
from varlake.plans.registry import query, table
from varlake.plans.rollouts import EPISODES_SQL, rollout_events
from varlake.plans.tables import _KEYED_SQL, _STUB_SCHEMA, _STUB_SQL, _base, _changes, _stub
from varlake.session import scratch_path
from varlake.sources import files as S
from varlake.sources.episodes import explode_steps, read_episode_shards, read_episodes, write_episode_shards
from varlake.streaming import streams as T

# --- JSON ------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey::VARCHAR AS key, p_name AS value FROM part")
def source_map_roundtrip(spark, sf_dir):
    """An instruction map, its places included, as one document and as one per 5,000 entries."""
    part = with_ordinal(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    rows = part.select((F.col("ordinal") - 1).alias("o"), F.col("p_partkey").cast("string").alias("k"), "p_name")
    whole, parts = scratch_path(spark, "map"), scratch_path(spark, "maps")
    S.write_json_map(rows, whole, "k", "p_name", "o")
    S.write_json_map(S.read_json_map(spark, whole), parts, "key", "value", "pos", chunk=5_000)
    return S.read_json_map(spark, parts).select("pos", "key", "value")


_DOCS_SQL = """WITH e AS (SELECT p_partkey // 50 AS block, p_partkey, 'k' || p_partkey % 20 AS key, p_name AS value FROM part),
d AS (SELECT block, key, min(p_partkey) AS first_key, arg_max(value, p_partkey) AS value FROM e GROUP BY block, key) """


def _blocks_of_parts(spark, sf_dir) -> str:
    """A JSON object per 50 parts, its keys repeated; every seventh is cut short."""
    entry = F.concat(F.to_json(F.array(F.concat(F.lit("k"), F.col("p_partkey") % 20))), F.lit(": "), F.to_json(F.array("p_name")))
    entry = F.regexp_replace(entry, r"^\[(.*)\]: \[(.*)\]$", "$1: $2")
    part = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).cast("bigint").alias("block"), "p_partkey", entry.alias("e"))
    listed = part.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "e")))["e"].alias("e"))
    text = F.concat(F.lit("{"), F.array_join("e", ",\n"), F.when(F.col("block") % 7 == 3, F.lit("")).otherwise(F.lit("}")))
    path = scratch_path(spark, "blocks")
    listed.select("block", text.alias("value")).repartition("block").write.partitionBy("block").text(path)
    return path


def _block(path: str):
    return F.regexp_extract(path, r"/block=(\d+)/", 1).cast("bigint").alias("block")


@query(
    _DOCS_SQL + """SELECT block, row_number() OVER (PARTITION BY block ORDER BY first_key) - 1 AS pos, key, value FROM d WHERE block % 7 <> 3"""
)
def source_map_repeats(spark, sf_dir):
    """Repeated keys: the last value, at the first place; broken documents contribute nothing."""
    return S.read_json_map(spark, _blocks_of_parts(spark, sf_dir)).select(_block("path"), "pos", "key", "value")


@query("SELECT DISTINCT p_partkey // 50 AS block FROM part WHERE p_partkey // 50 % 7 = 3")
def source_map_broken(spark, sf_dir):
    return S.bad_documents(spark, _blocks_of_parts(spark, sf_dir)).select(_block("path"))


@query(
    "WITH" + VARIANTS_SQL + """, n AS (SELECT instruction, row_number() OVER (ORDER BY substr(md5('0:' || instruction), 1, 15), instruction) - 1 AS ord
  FROM (SELECT DISTINCT instruction FROM variants))
SELECT 'parts' AS suite, scope, ord, instruction, pos::BIGINT AS pos, variant FROM variants JOIN n USING (instruction)"""
)
def source_variants_roundtrip(spark, sf_dir):
    """Variant files, one per scope and suite, written and found again by name, in order."""
    variants = derived_variants(spark, sf_dir)
    names = variants.select("instruction").distinct()
    numbered = with_hash_ordinal(names, shuffle_key(0, "instruction"), SHUFFLE_KEY_BITS, "o", ("instruction",))
    rows = variants.join(numbered, "instruction").withColumns({"suite": F.lit("parts"), "ord": F.col("o") - 1})
    path = scratch_path(spark, "variants")
    S.write_variants(rows, path)
    return S.read_variants(spark, path, strict=True).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    """SELECT s_suppkey, s_name AS task, coalesce(CASE WHEN s_acctbal >= 0 THEN lower(s_name) END, s_name) AS instruction
FROM supplier"""
)
def source_records_drift(spark, sf_dir):
    """Record files with and without the optional field, read under one schema."""
    s = table(spark, sf_dir, "supplier")
    path = scratch_path(spark, "records")
    full = s.where("s_acctbal >= 0").select("s_suppkey", F.col("s_name").alias("task"), F.lower("s_name").alias("instruction"))
    S.write_records(full, path, order_by=["s_suppkey"])
    S.append_jsonl(s.where("s_acctbal < 0").select("s_suppkey", F.col("s_name").alias("task")), path)
    rows = spark.read.schema("s_suppkey LONG, task STRING, instruction STRING").json(path)
    return rows.withColumn("instruction", F.coalesce("instruction", "task"))


@query("SELECT s_suppkey, s_name AS task, s_nationkey FROM supplier")
def source_record_lists(spark, sf_dir):
    """The same records as JSON lists, a bounded number to a file."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("task"), "s_nationkey")
    path = scratch_path(spark, "lists")
    S.write_record_lists(s, path, "s_suppkey", chunk=400)
    return S.read_records(spark, path, "s_suppkey LONG, task STRING, s_nationkey INT")


def _jsonl(spark, sf_dir) -> str:
    """Files of 5,000 events each; an error with k = 7 leaves a broken line, one with k = 8 a null."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k INT")["k"]
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    bad = F.col("event_type") == "error"
    line = F.when(bad & (k == 7), F.concat(line, F.lit(" #"))).when(bad & (k == 8), F.lit("null")).otherwise(line)
    path = scratch_path(spark, "jsonl")
    block = F.floor(F.col("event_id") / 5000).cast("bigint").alias("block")
    rows = e.select(block, "event_id", line.alias("value"))
    (
        rows.repartition("block").sortWithinPartitions("block", "event_id").select("block", "value")
        .write.partitionBy("block").text(path)
    )
    return path


_JSONL_SQL = """WITH e AS (
  SELECT event_id, user_id, event_type, event_id // 5000 AS block,
         event_type = 'error' AND regexp_extract(props, '[0-9]+')::INT IN (7, 8) AS bad,
         CASE WHEN regexp_extract(props, '[0-9]+')::INT = 8 THEN 'null' ELSE
           '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"} #' END AS line
  FROM events) """
_EVENT = "event_id LONG, user_id LONG, event_type STRING"


@query(_JSONL_SQL + "SELECT event_id, user_id, event_type FROM e WHERE NOT bad")
def jsonl_quarantine(spark, sf_dir):
    good, _ = S.read_jsonl(spark, f"{_jsonl(spark, sf_dir)}/*", _EVENT)
    return good.select("event_id", "user_id", "event_type")


@query(_JSONL_SQL + "SELECT line FROM e WHERE bad")
def jsonl_bad_lines(spark, sf_dir):
    return S.read_jsonl(spark, f"{_jsonl(spark, sf_dir)}/*", _EVENT)[1].select("line")


@query(
    _JSONL_SQL + """, f AS (SELECT block, min(event_id) FILTER (WHERE bad) AS cut FROM e GROUP BY block)
SELECT event_id, user_id, event_type FROM e JOIN f USING (block) WHERE cut IS NULL OR event_id < cut"""
)
def jsonl_prefix(spark, sf_dir):
    good, _ = S.read_jsonl(spark, f"{_jsonl(spark, sf_dir)}/*", _EVENT, on_error="prefix")
    return good.select("event_id", "user_id", "event_type")


@query("SELECT count(*) AS n FROM events")
def jsonl_record_count(spark, sf_dir):
    """Events appended in two batches and counted."""
    e = table(spark, sf_dir, "events")
    path = scratch_path(spark, "counted")
    S.overwrite_jsonl(e.where("user_id % 2 = 0"), path)
    S.append_jsonl(e.where("user_id % 2 <> 0"), path)
    return spark.range(1).select(F.lit(S.record_count(spark.read.schema("event_id LONG").json(path))).cast("bigint").alias("n"))


@query("SELECT doc_id, lang, (ntile(7) OVER (ORDER BY doc_id) - 1)::INT AS part FROM documents")
def split_files(spark, sf_dir):
    path = scratch_path(spark, "split")
    S.split_write(table(spark, sf_dir, "documents").select("doc_id", "lang"), 7, "doc_id", path)
    return spark.read.schema("doc_id LONG, lang STRING, part INT").json(path)


@query(
    """SELECT 'tasks' AS suite, 'one' AS scope, replace(s_name, '#', '_') AS task, replace(replace(s_name, '#', '_'), '_', ' ') AS instruction,
  'say ' || upper(replace(replace(s_name, '#', '_'), '_', ' ')) AS new_instruction FROM supplier"""
)
def revised_tasks(spark, sf_dir):
    """Evaluation texts end to end: task, sentence, prompt, answer, file, and back."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.replace(F.col("s_name"), F.lit("#"), F.lit("_")).alias("task"))
    tasks = s.withColumn("instruction", task_to_sentence("task"))
    revised = revise_texts(tasks, _say, "reword: {sentence}", concurrency=4)
    base = scratch_path(spark, "texts")
    S.write_eval_texts(revised, f"{base}/tasks/one/instruction.json", "s_suppkey")
    return S.read_eval_texts(spark, f"{base}/tasks/one/instruction.json")


def _say(prompt: str) -> str:
    return "say " + prompt.removeprefix("reword: ").upper()


def _reword(prompt: str, rnd: int) -> str:
    """A stand-in model: two versions in JSON, after one refusal for every third length."""
    scope, sentence = prompt.split("|", 1)
    if len(sentence) % 3 == 0 and rnd == 1:
        return "I would rather not."
    return json.dumps({"RAW": sentence, "REVISED": [f"{scope} {sentence}", f"{sentence} {scope}"]})


@query(
    """WITH n AS (SELECT DISTINCT p_name AS instruction FROM part),
s AS (SELECT * FROM (VALUES ('one', 0), ('two', 1), ('all', 2)) t(scope, k)),
v AS (SELECT instruction, k * 2 AS idx, scope || ' ' || instruction AS variant FROM n, s
      UNION ALL SELECT instruction, k * 2 + 1, instruction || ' ' || scope FROM n, s)
SELECT instruction, idx::BIGINT AS idx, 6::BIGINT AS n, variant FROM v"""
)
def generated_pool(spark, sf_dir):
    """Pools end to end: names, prompts, answers with re-requests, variant files, merge."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("instruction")).distinct()
    templates = {scope: scope + "|{sentence}" for scope in ("one", "two", "all")}
    asked = render_prompts(names, templates).withColumn("request_id", F.concat_ws("|", "scope", "instruction"))
    good, _ = rephrase_until_parsed(asked, _reword, concurrency=4)
    variants = reply_variants(asked.select("request_id", "scope", "instruction"), good)
    path = scratch_path(spark, "pool")
    numbered = with_hash_ordinal(names, shuffle_key(0, "instruction"), SHUFFLE_KEY_BITS, "o", ("instruction",))
    rows = variants.join(numbered, "instruction").withColumns({"suite": F.lit("parts"), "ord": F.col("o") - 1})
    S.write_variants(rows, path)
    return merge_pool(S.read_variants(spark, path, strict=True))


# --- episodes and images -----------------------------------------------------------------------


def _nested_episodes(spark, sf_dir) -> DataFrame:
    """Episodes in the fixed schema, one record each."""
    f = lambda c: F.col(c).cast("float")
    raw = F.encode(F.concat(F.col("episode_id").cast("string"), F.lit("/"), F.col("step_idx").cast("string")), "UTF-8")
    step = F.struct(
        F.array(f("quantity"), f("price")).alias("action"),
        f("discount").alias("discount"),
        (F.col("step_idx") == 1).alias("is_first"),
        F.lit(False).alias("is_last"),
        F.lit(False).alias("is_terminal"),
        F.col("language_instruction"),
        f("tax").alias("reward"),
        F.struct(
            raw.alias("image"), raw.alias("wrist_image"), F.array(f("quantity")).alias("joint_state"),
            F.array(f("tax"), f("discount")).alias("state"),
        ).alias("observation"),
    )
    nested = nest_steps(numbered_steps(spark, sf_dir).withColumn("step", step), "episode_id", "step_idx", ["step"], block=None)
    name = F.concat_ws("-", F.lit("ep"), F.col("episode_id").cast("string"))
    return nested.select("episode_id", name.alias("file_path"), F.col("steps.step").alias("steps"))


def _flat(episodes: DataFrame) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return explode_steps(episodes, "file_path").select(
        F.split("file_path", "-")[1].cast("bigint").alias("episode_id"),
        F.col("step_idx").cast("bigint").alias("step_idx"),
        "language_instruction",
        "is_first",
        F.col("action")[0].cast("double").alias("quantity"),
        F.col("action")[1].cast("double").alias("price"),
        F.col("observation.state")[1].cast("double").alias("discount"),
        d("reward").alias("tax"),
        F.decode("observation.image", "UTF-8").alias("image"),
    )


_FLAT_SQL = "WITH" + STEPS_SQL + """
SELECT episode_id, step_idx - 1 AS step_idx, language_instruction, step_idx = 1 AS is_first, quantity,
       price::FLOAT::DOUBLE AS price, discount::FLOAT::DOUBLE AS discount, tax::FLOAT::DOUBLE AS tax,
       episode_id || '/' || step_idx AS image FROM steps"""


@query(_FLAT_SQL)
def episodes_parquet(spark, sf_dir):
    path = scratch_path(spark, "episodes")
    _nested_episodes(spark, sf_dir).write.parquet(path)
    return _flat(read_episodes(spark, path))


@query(
    "WITH" + STEPS_SQL + "," + POOL_SQL + """,
firsts AS (SELECT episode_id, arg_min(language_instruction, step_idx) AS instruction FROM steps GROUP BY episode_id),"""
    + _drawn_sql(f"'{SEED}:' || e.episode_id", "firsts")
    + """
SELECT s.episode_id, step_idx - 1 AS step_idx, d.new_instruction AS language_instruction, step_idx = 1 AS is_first, quantity,
       price::FLOAT::DOUBLE AS price, discount::FLOAT::DOUBLE AS discount, tax::FLOAT::DOUBLE AS tax,
       s.episode_id || '/' || step_idx AS image FROM steps s JOIN drawn d USING (episode_id)"""
)
def rewrite_stored(spark, sf_dir):
    """The main job end to end: stored episodes with all features, rewritten, stored, and read again."""
    path, out = scratch_path(spark, "episodes"), scratch_path(spark, "rewritten")
    _nested_episodes(spark, sf_dir).write.parquet(path)
    good, _ = rewrite_instructions(read_episodes(spark, path), merge_pool(derived_variants(spark, sf_dir)), SEED)
    good.write.parquet(out)
    return _flat(read_episodes(spark, out))


@query(
    """WITH i AS (
  SELECT p_name AS instruction, p_partkey AS key, min(p_partkey) OVER (PARTITION BY p_name) AS first_ord,
         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS pos
  FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem))
SELECT instruction, dense_rank() OVER (ORDER BY first_ord) - 1 AS ord, pos, key FROM i"""
)
def index_roundtrip(spark, sf_dir):
    """Extract, group, export as JSON, and read back: instructions and the episodes that have them."""
    path, out = scratch_path(spark, "episodes"), scratch_path(spark, "index")
    _nested_episodes(spark, sf_dir).write.parquet(path)
    good, _ = first_instruction(read_episodes(spark, path))
    S.write_index(episodes_per_instruction(good, "episode_id", "episode_id"), out)
    return S.read_index(spark, out).withColumn("pos", F.col("pos").cast("bigint"))


@query(_FLAT_SQL)
def shard_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "shards")
    write_episode_shards(_nested_episodes(spark, sf_dir), path, shards=spark.sparkContext.defaultParallelism)
    good, _ = read_episode_shards(spark, path)
    return _flat(good)


@query(
    """WITH f AS (SELECT page_id // 50 AS block, string_agg(html || chr(10), '' ORDER BY page_id) AS content FROM pages GROUP BY 1)
SELECT block, md5(base64(encode(content))) AS data_md5, octet_length(encode(content)) AS n FROM f"""
)
def image_scan(spark, sf_dir):
    """Files of 50 pages each, read back as bytes."""
    path = scratch_path(spark, "images")
    block = F.floor(F.col("page_id") / 50).cast("bigint").alias("block")
    pages = table(spark, sf_dir, "pages").select(block, "page_id", F.col("html").alias("value"))
    (
        pages.repartition("block").sortWithinPartitions("block", "page_id").select("block", "value")
        .write.partitionBy("block").text(path)
    )
    images = S.read_images(spark, path, "*.txt")
    return images.select(
        F.regexp_extract("path", r"block=(\d+)", 1).cast("bigint").alias("block"),
        F.md5(F.regexp_replace(F.base64("content"), r"\s", "")).alias("data_md5"),
        F.octet_length("content").cast("bigint").alias("n"),
    )


@query("SELECT doc_id AS key, lang, (('0x' || md5(doc_id::VARCHAR))::UHUGEINT % 16)::INT AS shard FROM documents")
def shard_table(spark, sf_dir):
    """A table partitioned by shard; single keys are looked up in one folder of it."""
    path = scratch_path(spark, "keyed")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang")
    write_shards(docs, path, "key", 16)
    return spark.read.parquet(path)


@query("SELECT doc_id AS key, lang FROM documents WHERE doc_id = 77")
def keyed_get_pruned(spark, sf_dir):
    return get_one(shard_table(spark, sf_dir), 77, 16).select("key", "lang")


def _stored_customers(spark, sf_dir) -> KeyedStore:
    return KeyedStore.create(_base(spark, sf_dir), scratch_path(spark, "keyed-store"), "key", 32)


@query(
    _KEYED_SQL + """, u AS (SELECT *, 0 AS new FROM base UNION ALL SELECT *, 1 FROM changes),
v AS (SELECT key, value, seq FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY new DESC, seq DESC) = 1)
SELECT * FROM v WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
)
def keyed_merge_stored(spark, sf_dir):
    """Two changes to a stored table: an upsert of all orders, and a delete."""
    store = _stored_customers(spark, sf_dir)
    store.upsert(_changes(spark, sf_dir))
    store.delete(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key")))
    return store.read()


@query(_KEYED_SQL + "SELECT key, value, seq FROM base")
def keyed_old_version(spark, sf_dir):
    """What the first version held, read after a change."""
    store = _stored_customers(spark, sf_dir)
    store.upsert(_changes(spark, sf_dir))
    return store.read(version=1)


@query(
    _KEYED_SQL + "SELECT s_suppkey AS asked, s_suppkey * 3 AS key, value, seq FROM supplier LEFT JOIN base ON base.key = s_suppkey * 3"
)
def keyed_get_many(spark, sf_dir):
    """Many keys at once, from the files that can hold them."""
    store = _stored_customers(spark, sf_dir)
    return store.get(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asked"), (F.col("s_suppkey") * 3).alias("key")))


# --- calls that store as they go ------------------------------------------------------------------


def _refuses_french(row: dict) -> list[dict]:
    if row["lang"] == "fr":
        raise ValueError("stopped halfway")
    return _stub(row)


@query(_STUB_SQL)
def enrich_resume(spark, sf_dir):
    """A run that fails on the way; the second one calls only what the first has not stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    store = scratch_path(spark, "ledger")
    try:
        enrich_stored(docs, _refuses_french, _STUB_SCHEMA, store, buckets=16, chunk=8)
    except Exception as e:  # noqa: BLE001
        if "stopped halfway" not in str(e):
            raise
    enrich_stored(docs, _stub, _STUB_SCHEMA, store)
    return read_outputs(spark, store, _STUB_SCHEMA)


# --- streams -----------------------------------------------------------------------------------------


@query(
    "WITH" + EPISODES_SQL + """ SELECT run_id, task_name, count(*) AS num_episodes, sum(success::INT)::BIGINT AS num_successes
FROM ep GROUP BY run_id, task_name"""
)
def stream_success(spark, sf_dir):
    base = scratch_path(spark, "stream-success")
    rows = rollout_events(spark, sf_dir).select("run_id", "task_name", "success")
    rows.write.json(f"{base}/in")
    live = T.stream_success(T.stream_jsonl(spark, f"{base}/in", "run_id STRING, task_name STRING, success BOOLEAN", maxFilesPerTrigger=4))
    T.write_changes(live, f"{base}/out", f"{base}/ckpt", ["run_id", "task_name"]).awaitTermination()
    return T.latest(spark, f"{base}/out", ["run_id", "task_name"])


@query(_STUB_SQL)
def stream_enrich(spark, sf_dir):
    """Two runs over a growing folder; the second repeats half of the inputs."""
    base = scratch_path(spark, "stream-enrich")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    schema = "doc_id LONG, lang STRING, source STRING, text STRING"
    for wave in (docs.where("lang IN ('en', 'fr')"), docs.where("lang <> 'en'")):
        wave.write.mode("append").json(f"{base}/in")
        inputs = T.stream_jsonl(spark, f"{base}/in", schema)
        T.stream_enrich(inputs, _stub, _STUB_SCHEMA, f"{base}/out", f"{base}/ckpt", key="doc_id").awaitTermination()
    return T.read_sink(spark, f"{base}/out").drop("batch_id")


@query(
    "WITH" + EPISODES_SQL + """ SELECT run_id, task_name, count(*) AS num_episodes, sum(success::INT)::BIGINT AS num_successes
FROM ep GROUP BY run_id, task_name"""
)
def stream_success_restart(spark, sf_dir):
    """The second wave of rollouts is counted under a fresh checkpoint, over the same sink."""
    base = scratch_path(spark, "stream-success-restart")
    rows = rollout_events(spark, sf_dir).select("run_id", "task_name", "success")
    first = F.pmod(F.xxhash64("run_id", "task_name", "success"), F.lit(2)) == 0
    for k, wave in enumerate((rows.where(first), rows.where(~first))):
        wave.write.mode("append").json(f"{base}/in")
        live = T.stream_success(T.stream_jsonl(spark, f"{base}/in", "run_id STRING, task_name STRING, success BOOLEAN"))
        T.write_changes(live, f"{base}/out", f"{base}/ckpt-{k}", ["run_id", "task_name"]).awaitTermination()
    return T.latest(spark, f"{base}/out", ["run_id", "task_name"])


@query(_STUB_SQL)
def stream_enrich_restart(spark, sf_dir):
    """Two waves of inputs, each under a checkpoint of its own, into one sink."""
    base = scratch_path(spark, "stream-enrich-restart")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    for k, wave in enumerate((docs.where(first), docs.where(~first))):
        wave.write.mode("append").json(f"{base}/in")
        inputs = T.stream_jsonl(spark, f"{base}/in", "doc_id LONG, lang STRING, source STRING, text STRING")
        T.stream_enrich(inputs, _stub, _STUB_SCHEMA, f"{base}/out", f"{base}/ckpt-{k}", key="doc_id").awaitTermination()
    return T.read_sink(spark, f"{base}/out").drop("batch_id")


@query("SELECT event_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    """Every error arrives twice; each event comes out once."""
    base = scratch_path(spark, "stream-dedupe")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    e.unionByName(e.where("event_type = 'error'")).write.json(f"{base}/in")
    rows = T.stream_jsonl(spark, f"{base}/in", "event_id LONG, event_type STRING, ts STRING")
    once = T.stream_dedupe(rows, "event_id").select("event_id", "event_type")
    T.write_rows(once, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.schema("event_id LONG, event_type STRING").parquet(f"{base}/out")


@query("SELECT event_id, event_type, value FROM events")
def stream_tail(spark, sf_dir):
    """Three drops of files with a restart after the second."""
    base = scratch_path(spark, "stream-tail")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    schema = "event_id LONG, event_type STRING, value DOUBLE"

    def drop(types: str) -> None:
        e.where(f"event_type IN ({types})").write.mode("append").json(f"{base}/in")

    def run() -> None:
        T.write_rows(T.stream_jsonl(spark, f"{base}/in", schema), f"{base}/out", f"{base}/ckpt").awaitTermination()

    drop("'view', 'click'")
    drop("'error'")
    run()
    drop("'signup', 'purchase'")
    run()
    return spark.read.schema(schema).parquet(f"{base}/out")
