"""Lookups, resume, ordinals, enrichment and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.functions.hashing import shard_of
from varlake.operators import enrich as X
from varlake.operators import keyed as K
from varlake.operators.lookups import lookup_text, lookup_with_suffix
from varlake.operators.segments import chunk_ids as chunks
from varlake.operators.segments import split_ids, with_ordinal
from varlake.operators.variants import first_instruction_long
from varlake.plans.registry import query, table
from varlake.session import cut_lineage

# --- lookups ------------------------------------------------------------------------------


@query(
    """SELECT c.c_custkey AS task, coalesce(o.t, c.c_mktsegment) AS new_instruction FROM customer c
LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS t FROM orders GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey"""
)
def text_lookup_default(spark, sf_dir):
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.col("c_mktsegment").alias("language"))
    texts = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("new_instruction")
    )
    return lookup_text(tasks, texts).select("task", "new_instruction")


def _keyed_docs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    keys = table(spark, sf_dir, "documents").select("doc_id", name.alias("key"))
    suffix = F.when(F.col("toxic") == 1, F.lit("_no_noops")).otherwise(F.lit(""))
    return keys, table(spark, sf_dir, "labels").select(F.concat(name, suffix).alias("key"))


_FALLBACK_SQL = """WITH k AS (
  SELECT d.doc_id, 'doc_' || d.doc_id AS key,
         'doc_' || l.doc_id || CASE WHEN toxic = 1 THEN '_no_noops' ELSE '' END AS stats_key
  FROM documents d LEFT JOIN labels l USING (doc_id)) """


@query(_FALLBACK_SQL + "SELECT doc_id, key, stats_key FROM k WHERE stats_key IS NOT NULL")
def stats_key_fallback(spark, sf_dir):
    return lookup_with_suffix(*_keyed_docs(spark, sf_dir))[0]


@query(_FALLBACK_SQL + "SELECT doc_id, key FROM k WHERE stats_key IS NULL")
def stats_key_missing(spark, sf_dir):
    return lookup_with_suffix(*_keyed_docs(spark, sf_dir))[1]


# --- resume ---------------------------------------------------------------------------------


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, lang, source, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def resume_remaining(spark, sf_dir):
    return X.remaining(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents SEMI JOIN labels USING (doc_id)")
def resume_done(spark, sf_dir):
    return X.already_done(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


@query(
    """SELECT doc_id, quality, NULL AS lang FROM labels
UNION ALL SELECT doc_id, NULL, lang FROM documents ANTI JOIN labels USING (doc_id)"""
)
def outputs_union(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    new = X.remaining(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, "doc_id")
    return X.append_outputs(labels, new)


@query("SELECT conv_id, arg_min(role, turn) AS instruction FROM conversations GROUP BY conv_id")
def first_step(spark, sf_dir):
    return first_instruction_long(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")[0]


# --- ordinals ---------------------------------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents")
def stable_ordinals(spark, sf_dir):
    return with_ordinal(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS ordinal FROM events")
def time_ordinals(spark, sf_dir):
    return with_ordinal(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", ties=("event_id",)).drop("ts")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 80 AS chunk FROM documents")
def chunk_ids(spark, sf_dir):
    return chunks(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, (ntile(7) OVER (ORDER BY doc_id) - 1)::INT AS part FROM documents")
def split_parts(spark, sf_dir):
    return split_ids(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


# --- enrichment ---------------------------------------------------------------------------------


def _stub(row: dict) -> list[dict]:
    """Stands in for a model: two outputs per input."""
    return [
        {"doc_id": row["doc_id"], "k": 0, "content": row["lang"].upper()},
        {"doc_id": row["doc_id"], "k": 1, "content": f"{row['source'][::-1]} {len(row['text'])}"},
    ]


_STUB_SCHEMA = "doc_id LONG, k INT, content STRING"
_STUB_SQL = """SELECT doc_id, 0 AS k, upper(lang) AS content FROM documents
UNION ALL SELECT doc_id, 1, reverse(source) || ' ' || length(text) FROM documents"""


@query(_STUB_SQL)
def enrich_stub(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return X.map_batches(docs, _stub, _STUB_SCHEMA, key="doc_id", concurrency=4)


@query(
    """SELECT doc_id, 9007199254740993 + doc_id AS big, CASE WHEN lang <> 'fr' THEN 9007199254740993 + n_chars END AS maybe
FROM documents"""
)
def enrich_nullable_long(spark, sf_dir):
    """Longs beyond 2**53, some of them null, come through a call unchanged."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.lit(9007199254740993) + F.col("doc_id")).alias("big"),
        F.when(F.col("lang") != "fr", F.lit(9007199254740993) + F.col("n_chars")).alias("maybe"),
    )
    return X.map_batches(docs, lambda r: [r], "doc_id LONG, big LONG, maybe LONG", key="doc_id")


def _picky(row: dict) -> list[dict]:
    if row["lang"] == "fr":
        raise ValueError("no French")
    return [{"doc_id": row["doc_id"], "content": row["lang"].upper()}]


@query(
    """SELECT doc_id, CASE WHEN lang <> 'fr' THEN upper(lang) END AS content,
  CASE WHEN lang = 'fr' THEN 'ValueError: no French' END AS error FROM documents"""
)
def enrich_errors(spark, sf_dir):
    """Failing calls stay as rows with their error; chunks of one isolate them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return X.map_batches(
        docs, _picky, "doc_id LONG, content STRING", key="doc_id", chunk=1, tries=2, on_error="keep"
    )


def _client(prompt: str, rnd: int) -> str:
    """Answers in JSON, but long prompts need a second try and very long ones never work."""
    n = len(prompt)
    if n > 9000 or (n > 3000 and rnd < 2):
        return "Sure! Here you go."
    return f'{{"RAW": "{n}", "REVISED": ["round {rnd}"]}}'


_ROUNDS_SQL = """WITH d AS (SELECT doc_id, length(text) AS n FROM documents)
SELECT doc_id, n::VARCHAR AS raw, 'round ' || CASE WHEN n > 3000 THEN 2 ELSE 1 END AS revised,
  CASE WHEN n > 3000 THEN 2 ELSE 1 END AS round FROM d WHERE n <= 9000
UNION ALL SELECT doc_id, NULL, 'Sure! Here you go.', NULL FROM d WHERE n > 9000"""


@query(_ROUNDS_SQL)
def rerequest_rounds(spark, sf_dir):
    prompts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    good, failed = X.rephrase_until_parsed(prompts, _client, key="doc_id", max_rounds=3, concurrency=4)
    return good.withColumn("revised", F.array_join("revised", "|")).unionByName(
        failed.withColumnRenamed("content", "revised"), allowMissingColumns=True
    )


@query("SELECT doc_id, lang, upper(lang) AS content FROM documents")
def response_join(spark, sf_dir):
    """Responses come back in hash order and are paired by id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    responses = X.map_batches(
        docs, lambda r: [{"doc_id": r["doc_id"], "content": r["lang"].upper()}],
        "doc_id LONG, content STRING", key="doc_id", concurrency=4,
    )
    return X.join_responses(docs, cut_lineage(responses), "doc_id")


# --- keyed tables --------------------------------------------------------------------------------


def _base(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(0).cast("bigint").alias("seq")
    )


def _changes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 2).alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq")
    )


_KEYED_SQL = """WITH base AS (SELECT c_custkey AS key, c_mktsegment AS value, 0::BIGINT AS seq FROM customer),
changes AS (SELECT o_custkey * 2 AS key, o_orderpriority AS value, o_orderkey AS seq FROM orders) """


@query(
    _KEYED_SQL + """, u AS (SELECT *, 0 AS new FROM base UNION ALL SELECT *, 1 FROM changes)
SELECT key, value, seq FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY new DESC, seq DESC) = 1"""
)
def keyed_upsert(spark, sf_dir):
    return K.upsert(_base(spark, sf_dir), _changes(spark, sf_dir))


@query(_KEYED_SQL + "SELECT key, value, seq FROM base ANTI JOIN changes USING (key)")
def keyed_delete(spark, sf_dir):
    return K.delete(_base(spark, sf_dir), _changes(spark, sf_dir))


@query(
    _KEYED_SQL + "SELECT DISTINCT key, key IN (SELECT key FROM base) AS existed FROM changes"
)
def keyed_existed(spark, sf_dir):
    return K.existed(_base(spark, sf_dir), _changes(spark, sf_dir))


@query(_KEYED_SQL + "SELECT c.key, c.seq AS asked, b.value FROM changes c LEFT JOIN base b USING (key)")
def keyed_get(spark, sf_dir):
    wanted = _changes(spark, sf_dir).select("key", F.col("seq").alias("asked"))
    return K.get(_base(spark, sf_dir), wanted).select("key", "asked", "value")


@query(_KEYED_SQL + "SELECT DISTINCT key FROM changes")
def keyed_keys(spark, sf_dir):
    return K.keys(_changes(spark, sf_dir))


@query(_KEYED_SQL + "SELECT key, value, seq FROM base")
def keyed_items(spark, sf_dir):
    return K.items(_base(spark, sf_dir))


def _shards(spark, sf_dir) -> list[DataFrame]:
    c = table(spark, sf_dir, "customer")
    row = lambda df, v: df.select(
        F.col("c_custkey").alias("key"), v.alias("value"), F.col("c_nationkey").cast("bigint").alias("seq")
    )
    return [
        row(c, F.col("c_name")),
        row(c.where("c_acctbal > 0"), F.col("c_mktsegment")),
        row(c.where("c_acctbal > 4000"), F.lower("c_mktsegment")),
        row(c.where("c_nationkey > 20"), F.lit("far")),
    ]


_SHARDS_SQL = """WITH s AS (
  SELECT c_custkey AS key, c_name AS value, c_nationkey::BIGINT AS seq, 0 AS shard FROM customer
  UNION ALL SELECT c_custkey, c_mktsegment, c_nationkey, 1 FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT c_custkey, lower(c_mktsegment), c_nationkey, 2 FROM customer WHERE c_acctbal > 4000
  UNION ALL SELECT c_custkey, 'far', c_nationkey, 3 FROM customer WHERE c_nationkey > 20) """


@query(_SHARDS_SQL + "SELECT key, value, seq FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY shard DESC) = 1")
def shards_merged(spark, sf_dir):
    return K.merge_shards(*_shards(spark, sf_dir))


@query(_SHARDS_SQL + "SELECT DISTINCT key FROM s")
def distinct_keys(spark, sf_dir):
    return K.distinct_keys(*_shards(spark, sf_dir))


@query("SELECT doc_id, (('0x' || md5(doc_id::VARCHAR))::UHUGEINT % 97)::INT AS shard FROM documents")
def shard_assign(spark, sf_dir):
    return K.with_shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 97)


@query(
    """SELECT (('0x' || md5(text))::UHUGEINT % 1000003)::INT AS shard, count(*) AS n FROM documents GROUP BY 1"""
)
def shard_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(shard_of("text", 1_000_003).alias("shard"))
    return docs.groupBy("shard").agg(F.count("*").alias("n"))
