"""Resumable enrichment through a function the caller supplies.

The only Python at scale is here: the call itself. What is already done is removed
by a join below the call, since no optimizer can push a filter through it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from varlake.fixed_values import CHUNK_SIZE
from varlake.functions.jsontext import revision
from varlake.operators.lookups import fill_template
from varlake.session import broadcast_checked, content_bytes, cut_lineage, scratch_path, ship_package

# Rows handed back to the JVM at a time.
OUTPUT_ROWS = 10_000
# Bytes of row content that one task of a bounded number is to read.
TASK_BYTES = 64 * 1024 * 1024


def remaining(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key is not done yet; repeated inputs stay repeated.

    ``distinct`` runs map-side first, so a key done a billion times travels once per task; the
    side is read once, and adaptive execution broadcasts it where it turns out small.
    """
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def already_done(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return inputs.join(done.select(key).distinct(), key, "left_semi")


def append_outputs(done: DataFrame, new: DataFrame) -> DataFrame:
    return done.unionByName(new, allowMissingColumns=True)


def join_responses(requests: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Pair by id; arrival order means nothing on a cluster."""
    return requests.join(responses, key, "left")


def _call(fn, rows: list[dict], tries: int, pause: float) -> list[dict]:
    """All outputs of one chunk; the last error is raised once the tries are used up."""
    for attempt in range(1, tries + 1):
        try:
            return [out for row in rows for out in fn(row)]
        except Exception:
            if attempt == tries:
                raise
            time.sleep(pause * attempt)
    return []


def map_batches(
    df: DataFrame,
    fn: Callable[[dict], list[dict]],
    schema: str | T.StructType,
    key: str | None = None,
    concurrency: int | None = None,
    chunk: int = CHUNK_SIZE,
    tries: int = 1,
    pause: float = 0.0,
    on_error: str = "fail",
) -> DataFrame:
    """``fn`` on every row, each giving any number of output rows, in retried chunks.

    ``concurrency`` bounds the tasks, hence the calls in flight; rows are then spread by
    ``key`` so that a retried task sees the same rows. What is measured to be more than
    ``TASK_BYTES`` for each of these tasks is called at once, job after job (:func:`_in_waves`),
    so an error that fails the job is raised here. With ``on_error='keep'`` a chunk
    that fails for good gives one row per input with its key and the ``error``; with
    ``'fail'`` it fails the job. Tasks can run twice: make ``fn`` safe to repeat. A row is a
    dict of plain Python values: a LONG stays an int, a null is None, a map is a dict.
    """
    if on_error not in ("fail", "keep"):
        raise ValueError("on_error is 'fail' or 'keep'")
    if on_error == "keep" and key is None:
        raise ValueError("keeping errors needs the key column")
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if on_error == "keep":
        out = T.StructType([*out.fields, T.StructField("error", T.StringType())])
    ship_package(df.sparkSession)
    arrow = to_arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[dict] = []
            for start in range(0, batch.num_rows, chunk):
                rows = batch.slice(start, chunk).to_pylist(maps_as_pydicts="strict")
                try:
                    result = _call(fn, rows, tries, pause)
                except Exception as e:  # noqa: BLE001
                    if on_error == "fail":
                        raise
                    result = [{key: r[key], "error": f"{type(e).__name__}: {e}"} for r in rows]
                done.extend(result)
                if len(done) >= OUTPUT_ROWS:
                    yield pa.RecordBatch.from_pylist(done, arrow)
                    done = []
            yield pa.RecordBatch.from_pylist(done, arrow)

    if not concurrency:
        return df.mapInArrow(work, out)
    waves = -(-content_bytes(df) // (TASK_BYTES * concurrency))
    if waves > 1:
        return _in_waves(df, work, out, concurrency, waves)
    return df.repartition(concurrency, *([key] if key else [])).mapInArrow(work, out)


def _in_waves(df: DataFrame, work: Callable, out: T.StructType, concurrency: int, waves: int) -> DataFrame:
    """``work`` on all rows by ``waves`` jobs, one after the other, of ``concurrency`` tasks each.

    The rows are stored first, in parts of equal numbers of rows whatever their keys, so a task
    reads the same share of any input and a retried one the same rows. Answers are stored too.
    """
    spark = df.sparkSession
    asked, answers = scratch_path(spark, "asked"), scratch_path(spark, "answers")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    dealt = rows.repartition(waves * concurrency).withColumn("wave", F.floor(F.spark_partition_id() / concurrency).cast("int"))
    dealt.write.partitionBy("wave").parquet(asked)
    parts = spark.read.schema(dealt.schema).parquet(asked)
    for wave in range(waves):
        part = parts.where(F.col("wave") == wave).select("row.*").coalesce(concurrency)
        part.mapInArrow(work, out).write.parquet(f"{answers}/{wave}")
    return spark.read.schema(out).parquet(*[f"{answers}/{wave}" for wave in range(waves)])


def rephrase(
    df: DataFrame,
    client: Callable[[str], str],
    key: str = "request_id",
    prompt: str = "prompt",
    concurrency: int | None = None,
    **kw,
) -> DataFrame:
    """(key, content): the client's answer to every prompt; rows without one are not sent."""
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("content", T.StringType())])

    def ask(row: dict) -> list[dict]:
        return [{key: row[key], "content": client(row[prompt])}]

    asked = df.where(F.col(prompt).isNotNull()).select(key, prompt)
    return map_batches(asked, ask, out, key=key, concurrency=concurrency, **kw)


def parse_response(df: DataFrame, column: str = "content") -> tuple[DataFrame, DataFrame]:
    """Rows with a usable reply (``raw``, ``revised`` added), and the others."""
    # Generated, the parsed value is a column that filter and projection share.
    parsed = df.select("*", F.explode_outer(F.array(revision(column))).alias("__r"))
    ok = parsed.where("__r IS NOT NULL").select(
        *df.columns, F.col("__r.RAW").alias("raw"), F.col("__r.REVISED").alias("revised")
    )
    return ok, parsed.where("__r IS NULL").drop("__r")


def rephrase_until_parsed(
    df: DataFrame,
    client: Callable[[str, int], str],
    key: str = "request_id",
    prompt: str = "prompt",
    max_rounds: int = 3,
    concurrency: int | None = None,
    **kw,
) -> tuple[DataFrame, DataFrame]:
    """Ask, parse, and ask again for the failures only, at most ``max_rounds`` times.

    ``client(prompt, round)``. Every round's answers are materialised in the shared
    folder before they are parsed: a call must not be repeated because two readers
    share its lineage. Returns (key, raw, revised, round) and the (key, content) that
    never parsed; a row without a prompt is never asked and stands there without content.
    """
    unasked = df.where(F.col(prompt).isNull()).select(key, F.lit(None).cast("string").alias("content"))
    todo, good = df.where(F.col(prompt).isNotNull()).select(key, prompt), None
    for rnd in range(1, max_rounds + 1):
        ask = lambda text, rnd=rnd: client(text, rnd)
        answers = cut_lineage(rephrase(todo, ask, key, prompt, concurrency, **kw))
        ok, failed = parse_response(answers)
        ok = ok.select(key, "raw", "revised", F.lit(rnd).alias("round"))
        good = ok if good is None else good.unionByName(ok)
        if rnd == max_rounds or failed.isEmpty():
            break
        todo = todo.join(broadcast_checked(failed.select(key)), key, "left_semi")
    return good, failed.select(key, "content").unionByName(unasked)


def reply_variants(prompts: DataFrame, parsed: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per revised version: the prompt's columns with (pos, variant).

    ``parsed`` is the first result of :func:`rephrase_until_parsed`.
    """
    lists = prompts.join(parsed.select(key, "revised"), key)
    return lists.select(*prompts.columns, F.posexplode("revised").alias("pos", "variant"))


def revise_texts(
    df: DataFrame,
    client: Callable[[str], str],
    template: str | None,
    key: str = "task",
    column: str = "instruction",
    concurrency: int | None = None,
    **kw,
) -> DataFrame:
    """``df`` with ``new_instruction``: the client's plain answer to the filled-in template.

    Without a template the instruction stays as it is and nothing is called. ``key`` is
    unique.
    """
    if template is None:
        return df.withColumn("new_instruction", F.col(column))
    asked = df.withColumn("prompt", fill_template(template, column))
    answers = cut_lineage(rephrase(asked, client, key=key, concurrency=concurrency, **kw))
    return df.join(answers.withColumnRenamed("content", "new_instruction"), key, "left")
