"""Incremental versions: tail reads, resumable enrichment, live rates, exactly-once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varlake.functions.jsontext import STRICT
from varlake.operators.enrich import map_batches, remaining
from varlake.sources.shared_files import Conflict, VersionLog, folder_names


def stream_jsonl(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """New files of a folder since the last run; a new checkpoint starts over."""
    return spark.readStream.schema(schema).options(**STRICT, **options).json(path)


def _query_id(batch: DataFrame) -> str:
    """Id of the streaming query, which its checkpoint keeps."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _batch_path(sink: str, name: str | int) -> str:
    # One folder per batch, overwritten when the batch is retried: the write is idempotent.
    # Numbers start again at 0 under a new checkpoint, so the query's id is part of the name.
    return f"{sink}/batch_id={name}"


def read_sink(spark: SparkSession, sink: str) -> DataFrame | None:
    """All committed batches with their ``batch_id``; None before the first."""
    try:
        return spark.read.option("basePath", sink).parquet(f"{sink}/batch_id=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stream_enrich(
    df: DataFrame,
    fn: Callable[[dict], list[dict]],
    schema: str,
    sink: str,
    checkpoint: str,
    key: str = "id",
    **kw,
) -> StreamingQuery:
    """Run ``fn`` on inputs whose key is not in the sink yet, and append the results.

    Stops once the available input is used up; started again, it goes on from there. Which keys
    are done is kept in the query's state (for many keys set the session's state store to
    RocksDB), so a batch costs what it holds, however much the sink has. Under a new checkpoint
    all input is read again; what other checkpoints have written by its start is then
    anti-joined, and only unknown keys are called. A null key is one key.
    """
    foreign: list[str] | None = None

    def each(batch: DataFrame, batch_id: int) -> None:
        nonlocal foreign
        spark, me = batch.sparkSession, _query_id(batch)
        if foreign is None:
            parts = [n for n in folder_names(spark, sink) if n.startswith("batch_id=") and not n.startswith(f"batch_id={me}-")]
            foreign = [f"{sink}/{n}" for n in parts]
        fresh = batch
        if foreign:
            fresh = remaining(fresh, spark.read.parquet(*foreign), key)
        map_batches(fresh, fn, schema, key=key, **kw).write.mode("overwrite").parquet(_batch_path(sink, f"{me}-{batch_id}"))

    return (
        df.dropDuplicates([key]).writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_success(df: DataFrame, run: str = "run_id", task: str = "task_name") -> DataFrame:
    """Live counts per run and task; state is one row per task."""
    return df.groupBy(run, task).agg(
        F.count("*").alias("num_episodes"), F.sum(F.col("success").cast("bigint")).alias("num_successes")
    )


def stream_dedupe(df: DataFrame, key: str, ts: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once, however late a repeat comes; the state holds every key seen.

    With ``ts`` and ``delay`` the state is kept only as long as ``delay`` allows repeats, and
    Spark drops rows that come later than that.
    """
    if ts is None or delay is None:
        return df.dropDuplicates([key])
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def _fold(spark: SparkSession, sink: str, state: dict, keys: list[str]) -> DataFrame:
    """The newest row of every group: one snapshot and the deltas after it."""
    parts = ([f"{sink}/{state['snapshot']}"] if state["snapshot"] else []) + [f"{sink}/{d}" for d in state["deltas"]]
    rows = None
    for order, path in enumerate(parts):
        part = spark.read.parquet(path).withColumn("__order", F.lit(order))
        rows = part if rows is None else rows.unionByName(part)
    rest = [c for c in rows.columns if c not in (*keys, "__order")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__order").alias("v")).select(*keys, "v.*")


def write_changes(df: DataFrame, sink: str, checkpoint: str, keys: list[str], compact_every: int = 16) -> StreamingQuery:
    """Write only the groups each batch changed; :func:`latest` puts them together.

    A log in the sink numbers the batches of all checkpoints in the order of their commits; each
    of its records names the snapshot and the deltas that make up the state. Every
    ``compact_every`` deltas are folded into a new snapshot, so reading the state never takes
    more than one snapshot and that many deltas. A batch that is repeated is committed once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, me = batch.sparkSession, _query_id(batch)
        log = VersionLog(spark, f"{sink}/log")
        name = f"delta={me}-{batch_id}"
        batch.write.mode("overwrite").parquet(f"{sink}/{name}")
        while True:
            number = (log.numbers() or [0])[-1]
            state = log.read(number) if number else {"snapshot": None, "deltas": [], "seen": {}}
            if state["seen"].get(me, -1) >= batch_id:
                return
            new = {"snapshot": state["snapshot"], "deltas": [*state["deltas"], name], "seen": state["seen"] | {me: batch_id}}
            if len(new["deltas"]) >= compact_every:
                snapshot = f"snapshot={uuid.uuid4().hex}"
                _fold(spark, sink, new, keys).write.parquet(f"{sink}/{snapshot}")
                new |= {"snapshot": snapshot, "deltas": []}
            try:
                log.commit(number + 1, new)
                return
            except Conflict:  # another query's batch came first
                continue

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The newest row of every group written by :func:`write_changes`."""
    log = VersionLog(spark, f"{sink}/log")
    if not log.numbers():
        raise FileNotFoundError(f"no batch was written to {sink}")
    return _fold(spark, sink, log.read(log.numbers()[-1]), keys)


def write_rows(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append rows as Parquet with Spark's own exactly-once file sink."""
    return (
        df.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
