"""Batch calls that store as they go: what has been called once is never called again.

Inputs are dealt to buckets by a digest of the row and sorted by it. A task takes the rows of a
bucket in chunks, calls the function, and commits each chunk's outputs at once, as one file of
the bucket's folder named by the digest of the chunk's inputs. The file's footer names the
inputs. So whatever ends the job, a lost executor, a failing call or a kill, costs at most the
chunks in flight: a retried task or a later run reads the footers of its own bucket and calls
only what is missing. Neither the inputs nor the outputs already there are joined or shuffled
against each other.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from varlake.fixed_values import CHUNK_SIZE
from varlake.session import ship_package
from varlake.sources.shared_files import Conflict, VersionLog, open_store

_IDS = b"varlake.inputs"
_LOG = "bucket int, file string, inputs long, outputs long, known long, input string, error string"


def _layout(spark: SparkSession, store: str, buckets: int) -> int:
    """The store's number of buckets, fixed by its first use."""
    log = VersionLog(spark, f"{store}/layout")
    if not log.numbers():
        try:
            log.commit(1, {"buckets": buckets})
        except Conflict:  # another run was first
            pass
    return log.read(1)["buckets"]


class Bucket:
    """The committed chunks of one bucket, as a task sees them."""

    def __init__(self, store: str, number: int):
        self.fs, root = open_store(store)
        self.folder = f"{root}/outputs/bucket={number}"
        self.fs.create_dir(self.folder, recursive=True)
        self.known: set[str] = set()
        for info in self.fs.get_file_info(pafs.FileSelector(self.folder)):
            if info.base_name.endswith(".parquet") and not info.base_name.startswith("_"):
                with self.fs.open_input_file(info.path) as f:  # the footer alone
                    self.known.update(json.loads(pq.read_schema(f).metadata[_IDS]))

    def commit(self, ids: list[str], outputs: list[dict], schema: pa.Schema) -> str:
        """Store one chunk's outputs; the same inputs always have the same name."""
        name = f"{hashlib.sha256(''.join(ids).encode()).hexdigest()[:32]}.parquet"
        aside = f"{self.folder}/_{name}.{uuid.uuid4().hex}"
        table = pa.Table.from_pylist(outputs, schema.with_metadata({_IDS: json.dumps(ids).encode()}))
        pq.write_table(table, aside, filesystem=self.fs)
        self.fs.move(aside, f"{self.folder}/{name}")
        self.known.update(ids)
        return name


def _outcomes(pool: ThreadPoolExecutor, fn, rows: list[dict], tries: int, pause: float) -> list:
    """Each row's list of outputs, or the error of its last try; only rows that failed are repeated."""
    out: list = [None] * len(rows)
    left = list(range(len(rows)))
    for attempt in range(1, tries + 1):
        calls = [(i, pool.submit(fn, rows[i])) for i in left]
        left = []
        for i, call in calls:
            try:
                out[i] = list(call.result())
            except Exception as e:  # noqa: BLE001
                out[i] = e
                left.append(i)
        if not left:
            break
        if attempt < tries:
            time.sleep(pause * attempt)
    return out


def enrich_stored(
    inputs: DataFrame,
    fn: Callable[[dict], list[dict]],
    schema: str | T.StructType,
    store: str,
    *,
    buckets: int | None = None,
    tasks: int | None = None,
    threads: int = 1,
    chunk: int = CHUNK_SIZE,
    tries: int = 1,
    pause: float = 0.0,
    on_error: str = "fail",
) -> DataFrame:
    """Call ``fn`` on every input that ``store`` has no outputs of, and return this run's log.

    ``fn`` takes a row as a dict of plain Python values and returns a list of dicts of ``schema``,
    which may be empty. Equal rows are one input and called once; a null is a value like any
    other. An input is known by all its columns, so a changed row is a new input.

    Log: one row per committed chunk (bucket, file, inputs, outputs; ``known``: inputs of the
    bucket that needed no call) and, with ``on_error='keep'``, one per input that failed all
    ``tries`` (``input`` as JSON, ``error``). Failed inputs are not stored: the next run calls
    them again. With ``'fail'`` a failed input fails the job once the others of its chunk are
    stored.

    At most ``tasks`` tasks (all cores, if not given) of ``threads`` calls each are in flight,
    however many buckets there are. ``buckets`` is fixed by the first run; a bucket's digests are held by one
    task, so choose it for the expected total (default: the session's shuffle partitions). With
    speculation a chunk may be called twice; its outputs are still stored once.
    """
    if on_error not in ("fail", "keep"):
        raise ValueError("on_error is 'fail' or 'keep'")
    spark = inputs.sparkSession
    ship_package(spark)
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, kinds = to_arrow_schema(out), to_arrow_schema(T.StructType.fromDDL(_LOG))
    names = kinds.names
    n = _layout(spark, store, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = F.struct(*[F.col(f"`{c}`") for c in inputs.columns])
    text = F.to_json(row, {"ignoreNullFields": "false"})
    rows = inputs.select(row.alias("row"), F.sha2(text, 256).alias("id")).dropDuplicates(["id"])
    at = (F.conv(F.substring("id", 1, 8), 16, 10).cast("long") % n).cast("int")
    dealt = rows.withColumn("bucket", at).repartition(n, "bucket").sortWithinPartitions("bucket", "id")
    if tasks:
        dealt = dealt.coalesce(tasks)  # whole buckets, one after the other

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Bucket | None = None
        number, known, held = None, 0, []

        def flush(pool) -> list[tuple]:
            nonlocal held, known
            done = _outcomes(pool, fn, [r for _, r in held], tries, pause)
            good = [(i, x) for (i, _), x in zip(held, done, strict=True) if not isinstance(x, Exception)]
            bad = [(r, x) for (_, r), x in zip(held, done, strict=True) if isinstance(x, Exception)]
            log = []
            if good:
                outputs = [o for _, x in good for o in x]
                name = here.commit([i for i, _ in good], outputs, arrow)
                log.append((number, name, len(good), len(outputs), known, None, None))
                known = 0
            if bad and on_error == "fail":
                raise bad[0][1]
            log += [(number, None, 0, 0, 0, json.dumps(r, default=str), f"{type(e).__name__}: {e}") for r, e in bad]
            held = []
            return log

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                log: list[tuple] = []
                ids, at = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for k in range(batch.num_rows):
                    if at[k] != number:
                        log += flush(pool) if held else []
                        number, known, here = at[k], 0, Bucket(store, at[k])
                    if ids[k] in here.known:
                        known += 1
                        continue
                    held.append((ids[k], batch.column(0)[k].as_py(maps_as_pydicts="strict")))
                    if len(held) == chunk:
                        log += flush(pool)
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in log], kinds)
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in flush(pool)], kinds)

    run = f"{store}/log/run={uuid.uuid4().hex}"
    dealt.mapInArrow(work, _LOG).write.parquet(run)
    return spark.read.schema(_LOG).parquet(run)


def read_outputs(spark: SparkSession, store: str, schema: str | T.StructType) -> DataFrame:
    """All outputs ever stored, of this run and of earlier ones; none before the first."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        return spark.read.schema(out).option("basePath", f"{store}/outputs").parquet(f"{store}/outputs/bucket=*").select(out.names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], out)
