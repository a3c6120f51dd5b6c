"""Session helpers: shared scratch space and checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound, in bytes of row content, for anything this package broadcasts.
BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of a few numbers that a stored file should hold at least.
FILE_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own; on a
    cluster a machine-local path would vanish with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="varlake-")
    spark.sparkContext.setCheckpointDir(base)
    return base


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions passed to ``mapInPandas`` and the shard data source are imported there.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='varlake-')}/{root.name}", "zip", root.parent, root.name
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so reruns cannot clash."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def in_files(df: DataFrame, rows: int | None, each: int = FILE_ROWS) -> DataFrame:
    """``df``, to be stored in no more files than its last step's ``rows`` rows need.

    Small tables left in one file per shuffle partition cost more to write than to make; on a
    local file system Hadoop also starts a ``chmod`` for every file. ``rows`` is a bound of what
    the last step reads and gives, None where there is none.
    """
    return df if rows is None else df.coalesce(max(1, -(-rows // each)))


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise once in the shared folder so later jobs do not recompute ``df``."""
    shared_dir(df.sparkSession)
    return in_files(df, rows).checkpoint(eager=True)


def content_bytes(df: DataFrame) -> int:
    """Exact size of the rows as JSON text: one distributed pass, one number back."""
    row = df.agg(
        F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("b")
    ).first()
    return int(row["b"] or 0)


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Has ``df`` been measured to fit a broadcast?"""
    return content_bytes(df) <= limit


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size allows, else ``df`` itself.

    Without the hint the join shuffles, and adaptive execution splits hot keys.
    """
    return F.broadcast(df) if small_enough(df, limit) else df
