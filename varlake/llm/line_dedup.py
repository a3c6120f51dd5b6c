"""Exact line deduplication: the first document that holds a line keeps it.

Line hashes are dealt by range over (hash, document, position), so one very common line spreads
over many tasks and each task streams its lines in order, remembering one document: the first
of the current hash. A hash that crosses a range border is settled by one row per range. What
comes back is a compressed bitmap per document; texts are not moved to find the lines.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from varlake.llm import words as W
from varlake.llm.store import map_batches_arrow, released, stored
from varlake.session import ship_package



def line_keys(texts: list[bytes | None], min_chars: int):
    """Text, position and two hashes of every line whose key has ``min_chars`` code points.

    The key is the line without ASCII white space at its ends, ASCII letters lower-cased.
    """
    buf, at = W.joined(texts)
    low = W.LOWER[buf]
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    owner = np.searchsorted(at, starts, "right") - 1
    place = np.arange(len(starts)) - np.searchsorted(starts, at[:-1])[owner]
    inside = ~W.SPACE[buf]
    index = np.where(inside, np.arange(len(buf)), -1)
    last = np.maximum.accumulate(index)[ends] if len(ends) else ends
    index = np.where(inside, np.arange(len(buf)), len(buf))
    first = np.minimum.accumulate(index[::-1])[::-1][starts] if len(starts) else starts
    last = last + 1
    points = W.code_points(buf)
    long = (first < ends) & (points[np.maximum(last, first).clip(0, len(buf))] - points[first.clip(0, len(buf))] >= max(min_chars, 1))
    first, last, owner, place = first[long], last[long], owner[long], place[long]
    raw = low.tobytes()
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True))
    return owner, place, np.frombuffer(digests, np.int64).reshape(-1, 2)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        marks = batch.column(1).to_numpy(zero_copy_only=False)
        texts = W.texts_of(batch.column(2))
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        for a, b in W.groups([len(t or b"") for t in texts]):
            owner, place, keys = line_keys(texts[a:b], min_chars)
            for col, x in zip(cols, (keys[:, 0], keys[:, 1], ids[a:b][owner], marks[a:b][owner], place), strict=True):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h", "h2", "id", "mark", "pos"])

    return map_batches_arrow(docs, rows, "h long, h2 long, id long, mark long, pos long")


def _with_first(ranged: DataFrame) -> DataFrame:
    """Each sorted row with the first document of its hash within the row's range."""
    ship_package(ranged.sparkSession)

    def stream(batches):
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, h, h2, ident, mark, pos = (c.to_numpy() for c in batch.columns)
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (part[1:] != part[:-1])
            if before is not None and before[:3] == (part[0], h[0], h2[0]):
                new[0] = False
            head = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            first = np.where(head >= 0, ident[head], before[3] if before is not None else 0)
            before = (part[-1], h[-1], h2[-1], first[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (part, h, h2, ident, mark, pos, first)],
                ["part", "h", "h2", "id", "mark", "pos", "first"],
            )

    return ranged.mapInArrow(released(stream), "part int, h long, h2 long, id long, mark long, pos long, first long")


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, mark, pos) of every line that goes; ``mark`` is the hash of the text it stands in."""
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    lines = _lines(base, min_chars).repartitionByRange("h", "h2", "id", "pos").sortWithinPartitions("h", "h2", "id", "pos")
    ranged = stored(_with_first(lines.select(F.spark_partition_id().alias("part"), "h", "h2", "id", "mark", "pos")), "lines")
    ends = ranged.groupBy("part").agg(
        F.min(F.struct("h", "h2", "first")).alias("lo"), F.max(F.struct("h", "h2", "first")).alias("hi")
    )
    # One row per range: which document came first for a hash that crosses a border.
    both = ends.select("part", F.explode(F.array("lo", "hi")).alias("e")).select("part", "e.*")
    crossing = both.groupBy("h", "h2").agg(F.min("first").alias("least"), F.count_distinct("part").alias("n")).where("n > 1")
    settled = ranged.join(F.broadcast(crossing.drop("n")), ["h", "h2"], "left")
    return settled.where(F.col("id") != F.coalesce("least", "first")).select("id", "mark", "pos")


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """The keep bitmap that lacks the places ``dropped``: zlib over packed bits, a set bit keeps
    the line. It ends with the byte of the last place dropped; lines beyond it are kept."""
    keep = np.ones((int(dropped.max(initial=-1)) // 8 + 1) * 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_bitmap(data: bytes, n: int) -> np.ndarray:
    """Which of ``n`` lines are kept."""
    keep = np.ones(n, bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8))[:n]
    keep[: len(bits)] = bits
    return keep


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per document that loses lines: id, mark, n_dropped, and the keep bitmap.

    Documents without a row keep all their lines. ``unpack_bitmap`` reads a bitmap.
    """
    gone = dropped_lines(docs, id_col, text_col, min_chars)
    ship_package(docs.sparkSession)

    def pack(batches):
        for batch in batches:
            out, count = [], []
            for places in batch.column(2):
                at = np.unique(np.asarray(places.values))
                out.append(pack_bitmap(at))
                count.append(len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(out, pa.binary())], ["id", "mark", "n_dropped", "keep"])

    lists = gone.groupBy("id", "mark").agg(F.collect_list("pos").alias("places"))
    return lists.mapInArrow(released(pack), "id long, mark long, n_dropped long, keep binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Documents without the lines that a document of smaller id holds.

    Keeps every column and sets ``text_col`` to the kept lines joined by a line break; adds
    ``n_lines`` (before) and ``n_dropped``, which replace columns of these names. Lines end at ``\\n`` only; a null or empty text is one
    empty line and stays as it is. Lines whose key (ends stripped, ASCII lower-cased) has fewer
    than ``min_chars`` code points always stay, and so do all lines of a null id. Rows that share
    an id are one document: they keep what the other holds.
    """
    ship_package(docs.sparkSession)
    maps = line_bitmaps(docs, id_col, text_col, min_chars)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"))
    joined = keyed.join(maps, ["id", "mark"], "left").select("row", F.col(f"row.`{text_col}`").cast("string").alias("text"), "keep", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    row_type = joined.schema["row"].dataType

    def keep(batches):
        for batch in batches:
            out, lines = [], []
            maps_ = batch.column(2).to_pylist()
            for text, bits in zip(W.texts_of(batch.column(1)), maps_, strict=True):
                parts = (text or b"").split(b"\n")
                lines.append(len(parts))
                if bits is None:
                    out.append(text)
                    continue
                stays = unpack_bitmap(bits, len(parts))
                out.append(b"\n".join(p for p, k in zip(parts, stays.tolist(), strict=True) if k))
            kept = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), kept, pa.array(lines, pa.int64()), batch.column(3)], ["row", "text", "n_lines", "n_dropped"])

    schema = StructType().add("row", row_type).add("text", StringType()).add("n_lines", LongType()).add("n_dropped", LongType())
    done = joined.mapInArrow(released(keep), schema)
    cols = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    return done.select(*cols, "n_lines", "n_dropped")
