"""Exact top-k inner products, block at a time.

Vectors are integer term weights, a dimension being a term. The collection is laid out in
blocks of neighbouring rows of one order, each with its least and largest weight per term and
its rows as a forward index. A query sums the larger of weight x least and weight x largest over
its terms, which bounds every score in the block; blocks are taken in order of that bound and
scored until the bound falls below the query's k-th best score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.llm.store import stored
from varlake.session import ship_package

NONE = -(1 << 62)
BLOCK = 256
QUERIES = 512
QUERIES_PER_GROUP = 20_000


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, w): floor(scale * x) of each component x as double; unusable vectors go."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    whole = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("w"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


def _sign_order(w: np.ndarray) -> np.ndarray:
    """Rows ordered by their strongest terms, so that a block's rows resemble each other."""
    if w.shape[1] == 0:
        return np.arange(len(w))
    top = np.argsort(-np.abs(w), axis=1, kind="stable")[:, :3]
    code = top * 2 + (np.take_along_axis(w, top, 1) > 0)
    return np.lexsort(code.T[::-1])


def _blocks(rows: DataFrame, shards: int, name: str, size: int) -> DataFrame:
    """(shard, dims, ids, weights): blocks of ``size`` rows of one width.

    Blocks are made where the rows are read; each batch of rows goes to one shard in turn.
    """
    ship_package(rows.sparkSession)

    def build(batches):
        turn = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                ids, w = part.column(1).to_numpy(), _matrix(part.column(2), d)
                order = _sign_order(w)
                for k in range(0, len(ids), size):
                    pick = order[k : k + size]
                    out.append((turn % shards, d, ids[pick].astype("<i8").tobytes(), w[pick].astype("<i8").tobytes()))
            turn += 1
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["shard", "dims", "ids", "weights"])

    keyed = rows.select(F.size("w").alias("dims"), "id", "w")
    return stored(keyed.mapInArrow(build, "shard int, dims int, ids binary, weights binary"), name)


def _scores(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum stays below 2**53, else in Python ints."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(w).max(initial=0)) * max(q.shape[1], 1)
    if top < 1 << 53:
        return (q.astype(np.float64) @ w.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ w.astype(object).T).astype(np.int64)


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An upper bound of each query's score in each block."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return _scores(up, high) + _scores(down, low)


class _Best:
    """The k best (score, id) of each query; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[rows], score], 1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], 1)
        k = self.score.shape[1]
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.id[rows] = np.take_along_axis(i, order, 1)


def search_blocks(q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> _Best:
    """Top k of each query over the blocks (ids, weights), its own id left out."""
    best = _Best(len(q_ids), k)
    low = np.stack([w.min(0) for _, w in blocks])
    high = np.stack([w.max(0) for _, w in blocks])
    bounds = _bounds(q, low, high)
    order = np.argsort(-bounds, axis=1, kind="stable")
    live = np.arange(len(q_ids))
    for turn in range(len(blocks)):
        # A tie with the k-th score can still win by its id, so only a lower bound ends a query.
        live = live[bounds[live, order[live, turn]] >= best.score[live, -1]]
        if not len(live):
            break
        here = order[live, turn]
        for b in np.unique(here).tolist():
            rows = live[here == b]
            ids, w = blocks[b]
            score = _scores(q[rows], w)
            own = q_ids[rows][:, None] == ids[None, :]
            score[own] = NONE
            masked = np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, score.shape))
            best.add(rows, score, masked)
    return best


def top_k(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, rows_per_shard: int = 50_000, queries_per_group: int = QUERIES_PER_GROUP) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` candidates of largest integer product per query.

    ``queries`` is a condition on the columns of ``vectors``; every usable row but the query's
    own id is a candidate, and ties go to the smaller id. A null vector, one with null or
    non-finite components and a null id take no part. Vectors of different lengths don't meet.
    A query without candidates has no row; with fewer than ``k`` it has them all. A repeated
    query id asks once, with its smallest vector (by components, in order), and repeated
    candidates count each. Scores must lie within 62 bits.

    A task searches one shard of the collection, of about ``rows_per_shard`` rows, for one group
    of about ``QUERIES_PER_GROUP`` queries and returns k rows per query, so its memory doesn't
    grow with the table.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(vectors.where(queries), id_col, vector_col, scale).groupBy("id").agg(F.min("w").alias("w"))
    shards = max(1, -(-rows.count() // rows_per_shard))
    ship_package(vectors.sparkSession)
    blocks = _blocks(rows, shards, "blocks", BLOCK)
    parts = max(1, -(-asked.count() // queries_per_group))
    groups = _blocks(asked, parts, "queries", QUERIES).withColumnRenamed("shard", "part")

    def repeated(column: str, n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(column)

    keys = ["shard", "part", "dims"]
    left_side = groups.select(repeated("shard", shards), "part", "dims", "ids", "weights").groupBy(*keys)
    right_side = blocks.select("shard", repeated("part", parts), "dims", "ids", "weights").groupBy(*keys)

    def unpack(pdf) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for ids, weights in zip(pdf["ids"], pdf["weights"], strict=True):
            i = np.frombuffer(ids, "<i8")
            out.append((i, np.frombuffer(weights, "<i8").reshape(len(i), len(weights) // 8 // max(len(i), 1))))
        return out

    def search(key, left, right):
        data = unpack(right)
        made = []
        if data:
            for q_ids, q in unpack(left):
                best = search_blocks(q_ids, q, data, k)
                found = best.id != np.iinfo(np.int64).max
                made.append(pd.DataFrame({"query_id": np.repeat(q_ids, found.sum(1)), "id": best.id[found], "score": best.score[found]}))
        return pd.concat(made) if made else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")

    near = left_side.cogroup(right_side).applyInPandas(search, "query_id long, id long, score long")
    best = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), (-F.col("b.s")).alias("score"))
