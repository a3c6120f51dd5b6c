"""SimHash near duplicates by a self-join of binary tries.

Distinct fingerprints are the leaves of a binary trie. Pairs of nodes at one depth are walked down
together, from (root, root): each step takes both children of both nodes, adds one to the pair's
differing bits where the children's bits differ, and drops the pair once it exceeds its budget.

The budget is tight from the first bits on. The 64 bits are cut into ``differ + 1`` parts. Of two
fingerprints with at most ``differ`` differing bits, some rotation of the parts has at most 0 of
them in its first part, 1 in its first two, 2 in its first three, and so on (cycle lemma). One
trie per rotation is walked under these budgets. The first part has no differing bit, so a trie
falls apart into subtrees by it, which Spark deals out; a subtree of many fingerprints is walked
down in Spark, a few bits at a time, until its node pairs fit a task.

A task links what it finds with a union of labels and returns at most one edge per fingerprint:
groups are never expanded into pairs, and pairs of subtrees that already are one component are
not walked further.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.llm.components import components
from varlake.llm.store import map_batches_arrow, stored

SEED = 42
# Rows of a subtree pair that one task takes; larger ones are walked down in Spark first.
GROUP_ROWS = 1 << 20
# Rows that a task joins at once, pairs of nodes it walks at once, bits of a step in Spark.
BATCH_ROWS, PAIRS, STEP = 1 << 17, 1 << 19, 6
_SLICE, _HASHES = 1 << 22, 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _votes(parts: list[bytes], k: int) -> tuple[int, np.ndarray]:
    """Number of k-word shingles of a word list, and of those with each bit set."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    line = b" ".join(parts)
    ones = np.zeros(64, np.int64)
    one = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _HASHES):
        some = [one(line[a:b], SEED) for a, b in zip(starts[at : at + _HASHES], ends[at : at + _HASHES], strict=True)]
        bits = np.array(some, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return len(starts), ones


def fingerprint(text: str | None, k: int) -> int:
    """SimHash of the k-word shingles of a text, as an unsigned number."""
    raw = (text or "").encode().lower()
    held: list[bytes] = []
    n, ones, at = 0, np.zeros(64, np.int64), 0
    while at < len(raw):  # slices at white space bound the word list of a long text
        cut = _SPACE.search(raw, at + _SLICE) if at + _SLICE < len(raw) else None
        end = cut.start() if cut else len(raw)
        parts = held + raw[at:end].split()
        at = end
        if len(parts) >= k:
            more, votes = _votes(parts, k)
            n, ones = n + more, ones + votes
            held = parts[len(parts) - k + 1 :]
        else:
            held = parts
    if not n and held:
        n, ones = _votes(held, len(held))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp): every row's fingerprint as a signed long."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t.as_py(), k) for t in batch.column(1)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_batches_arrow(docs, rows, "doc_id long, fp long")


@lru_cache(maxsize=16)
def _scheme(differ: int) -> tuple[list[int], np.ndarray]:
    """First bit of each part, and by (rotation, depth) the most differing bits so far."""
    parts = differ + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    sizes = np.diff(cuts)
    budget = np.zeros((parts, 65), np.int64)
    for r in range(parts):
        ends = np.cumsum(np.roll(sizes, -r))
        budget[r] = np.minimum(np.searchsorted(ends, np.arange(65)), differ)
    return cuts[:-1], budget


def _heads(differ: int) -> list[int]:
    """Bits of the first part of each rotation."""
    cuts, _ = _scheme(differ)
    return np.diff([*cuts, 64]).tolist()


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a with b; every label is the least place of its component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            after = label[label]
            if np.array_equal(after, label):
                break
            label = after
    return label


def _first_one(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the right child of each node begins: the first value of [lo, hi) with the bit set."""
    a, b = lo.copy(), hi.copy()
    while True:
        going = np.flatnonzero(a < b)
        if not len(going):
            return a
        mid = (a[going] + b[going]) // 2
        one = (values[mid] >> bit[going]) & np.uint64(1) == 1
        b[going[one]] = mid[one]
        a[going[~one]] = mid[~one] + 1


def trie_links(values: np.ndarray, pairs: np.ndarray, differ: int) -> np.ndarray:
    """Component label (a place) of every value, by walking node pairs down to their leaves.

    ``values`` are sorted within each node; the columns of ``pairs`` are two nodes as [lo, hi)
    each, differing bits so far, depth and rotation. A node is paired with itself or with
    another of its depth.
    """
    budget = _scheme(differ)[1]
    label = np.arange(len(values))
    stack = [pairs]
    while stack:
        work = stack.pop()
        if len(work) > PAIRS:
            stack += [work[PAIRS:], work[:PAIRS]]
            continue
        if len(work) > len(values):  # a dense place: leave out what is one component already
            change = np.zeros(len(values) + 1, np.int64)
            np.cumsum(label[1:] != label[:-1], out=change[1:-1])
            lu, hu, lv, hv = work[:, :4].T
            whole = (change[hu - 1] == change[lu]) & (change[hv - 1] == change[lv])
            work = work[~(whole & (label[lu] == label[lv]))]
        lu, hu, lv, hv, d, depth, turn = work.T
        same = lu == lv
        leaf = (hu - lu == 1) & (hv - lv == 1)
        near = ~leaf & (d + 64 - depth <= differ)  # whatever the other bits are, all of it links
        ends = np.flatnonzero(leaf & ~same)
        if len(ends):
            few = np.bitwise_count(values[lu[ends]] ^ values[lv[ends]]) <= differ
            label = _merge(label, lu[ends[few]], lv[ends[few]])
        for i in np.flatnonzero(near):
            label = _merge(label, np.full(hu[i] - lu[i], lu[i]), np.arange(lu[i], hu[i]))
            label = _merge(label, np.full(hv[i] - lv[i], lu[i]), np.arange(lv[i], hv[i]))
        work = work[~(leaf | near)]
        if not len(work):
            continue
        lu, hu, lv, hv, d, depth, turn = work.T
        same = lu == lv
        bit = (63 - depth).astype(np.uint64)
        mu, mv = _first_one(values, lu, hu, bit), _first_one(values, lv, hv, bit)
        below = np.concatenate([
            np.column_stack([lu, mu, lv, mv, d, depth + 1, turn]),
            np.column_stack([mu, hu, mv, hv, d, depth + 1, turn]),
            np.column_stack([lu, mu, mv, hv, d + 1, depth + 1, turn]),
            np.column_stack([mu, hu, lv, mv, d + 1, depth + 1, turn])[~same],
        ])
        there = (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3])
        below = below[there & (below[:, 4] <= budget[below[:, 6], below[:, 5]])]
        if len(below):
            stack.append(below)
    return label


_ROW = "turn int, depth int, u long, v long, second boolean, value long"
_PAIR = ["turn", "depth", "u", "v"]


def _rotated(fps: DataFrame, differ: int) -> DataFrame:
    """Each fingerprint once per rotation, under the subtree of its first part."""
    fp = F.col("fp")
    out = []
    for r, (cut, head) in enumerate(zip(_scheme(differ)[0], _heads(differ), strict=True)):
        value = F.shiftleft(fp, cut).bitwiseOR(F.shiftrightunsigned(fp, 64 - cut)) if cut else fp
        top = F.shiftrightunsigned(value, 64 - head) if head < 64 else value
        out.append(F.struct(F.lit(r).alias("turn"), F.lit(head).alias("depth"), top.alias("u"), top.alias("v"), F.lit(False).alias("second"), value.alias("value")))
    return fps.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def _walked(rows: DataFrame, differ: int, step: int) -> DataFrame:
    """Rows of node pairs, ``step`` bits further down: one row for each pair a fingerprint is in."""
    budget = _scheme(differ)[1]
    masks = np.arange(1 << step, dtype=np.int64)
    ones = np.bitwise_count(masks).astype(np.int64)

    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        turn, depth, u, v, second, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        by = np.minimum(step, 64 - depth)
        deeper = depth + by
        own = (value.view(np.uint64) >> (64 - deeper).astype(np.uint64)).view(np.int64)
        other = np.where(second, u, v)
        apart = np.bitwise_count((u ^ v).view(np.uint64)).astype(np.int64)
        fits = (apart[:, None] + ones[None, :] <= budget[turn, deeper][:, None]) & (masks[None, :] < (1 << by)[:, None])
        row, mask = np.nonzero(fits)
        ext = (own & ((1 << by) - 1))[row] ^ masks[mask]
        mate = (other[row] << by[row]) | ext
        self_pair = (u == v)[row]
        last = np.where(self_pair, own[row] > mate, second[row])
        first = ~last
        out = [turn[row], deeper[row].astype(np.int32), np.where(first, own[row], mate), np.where(first, mate, own[row]), last, value[row]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["turn", "depth", "u", "v", "second", "value"])

    return map_batches_arrow(rows, walk, _ROW)


def _dealt(rows: DataFrame, differ: int, group_rows: int, step: int) -> DataFrame:
    """Rows whose node pairs have at most ``group_rows`` rows each."""
    ready: list[DataFrame] = []
    while True:
        sizes = rows.where("depth < 64").groupBy(*_PAIR).count().where(F.col("count") > group_rows)
        crowded = stored(sizes.select(*_PAIR), "trie-crowded")
        if crowded.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(crowded, _PAIR, "left_anti").select(rows.columns))
        rows = stored(_walked(rows.join(crowded, _PAIR, "left_semi").select(rows.columns), differ, step), "trie-rows")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionAll(more)
    return out


def _joined(rows: DataFrame, differ: int) -> DataFrame:
    """(a, b) fingerprints: edges that join what the subtree pairs link."""
    cuts = np.array(_scheme(differ)[0], np.uint64)

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        turn, depth, u, v, second, value = cols
        values = value.view(np.uint64)
        new_node = np.ones(len(values), bool)
        new_pair = np.ones(len(values), bool)
        new_pair[1:] = (turn[1:] != turn[:-1]) | (depth[1:] != depth[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        new_node[1:] = new_pair[1:] | (second[1:] != second[:-1])
        lo = np.flatnonzero(new_node)
        hi = np.append(lo[1:], len(values))
        first = ~second[lo]
        alone = u[lo] == v[lo]
        # A node pair of two nodes has both of them next to each other; of one node, only itself.
        pair_of = np.cumsum(new_pair)[lo]
        both = np.flatnonzero(first[:-1] & ~first[1:] & (pair_of[:-1] == pair_of[1:])) if len(lo) > 1 else np.zeros(0, np.int64)
        left = np.concatenate([np.flatnonzero(alone), both])
        right = np.concatenate([np.flatnonzero(alone), both + 1])
        at = lo[left]
        apart = np.bitwise_count((u[at] ^ v[at]).view(np.uint64)).astype(np.int64)
        pairs = np.column_stack([at, hi[left], lo[right], hi[right], apart, depth[at], turn[at]]).astype(np.int64)
        label = trie_links(values, pairs, differ)
        tied = np.flatnonzero(label != np.arange(len(label)))
        if not len(tied):
            return None
        shift = cuts[turn[tied]]
        back = lambda x: np.where(shift == 0, x, (x >> shift) | (x << (np.uint64(64) - np.maximum(shift, 1)))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back(values[tied])), pa.array(back(values[label[tied]]))], ["a", "b"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
            n += batch.num_rows
            if n < BATCH_ROWS:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            key = np.column_stack(cols[:4])
            same = np.flatnonzero((key != key[-1]).any(1))
            whole = int(same[-1]) + 1 if len(same) else 0  # the last pair may go on in the next batch
            if whole and (out := edges([c[:whole] for c in cols])) is not None:
                yield out
            held, n = [[c[whole:] for c in cols]], n - whole
        if n and (out := edges([np.concatenate(c) for c in zip(*held, strict=True)])) is not None:
            yield out

    dealt = rows.repartition(*_PAIR).sortWithinPartitions(*_PAIR, "second", F.col("value").bitwiseXOR(F.lit(-(2**63)).cast("long")))
    return dealt.mapInArrow(run, "a long, b long")


def simhash_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, differ: int = 4, group_rows: int = GROUP_ROWS, step: int = STEP
) -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits), component_id.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a bit of the
    fingerprint is set if it is set in over half of the XXH64 hashes (seed 42) of all word
    shingles, repeats included. A text with fewer words is its own one shingle; null texts and
    texts without words have fingerprint zero, which links like any other. Documents whose
    fingerprints differ in at most ``differ`` bits link; component_id is the least id that links
    reach.

    Repeated rows stay, each with its component. A null id takes part but is no least id; a
    component of null ids has a null component_id. Other columns are not read. No row: no row.
    """
    if not 0 <= differ < 32:
        raise ValueError("differ must be from 0 to 31")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = stored(fingerprints(base, shingle), "fingerprints")
    fps = stored(index.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    rows = _dealt(_rotated(fps, differ), differ, group_rows, step)
    roots = components(stored(_joined(rows, differ), "trie-edges"))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    out = index.join(by_fp, "fp")
    return out.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
