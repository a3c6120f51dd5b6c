"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

Every text becomes the set of its hashed word shingles. Sets within a size band are cut by a
hash of the shingle into H + 1 or more segments, H being the largest symmetric difference that
two linked sets of the band can have; so linked sets agree on at least one whole segment, and
the hash of a segment's content is an exact index key.

Cost-based allocation. A segment key that tells nothing apart costs pairs in the square of its
bucket. An empty segment is one: it gets no match of its own, but spare segments that make up for
it. A set with more empty segments than spares matches, within each empty one's scope, on a
second segment's content or its one-deletion neighbourhood: as the other segments share at most H
differences, one of them differs by at most one shingle. No link is lost.

Linked sets agree on spare + 1 segments. A set that shares fewer keys of a band than that, less
its empty segments, meets only strangers there, and leaves the band before anything is verified.

No group is expanded into its pairs. Equal sets are one node. In each bucket all nodes are held
against one pivot and links are joined into components. Buckets left with several components
are keyed anew by what their nodes differ in from a common pivot (see ``_differences``), once
more against one pivot, and only what then still shares a key in different components is
tested pair by pair.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varlake.llm import words as W
from varlake.llm.components import components
from varlake.llm.store import map_batches_arrow, released, stored

# Pairs of two longs that a broadcast may hold; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
# Bytes of texts that are turned into keys at a time.
SLICE = 4 << 20
# Pairs of sets that a stored file should hold at least the links of.
FILE_PAIRS = 500
# Most that a tag can ask for; asking for less is safe.
NEED = 4095
_GOLD = 0x9E3779B97F4A7C15


def _const(*parts: int) -> np.uint64:
    h = 0
    for p in parts:
        h = (h * 0x100000001B3 + p + 1) & ((1 << 64) - 1)
    return W.mix(np.array([h], np.uint64))[0]


@lru_cache(maxsize=1)
def _edges() -> np.ndarray:
    """Lower ends of the size bands, a quarter wider each."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, np.int64)


@lru_cache(maxsize=4096)
def _scheme(band: int, num: int, den: int) -> tuple[int, int, int] | None:
    """(segments, spare segments, differences) of a band, None where no two unequal sets link.

    With ``spare`` segments more than differences + 1, linked sets agree on spare + 1 of them, so
    a set with at most ``spare`` empty segments never needs an empty one to be found.
    """
    edges = _edges()
    most = (den - num) * 2 * (int(edges[band + 1]) - 1) // (den + num)
    if not most:
        return None
    fewest = max(1, int(edges[band]) * num // den)
    spare = 0
    for _ in range(20):
        m = most + 1 + spare
        empty = m * math.exp(-fewest / m)
        spare = math.ceil(empty + 3 * math.sqrt(empty))
    return most + 1 + spare, spare, most


def _schemes(n: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(band, segments, spare, differences) of each band that holds a possible partner of at
    least ``n`` shingles."""
    edges = _edges()
    first = int(np.searchsorted(edges, n, "right")) - 1
    last = int(np.searchsorted(edges, n * den // num, "right")) - 1
    return [(band, *s) for band in range(first, last + 1) if (s := _scheme(band, num, den))]


def _sets(texts: list[bytes | None], k: int):
    """Distinct shingle hashes, text by text: (hashes, text of each, count by text)."""
    buf, at = W.joined(texts)
    start, _, h = W.words(buf)
    cuts = np.searchsorted(start, at)
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        found.append(np.unique(W.windows(h[a:b], min(k, b - a))) if b > a else h[:0])
    counts = np.array([len(x) for x in found], np.int64)
    return (np.concatenate(found) if found else h[:0]), np.repeat(np.arange(len(texts)), counts), counts


def _scoped(scope: int, values: np.ndarray, seg: np.ndarray, sums: np.ndarray, own: int) -> np.ndarray:
    """Second keys of one set within the bucket ``scope`` whose segment is ``own``."""
    tag = W.mix(np.arange(len(sums), dtype=np.uint64) * np.uint64(_GOLD) + np.uint64(scope))
    other = np.arange(len(sums)) != own
    keep = seg != own
    full = W.mix(sums + tag)[other]
    less = W.mix(sums[seg] - values + tag[seg])[keep]
    return np.unique(np.concatenate([full, less]))


def _signatures(sh, owner, counts, num: int, den: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Index keys of each text, and with each the band and how many keys of the band a text that
    links agrees on at least: ``band << 12 | need``.

    Linked sets agree on ``spare + 1`` segments, of which at most this set's empty ones have no
    key.
    """
    n_texts = len(counts)
    keys: list[list[np.ndarray]] = [[] for _ in range(n_texts)]
    asks: list[list[np.ndarray]] = [[] for _ in range(n_texts)]

    def add(i: int, found: np.ndarray, need: int) -> None:
        keys[i].append(found)
        asks[i].append(np.full(len(found), int(band[i]) << 12 | min(need, NEED), np.int32))

    plans = {int(n): _schemes(int(n), num, den) if n else [] for n in np.unique(counts)}
    values = W.mix(sh)
    begin = np.cumsum(counts) - counts
    for turn in range(max((len(p) for p in plans.values()), default=0)):
        rows = [i for i, n in enumerate(counts.tolist()) if len(plans[n]) > turn]
        if not rows:
            continue
        band = np.zeros(n_texts, np.int64)
        m, spare, most = (np.zeros(n_texts, np.int64) for _ in range(3))
        for i in rows:
            band[i], m[i], spare[i], most[i] = plans[int(counts[i])][turn]
        place = np.cumsum(m) - m
        use = m[owner] > 0
        own, val = owner[use], values[use]
        seg = ((val >> np.uint64(17)) % m[own].astype(np.uint64)).astype(np.int64)
        cells = int(m.sum())
        sums = W.segment_sums(place[own] + seg, val, cells)
        filled = np.bincount(place[own] + seg, minlength=cells) > 0
        tags = np.repeat(np.array([_const(int(b)) for b in band], np.uint64), m)
        sigs = W.mix(sums + W.mix(W.ragged(np.zeros(n_texts, np.int64), m).astype(np.uint64) + tags))
        for i in rows:
            a, b = place[i], place[i] + m[i]
            full = filled[a:b]
            empty = int((~full).sum())
            add(i, sigs[a:b][full], max(1, int(spare[i]) + 1 - empty))
            if empty > spare[i]:
                if 2 * (m[i] - empty) <= most[i]:
                    add(i, sigs[a:b][~full], 1)
                mine = values[begin[i] : begin[i] + counts[i]]
                where = ((mine >> np.uint64(17)) % np.uint64(m[i])).astype(np.int64)
                for j in np.flatnonzero(~full):
                    add(i, _scoped(int(sigs[a + j]), mine, where, sums[a:b], int(j)), 1)
    out = [], []
    for mine, theirs in zip(keys, asks, strict=True):
        once, first = np.unique(np.concatenate([np.zeros(0, np.uint64), *mine]), return_index=True)
        out[0].append(once)
        out[1].append(np.concatenate([np.zeros(0, np.int32), *theirs])[first])
    return out


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(W.signed(flat.astype(np.uint64))))


def _node(sh, owner, counts) -> np.ndarray:
    """One 64-bit name for each set; equal sets share it."""
    total = W.segment_sums(owner, W.mix(sh ^ np.uint64(_GOLD)), len(counts))
    return W.signed(W.mix(total + W.mix(counts.astype(np.uint64))))


def _index(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, node) of every text."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = W.texts_of(batch.column(1))
        out_n, out_node = [], []
        for a, b in W.groups([len(t or b"") for t in texts]):
            sh, owner, counts = _sets(texts[a:b], k)
            out_n.append(counts)
            out_node.append(_node(sh, owner, counts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out_n)), pa.array(np.concatenate(out_node))], ["doc_id", "n", "node"])

    return map_batches_arrow(docs, rows, "doc_id long, n long, node long", SLICE)


def _keyed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, keys, tags) of the texts; a batch names each of its sets once."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = W.texts_of(batch.column(0))
        nodes, keys, tags = [], [], []
        for a, b in W.groups([len(t or b"") for t in texts]):
            sh, owner, counts = _sets(texts[a:b], k)
            names = _node(sh, owner, counts)
            _, once = np.unique(names, return_index=True)
            once = once[counts[once] > 0]
            begin = np.cumsum(counts) - counts
            size = counts[once]
            part = sh[W.ragged(begin[once], size)]
            nodes.append(names[once])
            found = _signatures(part, np.repeat(np.arange(len(once)), size), size, num, den)
            keys, tags = keys + found[0], tags + found[1]
        lists = _list_array(keys)
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *tags]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), lists, pa.ListArray.from_arrays(lists.offsets, flat)], ["node", "keys", "tags"])

    found = map_batches_arrow(docs.select("text"), rows, "node long, keys array<long>, tags array<int>", SLICE)
    return found.groupBy("node").agg(F.first(F.struct("keys", "tags")).alias("x")).select("node", "x.*")


def _shared(rows: DataFrame) -> DataFrame:
    """The (key, node, tag) rows whose key more than one node has: one shuffle, then each task
    streams its sorted keys and remembers one row."""

    def stream(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, tag = (batch.column(i).to_numpy() for i in range(3))
            if held is not None:
                key, node, tag = (np.concatenate([[h], x]) for h, x in zip(held, (key, node, tag)))
            same = key[1:] == key[:-1]
            keep = np.zeros(len(key), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if held is not None and held[3]:
                keep[0] = True
            # The last row waits for the next batch, with what is known of it.
            held = (key[-1], node[-1], tag[-1], bool(keep[-1]))
            keep[-1] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep], t) for x, t in zip((key, node, tag), kinds, strict=True)], names)
        if held is not None and held[3]:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held[:3], kinds, strict=True)], names)

    names, kinds = ["key", "node", "tag"], [pa.int64(), pa.int64(), pa.int32()]
    return rows.select(names).repartition("key").sortWithinPartitions("key").mapInArrow(released(stream), "key long, node long, tag int")


def _agreeing(rows: DataFrame, again, most: int) -> DataFrame:
    """Rows of nodes that can agree with another on as many keys as a link takes.

    Where a node shares fewer keys of a band with anybody than that, it links with nobody there:
    it meets strangers by a common shingle. ``again`` leaves out the buckets that no longer
    matter without such nodes, after which others may have too few; it ends when that is rare.
    ``most`` is a bound of the rows.
    """
    before = None
    while True:
        agree = F.count("*").over(Window.partitionBy("node", "tag"))
        rows = rows.withColumn("agree", agree).where(F.col("agree") >= F.col("tag").bitwiseAND(F.lit(NEED))).drop("agree")
        rows = stored(again(rows), "agreeing", most)
        n = rows.count()
        if not n or before is not None and 10 * n >= 9 * before:
            return rows
        before = most = n


def _shingles(docs: DataFrame, k: int) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = W.texts_of(batch.column(1))
        nodes, lists = [], []
        for a, b in W.groups([len(t or b"") for t in texts]):
            sh, owner, counts = _sets(texts[a:b], k)
            nodes.append(_node(sh, owner, counts))
            lists += np.split(sh, np.cumsum(counts)[:-1])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(nodes)), _list_array(lists)], ["want", "node", "shingles"])

    return map_batches_arrow(docs, rows, "want long, node long, shingles array<long>", SLICE).where("want = node").drop("want").dropDuplicates(["node"])


def _near(n1: str, n2: str, num: int, den: int):
    return den * F.least(n1, n2) >= num * F.greatest(n1, n2)


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int, rows: int | None = None) -> DataFrame:
    """Pairs (a, b) that really link, stored; ``rows`` is a bound of the pairs."""
    pairs = stored(pairs, "pairs", rows)
    firsts, seconds = pairs, pairs.select("b").distinct()
    n = pairs.count()
    if n <= BROADCAST_ROWS:  # then only the sets of these pairs are shuffled, once
        firsts, seconds = F.broadcast(firsts), F.broadcast(seconds)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).join(firsts, "a")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).join(seconds, "b")
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    found = left.join(right, "b").where(den * both >= num * union).select("a", "b")
    return stored(found, "links", n if n <= BROADCAST_ROWS else None, FILE_PAIRS)


def _weights(live: DataFrame) -> DataFrame:
    return live.groupBy("node").agg(F.sum("c").alias("w"))


def _pivot_pairs(live: DataFrame, num: int, den: int) -> DataFrame:
    """Each bucket's nodes against the one whose keys most nodes share: an original, not a copy."""
    live = live.join(_weights(live), "node")
    pivots = live.groupBy("key").agg(F.max(F.struct("w", F.col("node").alias("p"), F.col("n").alias("pn"))).alias("s"))
    found = live.join(pivots.select("key", "s.p", "s.pn"), "key").where("node != p").where(_near("n", "pn", num, den))
    return found.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def _rooted(live: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    out = live.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return out


def _open(live: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several components."""
    state = live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"))
    return live.drop("c").join(state.where("lo != hi and c > 2").select("key", "c"), "key")


def _cross(live: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components in a bucket that their differences from the pivot don't rule out.

    Of linked nodes at least ``need`` differences are shared, so at most size - need come before
    the first shared one in either node's order. A pair meets in that one's bucket at least.
    """

    def side(at: str) -> DataFrame:
        return live.select("key", *[F.col(c).alias(f"{c}_{at}") for c in ("node", "n", "root", "size", "r")])

    need = f"size_a + size_b - floor({den - num} * (n_a + n_b) / {den + num})"  # twice
    first = F.expr(f"2 * (greatest(r_a - size_a, r_b - size_b) - 1) + {need} <= 0")
    pairs = side("a").join(side("b"), "key").where("node_a < node_b AND root_a != root_b")
    return pairs.where(_near("n_a", "n_b", num, den) & first).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _differences(live: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(scope, centre, node, n, root, linked, most, d) of the nodes in open buckets.

    Nodes that open buckets tie together share one pivot, the centre; ``d`` is what a node
    differs in from it, and ``linked`` tells whether that is little enough for a link. ``most`` is
    the most that a node may differ in from any partner.
    """
    firsts = live.groupBy("key").agg(F.min("node").alias("b"))
    ties = live.join(firsts, "key").select(F.col("node").alias("a"), "b").distinct()
    scope = components(ties).withColumnRenamed("root", "scope").join(_weights(live), "node")
    centre = scope.groupBy("scope").agg(F.max(F.struct("w", "node")).alias("s")).select("scope", F.col("s.node").alias("centre"))
    nodes = live.select("node", "n", "root").distinct().join(scope.select("node", "scope"), "node")
    pivots = centre.join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("pivot")), "centre")
    size = F.col("n")
    most = F.floor((den - num) * (size + F.floor(size * den / num)) / (den + num)).cast("int")
    diff = F.concat(F.array_except("shingles", "pivot"), F.array_except("pivot", "shingles"))
    linked = F.size("d") * (den + num) <= (den - num) * (F.col("n") + F.size("pivot"))
    both = nodes.join(sets, "node").join(pivots, "scope").withColumn("d", diff)
    return both.select("scope", "centre", "node", "n", "root", linked.alias("linked"), most.alias("most"), "d")


def _difference_keys(apart: DataFrame) -> DataFrame:
    """(key, node, n, root, size, r): rows of two nodes that link share a key. ``size`` is that of D,
    ``r`` the token's place in its order.

    Two nodes differ in exactly what their D differ in, so a link needs all but ``most`` of D to
    be shared, and the first most + 1 of D in a fixed order must meet. The order is by how many
    nodes of the scope have the token, rarest first: what most copies share, such as an edit that
    only the pivot has, then tells nothing apart and comes last.

    Nodes whose D share nothing link only if both D together are within ``most``. These meet in
    a bucket of their scope, where ``r`` is the place after the last.
    """
    size = F.size("d")
    each = apart.select("scope", "node", "n", "root", "most", size.alias("size"), F.explode("d").alias("token"))
    common = each.groupBy("scope", "token").agg(F.count("*").alias("f")).where("f > 1")
    rarest = Window.partitionBy("node").orderBy(F.coalesce("f", F.lit(1)), "token")
    first = each.join(common, ["scope", "token"], "left").withColumn("r", F.row_number().over(rarest)).where("r <= most + 1 AND f > 1")
    tokens = first.select(F.xxhash64("scope", "token").alias("key"), "node", "n", "root", "size", "r")
    near = apart.where(size <= F.col("most"))
    return tokens.unionAll(near.select(F.xxhash64("scope").alias("key"), "node", "n", "root", size, size + 1))


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows whose key more than one node has."""
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    return rows.join(shared, "key")


def _all_links(live: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links enough to join every two linked nodes' components."""
    most = live.count()
    links = _links(_pivot_pairs(live, num, den), sets, num, den, most)
    live = _agreeing(_open(_rooted(live, links)), _open, most)
    if live.isEmpty():
        return links
    apart = stored(_differences(live, sets, num, den), "apart")
    links = links.unionAll(apart.where("linked AND node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")))
    second = stored(_crowded(_difference_keys(apart)), "second")
    links = links.unionAll(_links(_pivot_pairs(second, num, den), sets, num, den, second.count()))
    rest = _open(_rooted(second, links))
    return links.unionAll(_links(_cross(rest, num, den), sets, num, den))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Two documents link when the Jaccard index of their word-shingle sets is at least
    ``num / den``; component_id is the least id that links reach. Words are runs of bytes other
    than ASCII white space, ASCII letters lower-cased; a text with fewer words than ``shingle``
    has its whole sequence as the one shingle.

    Null and empty texts, and texts of white space, have no shingles and are in a component of
    their own. Rows with a null id link like others; an all-null component has a null
    component_id. Repeated rows stay and share their component; rows that share an id but not
    the text are joined only if their texts link. Sets are told apart by 64-bit hashes. Below
    0.7 segments would have to outnumber shingles; such thresholds are refused.
    """
    if 10 * num < 7 * den:
        raise ValueError("thresholds below 0.7 are not supported")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = stored(_index(base, shingle), "sets")
    classes = index.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    rows = _keyed(base, shingle, num, den).select("node", F.explode(F.arrays_zip("keys", "tags")).alias("x"))
    rows = stored(_shared(rows.select(F.col("x.keys").alias("key"), "node", F.col("x.tags").alias("tag"))), "shared")
    pairs = _agreeing(rows, _shared, rows.count())
    both_rows = index.count() + pairs.count()
    live = stored(_crowded(pairs.join(classes.select("node", "n"), "node")), "live", both_rows)
    wanted = live.select("node").distinct().join(classes.select("node", "first"), "node")
    at = F.coalesce("doc_id", F.lit(-(2**63)))
    ids = stored(wanted.select("node", F.coalesce("first", F.lit(-(2**63))).alias("at")), "wanted", both_rows)
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = base.withColumn("at", at).join(ids, "at")
    sets = stored(_shingles(texts.select("node", "text"), shingle), "shingles")
    links = _all_links(live, sets, num, den)
    roots = components(links)
    named = classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    by_node = named.join(least, "root").select("node", "component")
    out = index.select("doc_id", "n", "node").join(by_node, "node", "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )
