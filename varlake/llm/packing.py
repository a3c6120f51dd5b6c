"""Best-fit packing of token runs by bin completion over the length histogram.

Texts are encoded once; only (document, piece, length, checksum) rows move. There are at most
``capacity`` different lengths, so the packing itself is solved on their counts, whatever the
size of the corpus: best-fit decreasing is the incumbent, and where it misses the lower bound,
the fillings around the largest length left that no other filling dominates are branched on and
pruned by the waste that a better packing could still afford. Pieces then find their place by
their rank among pieces of the same length, numbered without gathering a length in one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varlake.llm import words as W
from varlake.llm.store import give_back, stored
from varlake.session import ship_package

# Words a worker remembers; beyond it starts anew.
CACHE_WORDS = 2_000_000


class WordCodes:
    """Token ids by word, each distinct word encoded once by the tokenizer.

    Words are found by their hashes in an open-addressed table of places, so a text costs the same
    whatever the number of words remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(1, np.uint32)  # place 0: the id that ends a text
        self.bits = 16
        self.table = np.full(1 << self.bits, -1, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        place = self.table[slot]
        todo = np.flatnonzero((place >= 0) & (self.keys[place] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
            place[todo] = found = self.table[slot[todo]]
            todo = todo[(found >= 0) & (self.keys[found] != h[todo])]
        return place

    def _insert(self, first: int) -> None:
        """Give the words from place ``first`` on the next free slots."""
        if 2 * len(self.keys) > len(self.table):
            while 2 * len(self.keys) > 1 << self.bits:
                self.bits += 1
            self.table, first = np.full(1 << self.bits, -1, np.int32), 0
        place = np.arange(first, len(self.keys), dtype=np.int32)
        slot = (self.keys[first:] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(place):
            free = self.table[slot] < 0
            self.table[slot[free]] = place[free]  # of several, one stays
            left = self.table[slot] != place
            place, slot = place[left], (slot[left] + 1) & (len(self.table) - 1)

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        counts, flats = [], []
        for k in range(0, len(words), 10_000):  # the library's result for a word is a large object
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + 10_000], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            flats.append(np.fromiter(chain.from_iterable(coded), np.uint32, int(counts[-1].sum())))
        count = np.concatenate(counts)
        first = len(self.keys)
        self.at = np.concatenate([self.at, np.cumsum(count) - count + len(self.ids)])
        self.ids = np.concatenate([self.ids, *flats])
        self.keys = np.concatenate([self.keys, keys])
        self.count = np.concatenate([self.count, count])
        self._insert(first)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text and the end id 0."""
        buf, start_of = W.joined(texts)
        # A special token's text keeps its case and stays whole, as the tokenizer looks for it first.
        plain = b"<|" not in buf.tobytes()
        start, end, h = W.words(buf, lower=plain, cut_punct=plain)
        place = self._find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            if len(self.keys) and len(self.keys) + len(keys) > CACHE_WORDS:
                self.clear()
                new = np.arange(len(h))
                keys, first = np.unique(h, return_index=True)
            raw = (W.LOWER[buf] if plain else buf).tobytes()
            spots = new[first]
            self._learn([raw[a:b].decode() for a, b in zip(start[spots].tolist(), end[spots].tolist(), strict=True)], keys)
            place[new] = self._find(h[new])
        bounds = np.searchsorted(start, start_of)[1:]
        at = np.insert(self.at[place], bounds, 0)
        count = np.insert(self.count[place], bounds, 1)
        flat = self.ids[W.ragged(at, count)]
        ends = np.cumsum(count)[bounds + np.arange(len(bounds))]
        return np.split(flat, ends[:-1])


_coders: dict[str, WordCodes] = {}


def _pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """One row per piece; (part, length, nth) tells pieces of one length apart."""
    ship_package(docs.sparkSession)

    def rows(batches):
        coder = _coders.get(tokenizer_path)
        if coder is None:
            coder = _coders[tokenizer_path] = WordCodes(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in W.groups(sizes):
                out = []
                for ident, codes in zip(ids[a:b], coder.encode(W.texts_of(texts.slice(a, b - a))), strict=True):
                    for k in range(0, len(codes), capacity):
                        piece = codes[k : k + capacity]
                        out.append((ident, k // capacity, k, len(piece), zlib.crc32(piece.astype("<u4", copy=False)), part, seen[len(piece)]))
                        seen[len(piece)] += 1
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
        give_back()

    return docs.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


Pattern = tuple[int, ...]


def fewest_bins(counts: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins for ``counts[n]`` pieces of each length n (Martello and Toth's L2).

    For every a: lengths above capacity - a stand alone, those above half of it cannot share a
    bin with each other, and what lengths from a to half don't find room for needs more bins.
    """
    half = capacity // 2
    number = np.concatenate([[0], np.cumsum(counts)])  # number[n]: pieces shorter than n
    volume = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    a = np.arange(half + 1)
    alone = number[capacity + 1] - number[capacity - a + 1]
    middle = number[capacity - a + 1] - number[half + 1]
    room = middle * capacity - (volume[capacity - a + 1] - volume[half + 1])
    rest = volume[half + 1] - volume[a] - room
    return int((alone + middle + np.maximum(0, -(-rest // capacity))).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: [(lengths of a bin, number of such bins)].

    A piece goes where it leaves the least room; its equals follow into the same bin while they
    fit, so all equal bins are filled in one step.
    """
    rooms: list[int] = []  # rooms of open bins, ascending
    bins: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in bins:
            insort(rooms, room)
            bins[room] = []
        bins[room].append((pattern, times))

    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        while left:
            at = bisect_left(rooms, n)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // n
            pattern, times = bins[room].pop() if at < len(rooms) else ((), max(1, left // each))
            if at < len(rooms) and not bins[room]:
                del bins[rooms.pop(at)]
            each = min(each, left)
            use = min(times, left // each)
            if use < times:
                put(room, pattern, times - use)
            put(room - each * n, pattern + (n,) * each, use)
            left -= use * each
    return [x for b in bins.values() for x in b]


def _dominates(a: Pattern, b: Pattern) -> bool:
    """Can the lengths of b be put into those of a, each a length as a bin? Then a serves better."""
    if sum(b) > sum(a):
        return False

    def place(i: int, rooms: list[int]) -> bool:
        if i == len(b):
            return True
        for j, room in enumerate(rooms):
            if room >= b[i] and room not in rooms[:j] and place(i + 1, [*rooms[:j], room - b[i], *rooms[j + 1 :]]):
                return True
        return False

    return place(0, list(a))


def _fillings(counts: np.ndarray, room: int, slack: int, tries: int, keep: int) -> list[Pattern]:
    """Fillings of ``room`` that waste at most ``slack`` and that no other one found dominates."""
    sizes = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    found: set[Pattern] = set()
    budget = tries

    def walk(at: int, rest: int, chosen: Pattern) -> None:
        nonlocal budget
        budget -= 1
        least = sizes[-1] if sizes else room + 1
        if rest < least or at == len(sizes):
            if rest <= slack:
                found.add(chosen)
            return
        fits = False
        for k in range(at, len(sizes)):
            n = sizes[k]
            if n <= rest and counts[n] > chosen.count(n):
                fits = True
                walk(k, rest - n, (*chosen, n))
                if budget <= 0:
                    return
        if not fits and rest <= slack:
            found.add(chosen)

    walk(0, room, ())
    ranked = sorted(found, key=lambda f: (-sum(f), len(f), f))[: 4 * keep]
    out: list[Pattern] = []
    for f in ranked:
        if len(f) > 8 or not any(len(g) <= 8 and _dominates(g, f) for g in out):
            out.append(f)
    return out[:keep]


def plan_bins(counts: dict[int, int], capacity: int, nodes: int = 400, tries: int = 2000, width: int = 16) -> list[tuple[Pattern, int]]:
    """[(lengths of a bin, number of such bins)] that hold ``counts`` pieces of each length.

    Best-fit decreasing is the first incumbent; where it meets :func:`fewest_bins` it is optimal
    and returned. Else bin completion: around the largest piece left, the undominated fillings
    within the waste that a better packing may still have are tried, least waste first, as often
    as they fit, then half as often, down to once. Every branch is finished by best fit for a
    better incumbent and left where its bound is no better than the best. The search stops at
    the bound or after ``nodes`` branches, having looked at ``tries`` fillings and kept ``width``
    of them at each; the result is never worse than best-fit decreasing.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    total = int((left * np.arange(capacity + 1)).sum())
    best = best_fit(left, capacity)
    size = lambda plan: sum(t for _, t in plan)
    least, fewest = fewest_bins(left, capacity), size(best)
    path: list[tuple[Pattern, int]] = []

    def options() -> list[tuple[Pattern, int]]:
        top = int(np.flatnonzero(left)[-1])
        lost = sum(t * (capacity - sum(p)) for p, t in path)
        left[top] -= 1
        fills = _fillings(left, capacity - top, (fewest - 1) * capacity - total - lost, tries, width)
        left[top] += 1
        out = []
        for f in fills:
            pattern = (top, *f)
            times = min(int(left[n]) // pattern.count(n) for n in set(pattern))
            while times:
                out.append((pattern, times))
                times //= 2
        return out[::-1]

    def shift(pattern: Pattern, times: int) -> None:
        for n in pattern:
            left[n] -= times

    # ``stack[d]`` holds what is still to be tried at depth d, ``path[d]`` what is being tried.
    stack = [options()] if fewest > least else []
    while stack and fewest > least and nodes > 0:
        if len(path) == len(stack):
            shift(path[-1][0], -path.pop()[1])
        if not stack[-1]:
            stack.pop()
            continue
        path.append(stack[-1].pop())
        shift(*path[-1])
        nodes -= 1
        used = size(path)
        if used + fewest_bins(left, capacity) >= fewest:
            continue
        rest = best_fit(left, capacity)
        if used + size(rest) < fewest:
            best, fewest = [*path, *rest], used + size(rest)
        if left.any():
            stack.append(options())
    return best


def _slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces of that length in a bin, first offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in bins:
        offset = 0
        for n in sorted(set(pattern), reverse=True):
            m = pattern.count(n)
            out.setdefault(n, []).append((ranks.get(n, 0), sequence, m, offset))
            ranks[n] = ranks.get(n, 0) + m * times
            offset += m * n
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids are the tokenizer's, without added special tokens, and a closing 0. A text of
    more than ``capacity`` ids is cut into pieces of that size; nothing else is cut. Null and
    empty texts are the closing id alone. Repeated rows are packed each for itself; a null id
    stays null. No document: no row.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(_pieces(base, tokenizer_path, capacity), "pieces")
    cells = pieces.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = _slots(plan_bins(counts, capacity))
    ranked = pieces.join(cells.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        _coders.clear()  # all texts are encoded: the worker goes on without their words
        give_back()
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                here = np.flatnonzero(length == n)
                rows = slots[n]
                slot = rows[np.searchsorted(rows[:, 0], rank[here], "right") - 1]
                nth = rank[here] - slot[:, 0]
                sequence[here] = slot[:, 1] + nth // slot[:, 2]
                offset[here] = slot[:, 3] + nth % slot[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
