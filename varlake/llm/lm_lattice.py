"""Language-model scores from a subword lattice over an existing vocabulary.

A word's probability is that of all its segmentations. An edge of the lattice is a piece of the
vocabulary (or a single byte, so that every word has a path); a word seen in training is an
edge of its own, with its discounted count. A unigram vocabulary's scores are the weights of its
pieces, unchanged. A merge vocabulary has ranks instead: these start the weights, and expected
counts over the distinct training words refine them. Sums run forward in log space.
As no piece crosses a blank, a text's log probability is the sum over its words and its end, and
each distinct word of the corpus is scored once.

The commonest words' scores are sent to the tasks (``HEAD_WORDS`` at most); all other tokens meet
their scores in a shuffle, where no key is common.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.llm import words as W
from varlake.llm.store import map_batches_arrow, stored
from varlake.session import ship_package

HEAD_WORDS = 400_000
DISCOUNT = 0.75
UNKNOWN = 10.0  # what the log weight of an uncovered byte is below the least piece's
PRIOR = 1000.0  # pseudo-counts spread over the vocabulary by its own scores


def hashes(items: list[bytes]) -> np.ndarray:
    """The hash that ``words`` gives to each byte string."""
    out = np.zeros(len(items), np.uint64)
    for i, x in enumerate(items):
        h, power = 0, 1
        for b in x:
            h = (h + int(W._VALUES[b]) * power) & W._MASK
            power = power * W._BASE & W._MASK
        out[i] = h
    return W.mix(out)


@dataclass
class Pieces:
    """Sorted hashes of word-start and inner pieces with their log weights."""

    start: np.ndarray
    start_log: np.ndarray
    inner: np.ndarray
    inner_log: np.ndarray
    stop_log: float
    longest: int


def pieces(vocabulary: list[tuple[str, float]], ranks: bool = False) -> Pieces:
    """From (piece, score); ``▁`` begins a word and ``<0xNN>`` is a byte.

    A unigram model's scores are log probabilities and weigh the edges as they are: a word ends
    where the next begins, so it has no stop of its own. A byte that no piece covers weighs
    ``UNKNOWN`` less than the least piece. With ``ranks``, scores are those of a merge model, which
    count down by rank: the logarithm of a rank's share takes their place.
    """
    start: dict[bytes, float] = {}
    inner: dict[bytes, float] = {}
    for piece, score in vocabulary:
        if piece.startswith("<") and piece.endswith(">") and len(piece) > 2:
            continue
        table, text = (start, piece[1:]) if piece.startswith("▁") else (inner, piece)
        if "▁" not in text:
            weight = score if not ranks else -math.log(2 - score) if score <= 0 else 0.0
            raw = text.encode()
            table[raw] = np.logaddexp(table.get(raw, -np.inf), weight)
    floor = math.log(1e-6) if ranks else min([0.0, *start.values(), *inner.values()]) - UNKNOWN
    for table, bare in ((start, [b""]), (inner, [bytes([b]) for b in range(256)])):
        for raw in bare:
            if ranks or raw not in table:
                table[raw] = np.logaddexp(table.get(raw, -np.inf), floor)
    longest = max(map(len, [*start, *inner]))

    def arrays(table, share):
        keys = hashes(list(table))
        order = np.argsort(keys)
        logs = np.array(list(table.values()))[order]
        if ranks:
            logs += math.log(share) - np.logaddexp.reduce(logs)
        return keys[order], logs

    return Pieces(*arrays(start, 1.0), *arrays(inner, 0.7), math.log(0.3) if ranks else 0.0, longest)


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash, or -1."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def _groups(items: list[bytes], longest: int):
    """Places of words of one length, few enough at a time for the lattice to fit in memory."""
    lengths = np.array([len(x) for x in items])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, 2_000_000 // max(1, n * min(n, longest)))
        for k in range(0, len(at), step):
            yield n, at[k : k + step]


def _edges(p: Pieces, items: list[bytes], n: int):
    """Piece places by (word, end) for starts and by length (word, begin) for inner pieces."""
    rows = np.frombuffer(b"".join(items), np.uint8).reshape(len(items), n)
    sums = np.zeros((len(items), n + 1), np.uint64)
    np.cumsum(W._VALUES[rows] * W._power("up", W._BASE, n), axis=1, out=sums[:, 1:])
    back = W._power("down", pow(W._BASE, -1, 1 << 64), n)
    first = _find(p.start, W.mix(sums[:, : min(n, p.longest) + 1]))
    spans = [_find(p.inner, W.mix((sums[:, m:] - sums[:, :-m]) * back[: n - m + 1])) for m in range(1, min(n, p.longest) + 1)]
    return first, spans


def _log(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, table[at], -np.inf)


def _forward(p: Pieces, first, spans, count: int, n: int) -> np.ndarray:
    alpha = np.full((count, n + 1), -np.inf)
    alpha[:, : first.shape[1]] = _log(p.start_log, first)
    logs = [_log(p.inner_log, s) for s in spans]
    for end in range(1, n + 1):
        a = alpha[:, end]
        for m in range(1, min(end, len(spans)) + 1):
            a = np.logaddexp(a, alpha[:, end - m] + logs[m - 1][:, end - m])
        alpha[:, end] = a
    return alpha


def spell(p: Pieces, items: list[bytes]) -> np.ndarray:
    """Log probability of each word under the pieces alone, over all segmentations."""
    out = np.zeros(len(items))
    for n, at in _groups(items, p.longest):
        first, spans = _edges(p, [items[i] for i in at], n)
        out[at] = _forward(p, first, spans, len(at), n)[:, n] + p.stop_log
    return out


def expected(p: Pieces, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Expected uses of each start and inner piece over all segmentations of ``items``."""
    starts, inners = np.zeros(len(p.start)), np.zeros(len(p.inner))
    for n, at in _groups(items, p.longest):
        first, spans = _edges(p, [items[i] for i in at], n)
        alpha = _forward(p, first, spans, len(at), n)
        total = alpha[:, n]
        logs = [_log(p.inner_log, s) for s in spans]
        beta = np.full((len(at), n + 1), -np.inf)
        beta[:, n] = 0.0
        for begin in range(n - 1, -1, -1):
            b = beta[:, begin]
            for m in range(1, min(n - begin, len(spans)) + 1):
                b = np.logaddexp(b, beta[:, begin + m] + logs[m - 1][:, begin])
            beta[:, begin] = b
        use = np.exp(_log(p.start_log, first) + beta[:, : first.shape[1]] - total[:, None])
        ok = first >= 0
        starts += np.bincount(first[ok], weights=use[ok], minlength=len(starts))
        for m, s in enumerate(spans, 1):
            ok = s >= 0
            use = np.exp(alpha[:, : n - m + 1] + logs[m - 1] + beta[:, m:] - total[:, None])
            inners += np.bincount(s[ok], weights=use[ok], minlength=len(inners))
    return starts, inners


def refined(p: Pieces, starts: np.ndarray, inners: np.ndarray, n_words: int) -> Pieces:
    s = starts + PRIOR * np.exp(p.start_log)
    i = inners + PRIOR * np.exp(p.inner_log)
    stop = n_words + PRIOR * math.exp(p.stop_log)
    return Pieces(p.start, np.log(s / s.sum()), p.inner, np.log(i / (i.sum() + stop)), math.log(stop / (i.sum() + stop)), p.longest)


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct word and its count in training rows."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
        texts = W.texts_of(batch.column(1))
        words, counts = [], []
        for a, b in W.groups([len(t or b"") for t in texts], 8 * W.SLICE):
            buf, at = W.joined(texts[a:b])
            start, end, h = W.words(buf)
            trained = ~held[a:b][np.searchsorted(at, start, "right") - 1] if len(start) else np.zeros(0, bool)
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            counts.append(np.bincount(back, weights=trained, minlength=len(first)).astype(np.int64))
            raw = W.LOWER[buf].tobytes()
            words += [raw[x:y] for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], ["word", "c"])

    found = map_batches_arrow(docs.select("held_out", "text"), rows, "word string, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


def _expected_uses(words: DataFrame, p: Pieces) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over all tasks; at most one row per piece reaches the driver."""
    shared = words.sparkSession.sparkContext.broadcast(p)

    def rows(batches):
        p = shared.value
        total = np.zeros(len(p.start) + len(p.inner) + 1)
        for batch in batches:
            items = W.texts_of(batch.column(0))
            total[:-1] += np.concatenate(expected(p, items))
            total[-1] += len(items)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

    ship_package(words.sparkSession)
    sums = words.select("word").mapInArrow(rows, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
    total = np.zeros(len(p.start) + len(p.inner) + 1)
    total[sums["piece"].to_numpy()] = sums["uses"].to_numpy()
    return total[: len(p.start)], total[len(p.start) : -1], int(total[-1])


def _word_scores(words: DataFrame, p: Pieces, tokens: int, types: int) -> DataFrame:
    """(h, c, base, score): log10 probabilities of each distinct word."""
    shared = words.sparkSession.sparkContext.broadcast(p)
    new = DISCOUNT * types / max(tokens, 1) if types else 1.0

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, c = W.texts_of(batch.column(0)), batch.column(1).to_numpy()
        start, _, h = W.words(W.joined(items)[0])
        base = np.log10((c + 0.5) / (tokens + 0.5 * (types + 1)))
        whole = np.maximum(c - DISCOUNT, 0.0) / max(tokens, 1)
        with np.errstate(divide="ignore"):
            score = np.logaddexp(np.log(whole), math.log(new) + spell(shared.value, items)) / math.log(10)
        return pa.RecordBatch.from_arrays([pa.array(W.signed(h)), pa.array(c), pa.array(base), pa.array(score)], ["h", "c", "base", "score"])

    return map_batches_arrow(words.select("word", "c"), rows, "h long, c long, base double, score double")


def _with_head(docs: DataFrame, head) -> DataFrame:
    """One row per document: sums over its common words, and the hashes of its other tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(head)
    ship_package(docs.sparkSession)

    def rows(batches):
        keys, known, base, score = shared.value
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = W.texts_of(batch.column(2))
            cols: list[list] = [[] for _ in range(5)]
            for a, b in W.groups([len(t or b"") for t in texts]):
                buf, at = W.joined(texts[a:b])
                start, _, h = W.words(buf)
                cuts = np.searchsorted(start, at)
                owner = np.repeat(np.arange(b - a), np.diff(cuts))
                place = _find(keys, h) if len(keys) else np.full(len(h), -1)
                ok = place >= 0
                cols[0].append(np.diff(cuts) + 1)
                for col, table in zip(cols[1:4], (known, base, score), strict=True):
                    col.append(np.bincount(owner[ok], weights=table[place[ok]], minlength=b - a))
                cols[4] += np.split(W.signed(h[~ok]), np.cumsum(np.bincount(owner[~ok], minlength=b - a))[:-1])
            rest = np.cumsum([0, *map(len, cols[4])]).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(rest), pa.array(np.concatenate(cols[4])))
            row = (np.int64(part) << 36) + nth + np.arange(len(texts))
            nth += len(texts)
            n, k, x, y = (np.concatenate(c) for c in cols[:4])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(row), pa.array(n.astype(np.int64)), pa.array(k.astype(np.int64)), pa.array(x.astype(np.float64)), pa.array(y.astype(np.float64)), tail],
                ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "tail"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(rows, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, tail array<long>")


def lattice_scores(docs: DataFrame, held_out, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text", ranks: bool = False, rounds: int = 2) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``held_out`` is false (null counts as false) and scores all.
    Tokens are the runs of bytes other than ASCII white space, ASCII letters lower-cased, and one
    end. Scores are log10. ``score`` adds the lattice's share to
    the training words' own; what the vocabulary spells beyond possible words (the empty word, white
    space, upper case) keeps a part of that share, so over all words it sums to at most one where the
    vocabulary's scores do. With ``ranks`` the scores are a merge model's, refined by ``rounds`` of
    expected counts; else they are used unchanged. A null or empty text is the end alone. Without
    training rows nothing is known and the vocabulary alone decides. Repeated rows count and are
    scored each.
    """
    held = F.coalesce(held_out, F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    words = stored(_word_counts(base), "words")
    seen = words.where("c > 0")
    found = seen.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = base.where("NOT held_out").count()
    tokens, types = int(found["n"]) + ends, int(found["v"]) + (ends > 0)
    p = pieces(vocabulary, ranks)
    for _ in range(rounds if ranks and types else 0):
        p = refined(p, *_expected_uses(seen, p))
    scored = stored(_word_scores(words, p, tokens, types), "scores")
    head = scored.orderBy(F.desc("c"), "h").limit(HEAD_WORDS).toArrow()
    h = head["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    common = (h[order], *(head[c].to_numpy()[order] for c in ("c", "base", "score")))
    common = (common[0], (common[1] > 0).astype(np.float64), *common[2:])
    sums = stored(_with_head(base, common), "sums")
    tail = sums.select("row", F.explode("tail").alias("h")).join(scored, "h")
    rest = tail.groupBy("row").agg(F.sum(F.col("c").cast("boolean").cast("long")).alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    end_base = math.log10((ends + 0.5) / (tokens + 0.5 * (types + 1)))
    end_score = math.log10((ends - DISCOUNT) / tokens) if ends else 0.0
    out = sums.drop("tail").join(rest, "row", "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0)) + end_base).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0)) + end_score).alias("score"),
    )
