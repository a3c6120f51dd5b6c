"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Signals are computed in one pass over whole texts. Labelled documents are split by a hash of
their id: one half proposes, the other certifies. For each stratum the first half proposes a
cutoff per signal and puts these and all looser ones in an order, fewest good documents first:
each place rejects what the places before it do and something more. The other half of the same
stratum counts the good documents rejected up to each place, by whichever signal. Places hold
from the first on while the exact (Clopper-Pearson) upper bound on that share is at most
``risk``, at a confidence shared out over the strata (Bonferroni); the walk ends at the first
failure, so neither places nor signals need a further correction. Where a stratum's own first
half knows nothing for or against a signal, the proposal is that of all strata together, held
against the stratum's own second half all the same. A stratum whose second half certifies
nothing, or that has no labels, has no cutoff.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.llm import words as W
from varlake.llm.store import map_batches_arrow, released, stored
from varlake.session import ship_package

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Each signal grows with junk; the steps are the cutoffs that may be chosen.
SIGNALS = {
    "symbols": np.geomspace(0.01, 4, 40),
    "dup_lines": np.linspace(0.02, 1, 40),
    "repeats": np.linspace(0.02, 1, 40),
    "long_words": np.geomspace(4, 40, 40),
    "capitals": np.linspace(0.05, 1, 40),
    "shouts": np.geomspace(0.01, 4, 40),
    "stutters": np.linspace(0.02, 1, 40),
}

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_WINDOW = 8


def _dup_lines(texts: list[bytes | None]) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    space = bytes([*range(0x09, 0x0E), 0x20])
    for i, text in enumerate(texts):
        if text and b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip(space)]
            out[i] = len(lines) - len(set(lines))
    return out


def _repeats(h: np.ndarray) -> int:
    """Words that stand in a window of eight found twice or more."""
    win = W.windows(h, _WINDOW)
    if len(win) < 2:
        return 0
    _, back, count = np.unique(win, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    if not len(at):
        return 0
    gaps = np.minimum(np.diff(at), _WINDOW)
    return int(gaps.sum()) + _WINDOW


def _stutters(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Words that repeat the word before them."""
    sums = np.zeros(len(h) + 1, np.int64)
    np.cumsum(h[1:] == h[:-1], out=sums[2:])
    first = np.minimum(cuts[:-1] + 1, cuts[1:])
    return sums[cuts[1:]] - sums[first]


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts of each text; a null text has none of anything."""
    parts: dict[str, list[np.ndarray]] = {}
    for a, b in W.groups([len(t or b"") for t in texts], W.SLICE):
        buf, at = W.joined(texts[a:b])
        start, end, h = W.words(buf, lower=False)
        cuts = np.searchsorted(start, at)
        points = W.code_points(buf)
        inside = np.zeros(len(start) + 1, np.int64)
        np.cumsum(points[end] - points[start], out=inside[1:])

        def per_text(mask, at=at):
            sums = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=sums[1:])
            return np.diff(sums[at])

        got = {
            "n_words": np.diff(cuts),
            "word_chars": np.diff(inside[cuts]),
            "n_symbols": per_text(_SYMBOL[buf]),
            "n_dup_lines": _dup_lines(texts[a:b]),
            "n_repeat_words": np.array([_repeats(h[x:y]) for x, y in pairwise(cuts.tolist())], np.int64),
            "capitals": per_text((buf >= 65) & (buf <= 90)),
            "letters": per_text(W.LETTER[buf]),
            "shouts": per_text(buf == 33),
            "lines": per_text(buf == 10),
            "stutters": _stutters(h, cuts),
        }
        for k, v in got.items():
            parts.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in parts.items()}


def signals(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    words, letters, lines = (np.maximum(m[k], 1) for k in ("n_words", "letters", "lines"))
    return {
        "symbols": m["n_symbols"] / words,
        "dup_lines": m["n_dup_lines"] / lines,
        "repeats": m["n_repeat_words"] / words,
        "long_words": m["word_chars"] / words,
        "capitals": m["capitals"] / letters,
        "shouts": m["shouts"] / words,
        "stutters": m["stutters"] / words,
    }


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def upper_bound(failures: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest rate under which ``failures`` or fewer of ``n`` have
    probability ``error``."""
    if failures >= n:
        return 1.0

    def tail(p: float) -> float:
        terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(failures + 1)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    lo, hi = failures / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid <= 0 or tail(mid) > error else (lo, mid)
    return hi


def _above(counts: np.ndarray) -> np.ndarray:
    """Row i: documents above cutoff i, of counts by the number of cutoffs they exceed."""
    return counts[::-1].cumsum(0)[::-1][1:]


def proposals(cells: list[tuple], weight: float) -> dict[str, list[tuple[str, int]]]:
    """{stratum: [(signal, index of a cutoff), ..]} in the order in which they are tried.

    ``cells`` are the (stratum, signal, step, quality, n) counts of the first half.
    """
    tables: dict[tuple, np.ndarray] = {}
    for stratum, signal, step, quality, n in cells:
        for s in (stratum, None):
            tables.setdefault((s, signal), np.zeros((len(SIGNALS[signal]) + 1, 2), np.int64))[step, quality] += n
    above = {key: _above(t) for key, t in tables.items()}
    gains = {key: x[:, 0] - weight * x[:, 1] for key, x in above.items()}

    def tightest(key) -> int | None:
        gain = gains[key]
        return int(len(gain) - 1 - np.argmax(gain[::-1])) if gain.max() > 0 else None

    out: dict[str, list] = {}
    for s, signal in above:
        if s is None:
            continue
        own, pooled = above[s, signal][:, 1], above[None, signal][:, 1]
        aim = tightest((s, signal))
        if aim is None and (aim := tightest((None, signal))) is not None:
            harmless = np.flatnonzero(gains[s, signal][aim:] >= 0)
            aim = aim + int(harmless[0]) if len(harmless) else None
        if aim is not None:
            out.setdefault(s, []).extend((int(own[i]), int(pooled[i]), -i, signal) for i in range(aim, len(own)))
    return {s: [(signal, -i) for _, _, i, signal in sorted(places)] for s, places in out.items()}


def certified(tune: np.ndarray, hold: np.ndarray, risk: float, error: float, weight: float) -> int:
    """How many places of a stratum's order to use.

    ``tune`` and ``hold`` are (places + 1, 2) counts of bad and good documents by the first place
    that rejects them, the last row those that none does.
    """
    n = int(hold[:, 1].sum())
    over = hold[:-1, 1].cumsum()
    fails = lambda i: bool(over[i] > risk * n or upper_bound(int(over[i]), n, error) > risk)
    holds = bisect_left(range(len(over)), True, key=fails) if n else 0
    gain = (tune[:-1, 0] - weight * tune[:-1, 1]).cumsum()[:holds]
    return int(len(gain) - np.argmax(gain[::-1])) if len(gain) and gain.max() >= 0 else 0


def choose_cutoffs(order: dict[str, list[tuple[str, int]]], cells: list[tuple], risk: float, delta: float, weight: float) -> dict[tuple[str, str], float]:
    """{(stratum, signal): cutoff} from (stratum, half, place, quality, n) counts; what no place
    rejects has the place null."""
    tables = {s: np.zeros((2, len(places) + 1, 2), np.int64) for s, places in order.items()}
    for stratum, half, place, quality, n in cells:
        tables[stratum][half, -1 if place is None else place, quality] += n
    out: dict[tuple[str, str], float] = {}
    for s, places in order.items():
        used = certified(tables[s][0], tables[s][1], risk, delta / len(order), weight)
        # A signal's places run from its loosest cutoff on: the last one counts.
        out |= {(s, signal): float(SIGNALS[signal][i]) for signal, i in places[:used]}
    return out


def _measured(docs: DataFrame) -> DataFrame:
    """(id, stratum, counts, one column per signal) of (id, stratum, text) rows."""
    names = [*COUNTS, "base_failed", *SIGNALS]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(W.texts_of(batch.column(2)))
        s = signals(m)
        cols = [batch.column(0), batch.column(1), *[pa.array(m[c]) for c in COUNTS], pa.array(base_failed(m)), *[pa.array(s[c]) for c in SIGNALS]]
        return pa.RecordBatch.from_arrays(cols, ["id", "stratum", *names])

    kinds = ", ".join([f"{c} long" for c in COUNTS] + ["base_failed boolean"] + [f"{c} double" for c in SIGNALS])
    return map_batches_arrow(docs, rows, f"id long, stratum string, {kinds}")


def fit(measured: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, weight: float = 20.0) -> dict[tuple[str, str], float]:
    """Cutoffs from ``labels`` (doc_id, quality 0 or 1) and measured documents.

    Only counts come to the driver: by stratum, signal and step, then by stratum and place in its
    order. Labels that are null, repeated or without a document don't count twice or at all.
    Documents that the base rules reject are left out: the guarantee is for the rules' own
    verdict.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("quality"))
    half = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")
    steps = [sum((F.when(F.col(name) > float(c), 1).otherwise(0) for c in cuts), F.lit(0)).alias(name) for name, cuts in SIGNALS.items()]
    rows = stored(measured.where("not base_failed").join(known, "id").select("stratum", half.alias("half"), "quality", *steps), "labelled")
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("signal"), F.col(name).alias("step")) for name in SIGNALS]))
    counts = rows.where("half = 0").select("stratum", "quality", long.alias("s")).groupBy("stratum", "s.signal", "s.step", "quality").count()
    order = proposals([(r["stratum"], r["signal"], r["step"], r["quality"], r["count"]) for r in counts.collect()], weight)
    if not order:
        return {}
    firsts = rows.sparkSession.createDataFrame(
        [(s, *_first_places(places)) for s, places in order.items()], ", ".join(["stratum string", *(f"at_{name} array<int>" for name in SIGNALS)])
    )
    place = F.least(*[F.get(f"at_{name}", F.col(name)) for name in SIGNALS]).alias("place")
    cells = rows.join(F.broadcast(firsts), "stratum").groupBy("stratum", "half", place, "quality").count()
    return choose_cutoffs(order, [(r["stratum"], r["half"], r["place"], r["quality"], r["count"]) for r in cells.collect()], risk, delta, weight)


def _first_places(places: list[tuple[str, int]]) -> list[list[int | None]]:
    """For each signal, by the number of cutoffs exceeded, the first place that rejects."""
    at = {name: [None] * (len(cuts) + 1) for name, cuts in SIGNALS.items()}
    for place, (signal, i) in reversed(list(enumerate(places))):
        at[signal][i + 1 :] = [place] * (len(SIGNALS[signal]) - i)
    return list(at.values())


def _passes(cutoffs: dict[tuple[str, str], float]):
    strata = sorted({s for s, _ in cutoffs})
    ok = F.lit(True)
    for signal in SIGNALS:
        cut = F.lit(math.inf)
        for s in strata:
            cut = F.when(F.col("stratum") == s, F.lit(cutoffs.get((s, signal), math.inf))).otherwise(cut)
        ok = ok & (F.col(signal) <= cut)
    return ok


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per document: id, counts, base_failed, kept, and the signals.

    ``kept`` is false where the base rules fail or a signal exceeds its stratum's certified
    cutoff. With probability 1 - ``delta`` the signals together reject at most ``risk`` of the
    good documents of every stratum that pass the base rules. A null or empty text has no words
    and fails the base rules; a null stratum is one of its own; in a stratum without labels the
    base rules alone decide. Repeated rows get a row each.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    base = docs.select(F.col(id_col).cast("long").alias("id"), stratum.alias("stratum"), F.col(text_col).cast("string").alias("text"))
    measured = stored(_measured(base), "measured")
    cutoffs = fit(measured, labels, risk, delta)
    kept = ~F.col("base_failed") & _passes(cutoffs)
    return measured.select(F.col("id").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"), *SIGNALS)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns; texts are not shuffled."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), stratum.alias("stratum"), F.col(text_col).cast("string").alias("text"))
    cutoffs = fit(stored(_measured(base), "measured"), labels, risk, delta)
    ship_package(docs.sparkSession)
    names = docs.columns
    at_text, at_stratum = names.index(text_col), names.index(stratum_col)

    def rows(batches):
        for batch in batches:
            m = measure(W.texts_of(batch.column(at_text)))
            s = signals(m)
            ok = ~base_failed(m)
            strata = [x or "" for x in batch.column(at_stratum).to_pylist()]
            for signal in SIGNALS:
                ok &= s[signal] <= np.array([cutoffs.get((x, signal), math.inf) for x in strata])
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(released(rows), docs.schema)
