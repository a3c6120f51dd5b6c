"""Language identification, words first.

A word of the training sample is scored by its log frequency in each language. A word that the
sample lacks is scored by its longest character n-grams (runs of code points, word ends
marked) that the sample has, from six down to one. A text's score is the sum over its words.
Words and grams are counted by Spark; the driver sees the pruned tables alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from varlake.llm import words as W
from varlake.llm.store import map_batches_arrow, released, stored
from varlake.session import ship_package

GRAMS = (6, 5, 4, 3, 2, 1)
_WORDY = W.LETTER | (np.arange(256) >= 128)


@dataclass
class Model:
    """Sorted hashes and their log frequencies by language, for words and for each gram length."""

    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # 0: words; n: grams of n code points


def _grams(points: np.ndarray, owner: np.ndarray, n: int):
    """Hash and owner of every run of n code points that stays within one word and its end marks."""
    values = W.mix((points.astype(np.uint64) + np.uint64(1)) * np.uint64(W._BASE))
    h = np.zeros(max(len(points) - n + 1, 0), np.uint64)
    for i in range(n):
        h = (h + values[i : i + len(h)]) * np.uint64(W._BASE)
    own = owner[: len(h)]
    same = own == owner[n - 1 :][: len(h)]
    if n == 1:  # a mark alone says nothing
        same &= points[: len(h)] != 32
    return W.mix(h[same] + np.uint64(n)), own[same]


def _marked(words: list[bytes]):
    """Code points of words with a blank at either end, and the word of each code point."""
    texts = [w.decode("utf-8", "replace") for w in words]
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), "<u4")
    return points, np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])


def _tokens(texts: list[bytes | None]):
    """(hash, text, start, end) of the words with a letter or a byte beyond ASCII."""
    buf, at = W.joined(texts)
    start, end, h = W.words(buf, lower=True, cut_punct=True)
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_WORDY[buf], out=sums[1:])
    ok = sums[end] > sums[start]
    start, end, h = start[ok], end[ok], h[ok]
    return W.LOWER[buf], h, np.searchsorted(at, start, "right") - 1, start, end


def _spell(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int) -> tuple[list[str], DataFrame]:
    """The languages in order, and (lang, text) of the texts to learn from, ``lang`` as a place."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    langs = sorted(counts)
    place = F.array_position(F.array(*[F.lit(x) for x in langs]).cast("array<string>"), F.col(lang_col)).cast("int") - 1
    rate = F.get(F.array(*[F.lit(min(1.0, 2 * per_language / counts[x])) for x in langs]).cast("array<double>"), place)
    order = F.xxhash64(F.col(text_col), F.col(id_col))
    drawn = known.where(F.pmod(order, F.lit(1_000_000)) < rate * 1_000_000)
    drawn = drawn.select(place.alias("lang"), order.alias("o"), F.col(text_col).cast("string").alias("text"))
    drawn = stored(drawn.dropDuplicates(["lang", "o"]), "sample")
    # Ranked without the texts, which may be long.
    ranked = drawn.select("lang", "o").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("o")))
    return langs, drawn.join(ranked.where(F.col("k") <= per_language), ["lang", "o"], "left_semi").select("lang", "text")


def _word_counts(sample: DataFrame) -> DataFrame:
    """(lang, key, word, c): occurrences of each word in each language, added up within a batch first."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang = batch.column(0).to_numpy()
        texts = W.texts_of(batch.column(1))
        out: list[tuple] = []
        for a, b in W.groups([len(t) for t in texts]):
            buf, h, owner, start, end = _tokens(texts[a:b])
            own = lang[a:b][owner]
            for k in np.unique(own).tolist():
                of = np.flatnonzero(own == k)
                keys, first, c = np.unique(h[of], return_index=True, return_counts=True)
                out.append((np.full(len(keys), k, np.int32), W.signed(keys), _spell(buf, start[of[first]], end[of[first]]), c.astype(np.int64)))
        cols = list(zip(*out, strict=True)) if out else [[np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [[]], [np.zeros(0, np.int64)]]
        words = pa.array([w for part in cols[2] for w in part], pa.binary())
        flat = [pa.array(np.concatenate(cols[i])) for i in (0, 1, 3)]
        return pa.RecordBatch.from_arrays([flat[0], flat[1], words, flat[2]], ["lang", "key", "word", "c"])

    made = map_batches_arrow(sample, count, "lang int, key long, word binary, c long")
    return made.groupBy("lang", "key", "word").agg(F.sum("c").alias("c"))


def _gram_counts(words: DataFrame) -> DataFrame:
    """(n, lang, key, c): grams over the distinct words of a language, as unseen words are rare ones."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang = batch.column(0).to_numpy()
        points, owner = _marked(batch.column(1).to_pylist())
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for k in np.unique(lang).tolist():
            of = np.flatnonzero(lang[owner] == k)
            for n in GRAMS:
                keys, c = np.unique(_grams(points[of], owner[of], n)[0], return_counts=True)
                for col, x in zip(cols, (np.full(len(keys), n, np.int32), np.full(len(keys), k, np.int32), W.signed(keys), c.astype(np.int64)), strict=True):
                    col.append(x)
        kinds = (np.int32, np.int32, np.int64, np.int64)
        flat = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in flat], ["n", "lang", "key", "c"])

    made = map_batches_arrow(words.select("lang", "word"), count, "n int, lang int, key long, c long", most=W.SLICE)
    return made.groupBy("n", "lang", "key").agg(F.sum("c").alias("c"))


def _table(cells: pa.Table, n_langs: int):
    """Sorted keys and their log frequencies with half a count added, from (lang, key, c)."""
    keys = cells.column("key").to_numpy().view(np.uint64)
    found, back = np.unique(keys, return_inverse=True)
    counts = np.zeros((len(found), n_langs))
    counts[back, cells.column("lang").to_numpy()] = cells.column("c").to_numpy()
    logs = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * (len(found) + 1))
    return found, logs.astype(np.float32)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 2000, cells: int = 2_000_000) -> Model:
    """A model of at most ``per_language`` labelled texts per language, whole, the first by a
    hash of text and id; rows alike in both count once.

    Words of three occurrences in all and grams of two distinct words are kept. A table holds at
    most ``cells`` keys times languages: where there are more, its rarest keys go, all those of one
    frequency together, so the model stays small at any corpus size. Null texts and null labels
    teach nothing, and without a label the model knows no language.
    """
    langs, sample = _sample(docs, text_col, lang_col, id_col, per_language)
    if not langs:
        return Model([], {})
    words = stored(_word_counts(sample), "words")
    both = words.select(F.lit(0).alias("n"), "lang", "key", "c").unionByName(_gram_counts(words))
    keys = both.groupBy("n", "key").agg(F.sum("c").alias("total"), F.collect_list(F.struct("lang", "c")).alias("by"))
    keys = stored(keys.where(F.col("total") >= F.when(F.col("n") == 0, 3).otherwise(2)), "frequencies")
    sizes: dict[int, list[tuple[int, int]]] = {n: [] for n in (0, *GRAMS)}
    for r in keys.groupBy("n", "total").count().collect():  # as many as frequencies differ
        sizes[r["n"]].append((r["total"], r["count"]))
    tables = {}
    for n, found in sizes.items():
        least, room = 0, cells // len(langs)
        for total, count in sorted(found, reverse=True):
            room -= count
            if room < 0:
                least = total + 1
                break
        kept = keys.where((F.col("n") == n) & (F.col("total") >= least))
        tables[n] = _table(kept.select("key", F.explode("by").alias("b")).select("key", "b.lang", "b.c").toArrow(), len(langs))
    return Model(langs, tables)


def _lookup(table, keys: np.ndarray):
    found, logs = table
    if not len(found):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return found[at] == keys, at


class Scorer:
    """Scores distinct words once per worker."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.logs = np.zeros((0, len(self.model.langs)), np.float32)

    def _unseen(self, words: list[bytes]) -> np.ndarray:
        """Mean log frequency of each word's grams of the longest length that has a known one."""
        out = np.zeros((len(words), len(self.model.langs)), np.float32)
        todo = np.arange(len(words))
        for n in GRAMS:
            if not len(todo):
                break
            buf, owner = _marked([words[i] for i in todo])
            g, own = _grams(buf, owner, n)
            ok, at = _lookup(self.model.tables[n], g)
            count = np.bincount(own[ok], minlength=len(todo))
            hit = count > 0
            logs = self.model.tables[n][1]
            for k in range(out.shape[1]):
                sums = np.bincount(own[ok], weights=logs[at[ok], k], minlength=len(todo))
                out[todo[hit], k] = sums[hit] / count[hit]
            todo = todo[~hit]
        return out

    def score(self, keys: np.ndarray, spell) -> np.ndarray:
        """Rows of log frequencies for distinct sorted ``keys``; ``spell(places)`` gives words."""
        new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
        if len(self.keys) + len(new) > 1_000_000:
            self.clear()
            new = np.arange(len(keys))
        if len(new):
            ok, at = _lookup(self.model.tables[0], keys[new])
            logs = np.zeros((len(new), self.logs.shape[1]), np.float32)
            logs[ok] = self.model.tables[0][1][at[ok]]
            if not ok.all():
                logs[~ok] = self._unseen(spell(new[~ok]))
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged)
            self.keys, self.logs = merged[order], np.concatenate([self.logs, logs])[order]
        return self.logs[np.searchsorted(self.keys, keys)]


def _has_letter(texts: list[bytes | None]) -> np.ndarray:
    buf, at = W.joined(texts)
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(W.LETTER[buf], out=sums[1:])
    some = np.diff(sums[at]) > 0
    for i in np.flatnonzero(~some):
        some[i] = bool(texts[i]) and any(c.isalpha() for c in texts[i].decode())
    return some


def predict(model: Model, scorer: Scorer, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the winner's share, on the mean over its words (at most
    twenty count as evidence), among all languages."""
    names: list[str] = []
    scores: list[np.ndarray] = []
    n_langs = len(model.langs)
    for a, b in W.groups([len(t or b"") for t in texts]):
        part = texts[a:b]
        ok = _has_letter(part)
        if not n_langs:
            names += ["und"] * len(part)
            scores.append(np.zeros(len(part)))
            continue
        buf, h, owner, start, end = _tokens(part)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        logs = scorer.score(keys, lambda i, buf=buf, s=start, e=end, f=first: _spell(buf, s[f[i]], e[f[i]]))
        sums = np.stack([np.bincount(owner, weights=logs[back, k], minlength=len(part)) for k in range(n_langs)], 1)
        count = np.bincount(owner, minlength=len(part))
        mean = sums / np.maximum(count, 1)[:, None] * np.minimum(count, 20)[:, None]
        best = mean.argmax(1)
        share = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
        names += [model.langs[i] if y else "und" for i, y in zip(best.tolist(), ok.tolist(), strict=True)]
        scores.append(np.where(ok, share, 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    The prediction sees the text alone. A null text, a text without a letter and any text under
    a model of no language are ``und`` with score 0. Existing columns of these names are replaced.
    """
    ship_package(docs.sparkSession)
    rest = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's sample
    at = rest.columns.index(text_col)
    schema = StructType([*rest.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())

    def rows(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            names, scores = predict(shared.value, scorer, W.texts_of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], schema.names)

    return rest.mapInArrow(released(rows), schema)
