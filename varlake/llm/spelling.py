"""Spelling variants: words one edit apart, found through an index of variable-length grams.

The gram dictionary is the trie of the words' grams, pruned by frequency: a word is cut, at each
place, into the shortest gram that is not frequent, of at most half the word's characters, and
grams inside an earlier one are left out. Frequent grams thus grow longer and lists stay short.

One edit at place p can change only grams that begin less than ``top`` characters before p or end
at most ``top`` characters behind it (``top``: the longest gram). So each gram has a stretch of
places that affect it, and two grams whose stretches don't meet bound what any one edit can do:
one of them survives in every word that is an edit away, at the same distance from the start or
from the end. A word therefore merges just two lists, the shortest such pair, and candidates are
verified.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlake.llm.store import map_batches_arrow, stored

LETTERS = r"A-Za-zÀ-ÿ"
# Longest gram, least frequency of a gram that grows, and most grams the dictionary may hold.
LONGEST, OFTEN, DICTIONARY = 6, 16, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; the quick way where the text is all ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def word_counts(docs: DataFrame, id_col: str, text_col: str, chars: int, least: int, every: int | None) -> DataFrame:
    """(word, n) of the words with at least ``chars`` code points and ``least`` occurrences."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{chars},}}"), F.lit(0))
    rows = docs.select(ident.alias("id"), F.explode(runs).alias("run")).select("id", lower_ascii(F.col("run")).alias("word"))
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        cut = (h % F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), cut), F.substring("word", cut + 2, F.length("word")))
        rows = rows.select(F.when(h % every == 0, short).otherwise(F.col("word")).alias("word"))
    return rows.where(F.length("word") >= chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def gram_dictionary(words: DataFrame, often: int = OFTEN, most: int = DICTIONARY) -> dict[str, int]:
    """Grams that more than ``often`` places hold, with their counts; never more than ``most``.

    There are ``LONGEST - 1`` lengths with at most ``places`` grams each, so no more than
    ``most`` of them can be found above the frequency used.
    """
    places = words.agg(F.sum(F.length("word") - 1)).first()[0] or 0
    above = max(often, -(-places * (LONGEST - 1) // most))
    size = F.explode(F.sequence(F.lit(2), F.lit(LONGEST))).alias("m")
    lengths = words.select("word", size).where(F.length("word") >= F.col("m"))
    starts = F.explode(F.sequence(F.lit(1), F.length("word") - F.col("m") + 1))
    grams = lengths.select("word", "m", starts.alias("at")).select(F.substring("word", F.col("at"), F.col("m")).alias("gram"))
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > above).collect()}


def cut_grams(word: str, top: int, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """[start, end) of the word's variable grams of two to ``top`` characters."""
    out, end = [], 0
    for i in range(len(word) - 1):
        j = i + 2
        while j < i + top and j < len(word) and word[i:j] in frequent:
            j += 1
        if j > end:
            out.append((i, j))
            end = j
    return out


def probe_grams(word: str, top: int, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """The two grams of least cost that no single edit can both affect.

    Gram [i, j) is affected by edits at places j - top to i + top - 1. In a word of at least
    2 * top characters the first and the last gram always are such a pair.
    """
    grams = cut_grams(word, top, frequent)
    cost = [frequent.get(word[i:j], 1) for i, j in grams]
    best, least = [], None
    for a, (i, _) in enumerate(grams):
        for b in range(a + 1, len(grams)):
            if i + top - 1 < grams[b][1] - top and (least is None or cost[a] + cost[b] < least):
                best, least = [grams[a], grams[b]], cost[a] + cost[b]
    return best


def _key(*parts) -> int:
    return xxhash.xxh64_intdigest(repr(parts).encode()) - (1 << 63)


def _top(size: int) -> int:
    return min(size // 2, LONGEST)


def index_keys(word: str, frequent: dict[str, int], least: int) -> list[int]:
    """Where a word is listed: among words of its length by place, and, as the longer word of a
    pair, by distance from either end, cut as the shorter word is."""
    n = len(word)
    keys = [_key("=", n, i, word[i:j]) for i, j in cut_grams(word, _top(n), frequent)]
    if n > least:
        for i, j in cut_grams(word, _top(n - 1), frequent):
            keys += [_key("<", n - 1, i, word[i:j]), _key(">", n - 1, n - j, word[i:j])]
    return sorted(set(keys))


def probe_keys(word: str, frequent: dict[str, int]) -> list[int]:
    """The lists that hold every word one edit away that is as long or one longer."""
    n = len(word)
    keys = []
    for i, j in probe_grams(word, _top(n), frequent):
        keys += [_key("=", n, i, word[i:j]), _key("<", n, i, word[i:j]), _key(">", n, n - j, word[i:j])]
    return sorted(set(keys))


def _listed(words: DataFrame, keys, name: str) -> DataFrame:
    """(key, word) of each key that ``keys`` gives for a word."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        found = [keys(w) for w in texts]
        at = [w for w, k in zip(texts, found, strict=True) for _ in k]
        return pa.RecordBatch.from_arrays([pa.array([x for k in found for x in k], pa.int64()), pa.array(at, pa.string())], ["key", name])

    return map_batches_arrow(words.select("word"), rows, f"key long, {name} string")


def near_pairs(words: DataFrame, chars: int) -> DataFrame:
    """(a, b): words one inserted, deleted or replaced code point apart, each pair once."""
    frequent = gram_dictionary(words)
    grams = words.sparkSession.sparkContext.broadcast(frequent)  # at most DICTIONARY grams
    index = _listed(words, lambda w: index_keys(w, grams.value, chars), "b")
    probes = _listed(words, lambda w: probe_keys(w, grams.value), "a")
    found = probes.join(index, "key").where("length(a) < length(b) OR a < b")
    return found.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root): each word's last form. Every form is more frequent by a factor above one, and
    pointers double with each round, so the rounds grow with the logarithm of the longest chain."""
    reach = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = reach.join(step, "root", "left")
        if longer.where("next IS NOT NULL").isEmpty():
            return reach
        reach = stored(longer.select("word", F.coalesce("next", "root").alias("root")), "forms")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = 6, least: int = 5, factor: int = 5, every: int | None = None
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are maximal runs of ASCII letters and U+00C0 to U+00FF with A-Z lower-cased, of at least
    ``chars`` code points and ``least`` occurrences (n) in all texts. Near words differ by
    exactly one inserted, deleted or replaced code point. A word's form is its near word of
    largest n, of equals the first in code-point order, where that n is at least ``factor`` times
    the word's own, else null; root follows forms to the last, and is the word itself where there
    is none.

    ``every`` plants errors for tests: where it divides the CRC-32 of ``<id>:<run>``, one
    character of the run is deleted. Null and empty texts have no words; a null id counts as an
    empty one; repeated rows count each time; texts are read whole; other columns are not read.
    No word: no row.
    """
    if chars < 4 or factor < 2:
        raise ValueError("chars must be at least 4 and factor at least 2")
    words = stored(word_counts(docs, id_col, text_col, chars, least, every), "words")
    pairs = stored(near_pairs(words, chars), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # The largest n first, then the smallest word.
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near")))
    around = counted.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    out = words.join(around, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    fits = -F.col("best.neg") >= factor * F.col("n")
    out = out.withColumns({"form": F.when(fits, F.col("best.near")), "form_n": F.when(fits, -F.col("best.neg"))}).drop("best")
    out = stored(out, "variants")
    roots = _rooted(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
