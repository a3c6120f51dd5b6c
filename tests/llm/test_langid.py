"""Language identification against a plain version: words first, then shorter and shorter grams."""

from __future__ import annotations

import collections
import math
import random

import pytest

from varlake.llm import langid


def _logs(counts, least, n_langs):
    """Key to log frequencies by language, half a count added, of keys that count ``least``."""
    kept = {k: c for k, c in counts.items() if sum(c) >= least}
    totals = [sum(c[i] for c in kept.values()) + 0.5 * (len(kept) + 1) for i in range(n_langs)]
    return {k: [math.log(x + 0.5) - math.log(t) for x, t in zip(c, totals, strict=True)] for k, c in kept.items()}


def _grams(word, n):
    marked = f" {word} "
    return [g for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) != " "]


def plain_model(rows):
    """Tables of a model that learns from every distinct (id, text, lang) with text and label."""
    rows = sorted({r for r in rows if r[1] is not None and r[2] is not None}, key=repr)
    langs = sorted({r[2] for r in rows})
    words = collections.defaultdict(lambda: [0] * len(langs))
    for _, text, lang in rows:
        for w in text.lower().split():
            words[w][langs.index(lang)] += 1
    tables = {0: _logs(words, 3, len(langs))}
    for n in langid.GRAMS:
        grams = collections.defaultdict(lambda: [0] * len(langs))
        for w, c in words.items():
            for i, x in enumerate(c):
                for g in _grams(w, n) if x else []:
                    grams[g][i] += 1
        tables[n] = _logs(grams, 2, len(langs))
    return langs, tables


def plain_predict(langs, tables, text):
    """(language, score) of a text of words without punctuation."""
    if text is None or not any(c.isalpha() for c in text) or not langs:
        return "und", 0.0
    words = [w for w in text.lower().split() if any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w)]
    sums = [0.0] * len(langs)
    for w in words:
        known = [tables[0][w]] if w in tables[0] else []
        for n in langid.GRAMS:
            known = known or [tables[n][g] for g in _grams(w, n) if g in tables[n]]
        for i in range(len(langs)):
            sums[i] += sum(k[i] for k in known) / max(len(known), 1)
    mean = [s / max(len(words), 1) * min(len(words), 20) for s in sums]
    best = max(range(len(langs)), key=lambda i: mean[i])
    return langs[best], 1 / sum(math.exp(m - mean[best]) for m in mean)


def table(seed=3):
    """Labelled texts in three alphabets, repeated rows, nulls; and texts of unseen words."""
    rng = random.Random(seed)
    letters = {"en": "abcdehinorst", "el": "αβγδεηικλνοπρστω", "zh": "的一是不了人我在有他这中大来上国"}
    made, i = [], 0
    for lang, chars in letters.items():
        vocab = ["".join(rng.choice(chars) for _ in range(rng.randrange(2, 9))) for _ in range(60)]
        for _ in range(30):
            made.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30))), lang))
            i += 1
        for _ in range(10):  # words that are seldom or never learnt
            made.append((i, " ".join("".join(rng.choice(chars) for _ in range(7)) for _ in range(3)), None))
            i += 1
    made += [made[0], made[0], (i, None, "en"), (i + 1, "", "en"), (i + 2, "123 456", None), (None, made[1][1], "el"), (i + 3, "的" * 3000, None)]
    return made


def test_equals_the_plain_version(spark):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    langs, tables = plain_model(rows)
    model = langid.fit(docs)
    assert model.langs == langs and {n: len(t[0]) for n, t in model.tables.items()} == {n: len(t) for n, t in tables.items()}
    for r in langid.identify(docs.drop("lang"), model).collect():
        want = plain_predict(langs, tables, r.text)
        assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], abs=1e-4)


def test_partitions_do_not_change_the_model(spark):
    docs = spark.createDataFrame(table(), "doc_id long, text string, lang string")
    one, many = langid.fit(docs.repartition(1), per_language=20), langid.fit(docs.repartition(7), per_language=20)
    for n, (keys, logs) in one.tables.items():
        assert (many.tables[n][0] == keys).all() and (many.tables[n][1] == logs).all()


def test_tables_keep_their_bound(spark):
    docs = spark.createDataFrame(table(), "doc_id long, text string, lang string")
    whole, small = langid.fit(docs), langid.fit(docs, cells=90)
    for n, (keys, _) in small.tables.items():
        assert len(keys) <= 30 and set(keys.tolist()) <= set(whole.tables[n][0].tolist())


def test_labels_are_no_input(spark):
    docs = spark.createDataFrame(table(), "doc_id long, text string, lang string")
    model = langid.fit(docs)
    clash = docs.selectExpr("doc_id", "text", "'zz' AS lang", "1 AS score", "'x' AS lang_pred")
    got = langid.identify(clash, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted(map(repr, got.select("text", "lang_pred", "score").collect())) == sorted(map(repr, langid.identify(docs, model).select("text", "lang_pred", "score").collect()))
