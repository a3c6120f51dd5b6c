"""Spelling variants against all pairs of words."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from varlake.llm import spelling
from varlake.llm.spelling import spelling_variants

ROW = "doc_id long, text string, word string, n long, form string, run string, id string"


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(rows, every):
    count = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= 5}
    out, form = {}, {}
    for w in n:
        near = sorted((x for x in n if _near(w, x)), key=lambda x: (-n[x], x))
        form[w] = near[0] if near and n[near[0]] >= 5 * n[w] else None
        out[w] = len(near)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n[w], out[w], form[w], n.get(form[w]), root))
    return sorted(rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    parts = ["th", "er", "ing", "tion", "an", "é", "Ö", "ble", "aa", "ab"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 6))) for _ in range(150)]
    for w in list(words):  # edits anywhere, chains of forms, and ties
        k = rng.randrange(len(w))
        words += [w[:k] + w[k + 1 :], w[:k] + rng.choice("abxé") + w[k:], w[:k] + "q" + w[k + 1 :]]
    words += ["aaaaaa", "aaaaaaa", "abababab", "bababab", "a×b÷ce", "x" * 300, "x" * 299 + "y"]
    texts = [" ".join([w] * rng.choice([1, 5, 6, 30, 200])) for w in words]
    texts += [None, "", " 123 ", ",".join(rng.choice(words).upper() for _ in range(3000))]
    out = [(i, t, "w", 1, "f", "r", "i") for i, t in enumerate(texts)]
    return [*out, *out[3:6], (None, texts[0], None, None, None, None, None)]


@pytest.mark.parametrize("every", [None, 7])
@pytest.mark.parametrize("often", [0, 2, 10_000])
def test_against_all_pairs(spark, rows, every, often, monkeypatch):
    """Whatever the dictionary: from every gram grown to its longest, to none grown at all."""
    monkeypatch.setitem(spelling.gram_dictionary.__kwdefaults__ or {}, "often", often)
    monkeypatch.setattr(spelling.gram_dictionary, "__defaults__", (often, spelling.DICTIONARY))
    out = spelling_variants(spark.createDataFrame(rows, ROW).repartition(3), every=every)
    got = sorted(map(tuple, out.select("word", "n", "n_near", "form", "form_n", "root").collect()))
    want = _plain(rows, every)
    assert got == want
    assert len(want) > 300 and any(r[3] and r[5] != r[3] for r in want)


def test_dictionary_is_bounded(spark, rows):
    words = spelling.word_counts(spark.createDataFrame(rows, ROW), "doc_id", "text", 6, 5, None)
    assert len(spelling.gram_dictionary(words, 0, 50)) <= 50


def test_pair_of_grams_survives_any_edit():
    """The two probed grams are in every word one edit away, at the same distance from an end."""
    rng = random.Random(4)
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(6, 15)))
        frequent = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))): 9 for _ in range(rng.choice([0, 5, 60]))}
        keys = set(spelling.probe_keys(w, frequent))
        assert len(spelling.probe_grams(w, len(w) // 2, frequent)) == 2
        edits = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abcd"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abcd"}
        for other in edits - {w}:
            assert keys & set(spelling.index_keys(other, frequent, 6)), (w, other)


def test_empty(spark):
    out = spelling_variants(spark.createDataFrame([], ROW))
    assert set(out.columns) == {"word", "n", "n_near", "form", "form_n", "root"} and out.count() == 0
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame([], ROW), chars=3)
