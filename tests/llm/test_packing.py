"""Bin completion against its bound, plain best-fit decreasing, and time."""

from __future__ import annotations

import collections
import random
import time

import numpy as np
import pytest

from varlake.llm.packing import _dominates, best_fit, fewest_bins, plan_bins


def _plain_best_fit(sizes, capacity):
    rooms = []
    for n in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - n)
    return len(rooms)


def _histogram(counts, capacity):
    out = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        out[n] = c
    return out


def _cases():
    rng = random.Random(11)
    for i in range(1000):
        capacity = rng.choice([10, 20, 50, 100, 2048])
        low = rng.randrange(1, capacity)
        high = rng.randrange(low, capacity) + 1
        n = rng.choice([0, 1, 5, 30, 80])
        sizes = [rng.randrange(low, high + 1) for _ in range(n)]
        if i % 3 == 0 and sizes:  # many copies of one length
            sizes += [sizes[0]] * rng.randrange(40)
        yield capacity, sizes


def test_never_worse_than_best_fit_decreasing():
    better = 0
    for capacity, sizes in _cases():
        counts = collections.Counter(sizes)
        plan = plan_bins(counts, capacity, nodes=30, tries=200)
        placed = collections.Counter()
        for pattern, times in plan:
            assert 0 < sum(pattern) <= capacity and times > 0
            for n in pattern:
                placed[n] += times
        assert placed == counts
        bins, plain = sum(t for _, t in plan), _plain_best_fit(sizes, capacity)
        histogram = _histogram(counts, capacity)
        assert sum(t for _, t in best_fit(histogram, capacity)) == plain
        assert fewest_bins(histogram, capacity) <= bins <= plain
        better += bins < plain
    assert better > 10


@pytest.mark.parametrize("seed", range(30))
def test_bound_holds(seed):
    """No packing has fewer bins: held against bins filled without a gap."""
    rng = random.Random(seed)
    sizes, bins = [], rng.randrange(1, 12)
    for _ in range(bins):
        left = 60
        while left:
            n = rng.randrange(1, left + 1)
            sizes.append(n)
            left -= n
    counts = collections.Counter(sizes)
    assert fewest_bins(_histogram(counts, 60), 60) == bins
    assert sum(t for _, t in plan_bins(counts, 60)) <= bins + 1


def test_dominance():
    assert _dominates((7, 3), (7, 3)) and _dominates((7, 3), (4, 3, 3)) and _dominates((5,), (3, 2))
    assert not _dominates((7, 3), (4, 4)) and not _dominates((3,), (4,))


def test_large_histograms_take_seconds():
    rng = random.Random(8)
    for make in (lambda: rng.randrange(500, 1000), lambda: min(2048, int(rng.expovariate(1 / 300)) + 1), lambda: rng.choice([683, 682, 700, 1000, 341])):
        counts = collections.Counter(make() for _ in range(20_000))
        counts[701] += 3000
        start = time.time()
        plan = plan_bins(counts, 2048)
        assert time.time() - start < 30
        histogram = _histogram(counts, 2048)
        assert sum(t for _, t in plan) <= sum(t for _, t in best_fit(histogram, 2048))


def test_known_words_cost_no_sort(monkeypatch):
    import public_tokenizers

    from varlake.llm import packing

    coder = packing.WordCodes(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé1'!") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(200)).encode() for _ in range(40)]
    first = coder.encode(texts)
    monkeypatch.setattr(packing.np, "unique", None)
    monkeypatch.setattr(packing.np, "argsort", None)
    assert [x.tolist() for x in coder.encode(texts)] == [x.tolist() for x in first]


@pytest.mark.parametrize("most", [50, 700, 100_000])
def test_word_codes_are_the_tokenizers(monkeypatch, most):
    """Also where the words remembered are dropped now and then, or the table grows."""
    import public_tokenizers

    from varlake.llm import packing

    monkeypatch.setattr(packing, "CACHE_WORDS", most)
    coder = packing.WordCodes(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    for _ in range(4):
        texts = [" ".join("".join(rng.choice("abcDEé12'!-") for _ in range(rng.randrange(1, 8))) for _ in range(rng.choice([0, 3, 5000]))) for _ in range(9)]
        got = coder.encode([t.encode() for t in [*texts, "it's <|endoftext|> x"]] + [None])
        want = [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in [*texts, "it's <|endoftext|> x"]] + [[0]]
        assert [x.tolist() for x in got] == want
        # Probing from its own slot on finds every word.
        assert coder._find(coder.keys).tolist() == list(range(len(coder.keys)))


def test_long_words_are_hashed_whole():
    from varlake.llm import words as W

    for n in (W.STEP - 1, W.STEP, W.STEP + 1, 3 * W.STEP + 5):
        buf = np.frombuffer(b"ab " + b"x" * n + b" cd " + b"x" * n + b"\n" + b"y" * n, np.uint8)
        start, end, h = W.words(buf)
        assert (end - start).tolist() == [2, n, 2, n, n] and start.tolist() == [0, 3, n + 4, n + 7, 2 * n + 8]
        assert h[1] == h[3] and len(set(h.tolist())) == 4
