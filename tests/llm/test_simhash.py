"""The SimHash trie join against all pairs of fingerprints."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from varlake.llm import simhash_trie
from varlake.llm.simhash_trie import simhash_join, trie_links

ROW = "doc_id long, text string, fp string, value long, u long, component_id long, root long, first string"


def _plain_fp(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(k, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)] if k else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps, differ):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= differ:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Ärger", "naïve", "END."]
    base = [rng.choice(vocab) for _ in range(300)]
    near = []
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(300)] = rng.choice(vocab)
        near.append(" ".join(copy))
    texts = [None, "", " \n\t", "one", "ONE", "two words", "a b c", "a b c d", " ".join(base), " ".join(base).upper(), "x" * 5000]
    texts += near + [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    texts += [" ".join(rng.choice(vocab) for _ in range(20_000))]
    out = [(i, t, "f", 0, 0, 0, 0, "x") for i, t in enumerate(texts)]
    return [*out, (8, texts[8], None, 0, 0, 0, 0, None), (3, "one", None, 0, 0, 0, 0, None), (None, texts[8], None, 0, 0, 0, 0, None), (None, "nobody else", None, 0, 0, 0, 0, None)]


@pytest.mark.parametrize(("group_rows", "step", "differ"), [(1 << 20, 6, 4), (8, 3, 4), (4, 6, 6)])
def test_against_all_pairs(spark, rows, group_rows, step, differ):
    out = simhash_join(spark.createDataFrame(rows, ROW).repartition(3), shingle=4, differ=differ, group_rows=group_rows, step=step)
    got = sorted(map(tuple, out.collect()), key=repr)
    fps = [_plain_fp(r[1], 4) for r in rows]
    roots = _components(fps, differ)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted(((r[0], f"{fp:016x}", least.get(root)) for r, fp, root in zip(rows, fps, roots, strict=True)), key=repr)
    assert got == want


def test_long_texts_in_slices(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["a", "bb", "C", "é"]) + rng.choice([" ", "\n\n", "\t", "x"]) for _ in range(3000))
    for size in (1, 7, 64):
        monkeypatch.setattr(simhash_trie, "_SLICE", size)
        for k in (1, 2, 4):
            assert simhash_trie.fingerprint(text, k) == _plain_fp(text, k)


@pytest.mark.parametrize("spread", [3, 64])
def test_walk_finds_every_pair(monkeypatch, spread):
    """Dense clouds and strangers; small chunks force the pruning of finished components."""
    monkeypatch.setattr(simhash_trie, "PAIRS", 50)
    rng = np.random.default_rng(spread)
    for differ in (0, 1, 3, 4, 5):
        centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        noise = np.zeros(400, np.uint64)
        for _ in range(spread if spread < 10 else 0):
            noise ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
        values = np.unique(centre[rng.integers(0, 4, 400)] ^ noise) if spread < 10 else np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
        cuts, _ = simhash_trie._scheme(differ)
        label = np.arange(len(values))
        for turn, cut in enumerate(cuts):
            turned = (values << np.uint64(cut)) | (values >> np.uint64(64 - cut)) if cut else values
            order = np.argsort(turned)
            head = simhash_trie._heads(differ)[turn]
            tops = turned[order] >> np.uint64(64 - head) if head < 64 else turned[order]
            lo = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
            hi = np.append(lo[1:], len(order))
            pairs = np.column_stack([lo, hi, lo, hi, 0 * lo, 0 * lo + head, 0 * lo + turn])
            mine = trie_links(turned[order], pairs, differ)
            label = simhash_trie._merge(label, order, order[mine])
        assert label.tolist() == _components([int(v) for v in values], differ)


def test_empty(spark):
    out = simhash_join(spark.createDataFrame([], ROW))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_spark_hash_is_the_same(spark):
    """The contract's hash is the one that Spark's own function computes."""
    got = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", seed=42)
