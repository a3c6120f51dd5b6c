"""The Merkle manifest against a plain-Python tree."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from varlake.llm import merkle

ROW = "doc_id long, source string, text string, leaf string, root string, rank long, size long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(digests):
    """The root, and each leaf's siblings as (left, right) by level."""
    steps = [[] for _ in digests]
    place = list(range(len(digests)))
    while len(digests) > 1:
        for leaf, p in enumerate(place):
            a = p // 16 * 16
            steps[leaf].append(("".join(digests[a:p]), "".join(digests[p + 1 : a + 16])))
        digests = [_h(*digests[a : a + 16]) for a in range(0, len(digests), 16)]
        place = [p // 16 for p in place]
    return digests[0], steps


def _plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: b"" if g is None else b"s" + g.encode())
    tops, out = [], []
    for g in names:
        leaves = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r[:3])))
        top, steps = _tree([_leaf(r[:3]) for r in leaves])
        tops.append(top)
        out.append((leaves, steps, top))
    root, above = _tree(tops)
    return sorted(
        (
            (r[0], _leaf(r[:3]), top, root, tuple(s + up))
            for (leaves, steps, top), up in zip(out, above, strict=True)
            for r, s in zip(leaves, steps, strict=True)
        ),
        key=repr,
    )


def _rows(kind):
    rng = random.Random(kind)
    row = lambda i, s: (i, s, rng.choice([None, "", "Straße", "a:b", "x" * 5000, "B\nC"]), "l", "r", 1, 2)
    if kind == "mixed":  # a hot group over three levels, short groups, ties, repeats, nulls
        out = [row(i, "hot") for i in range(4200)] + [row(i, "b") for i in range(17)] + [row(i, None) for i in range(3)]
        out += [row(i, f"g{i}") for i in range(40)] + [row(None, "b"), row(None, "b"), row(5, ""), row(5, "")]
        return out + out[4190:4230]
    return {"lone": [row(1, "a")], "group": [row(i, "a") for i in range(257)], "tops": [row(1, f"{i:04}") for i in range(300)]}[kind]


@pytest.mark.parametrize("kind", ["mixed", "lone", "group", "tops"])
def test_against_plain_tree(spark, kind):
    rows = _rows(kind)
    docs = spark.createDataFrame(rows, ROW).repartition(3)
    out = merkle.manifest(docs, merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "text")]))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "steps"]
    folded = out.select("*", merkle.fold(F.col("leaf"), F.col("steps")).alias("folded"), merkle.siblings(F.col("steps")).alias("sib")).collect()
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.steps)) for r in folded), key=repr)
    assert got == _plain(rows)
    assert all(r.folded == r.root for r in folded)
    assert all(r.sib == "".join(s.left + s.right for s in r.steps) for r in folded)


def test_tampering_is_seen(spark):
    docs = spark.createDataFrame(_rows("mixed"), ROW)
    leaf = lambda text: merkle.leaf_digest(F.col("doc_id"), F.col("source"), text)
    out = merkle.manifest(docs, leaf(F.col("text")), carry={"other": leaf(F.lower("text"))})
    seen = out.select((F.col("leaf") == F.col("other")).alias("same"), (merkle.fold(F.col("other"), F.col("steps")) == F.col("root")).alias("ok"))
    assert {tuple(r) for r in seen.distinct().collect()} == {(True, True), (False, False)}


def test_empty_and_reserved(spark):
    docs = spark.createDataFrame([], ROW)
    out = merkle.manifest(docs, merkle.leaf_digest(F.col("text")), carry={"more": F.col("text")})
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "steps", "more"] and out.count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(docs, merkle.leaf_digest(F.col("text")), carry={"rank": F.lit(1)})
