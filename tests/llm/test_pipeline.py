"""The whole pipeline against a plain version, on a small corpus of planted cases."""

from __future__ import annotations

import collections
import random
import re
import struct
import zlib

import public_tokenizers
import pytest

from tests.llm.test_langid import plain_model, plain_predict

KINDS = "doc_id long, text string, lang string, source string, n_chars long, key string, count int"


def corpus():
    """Three languages; exact, near and upper-case copies, null and repeated ids, shared lines, junk."""
    rng = random.Random(8)
    vocab = {lang: ["".join(rng.choice(chars) for _ in range(rng.randrange(2, 9))) for _ in range(200)] for lang, chars in {"en": "abcdehinorst", "el": "αβγδεηικλνοπρστω", "fi": "aäöyklmpstuv"}.items()}
    shared = "this very line stands in many documents"
    rows, i = [], 10

    def text(lang, lines=4):
        return "\n".join(" ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(8, 16))) for _ in range(lines))

    for lang in vocab:
        for k in range(25):
            body = text(lang, rng.randrange(3, 9))
            rows.append((i, body + (f"\n{shared}" if k % 5 == 0 else ""), lang if k % 6 else None))
            i += 1
    first = rows[0][1].replace("\n", " ")
    words = first.split(" ")
    flat = " ".join(words)
    rows += [(5, flat, "en"), (6, flat.upper(), "en"), (None, flat + "  ", "en"), (None, flat + "  ", None), (7, flat + " tail", "en")]
    lone = " ".join(rng.choice(vocab["fi"]) for _ in range(60))
    rows += [(None, lone, "fi"), (None, lone, "fi"), (None, lone + " ", "fi")]  # no id at all
    rows += [rows[20], rows[20], (rows[21][0], text("en", 5), "en")]  # repeated rows; one id, two texts
    rows += [(900, None, "en"), (901, "", "en"), (902, " \n\t", None), (903, "12 34 " * 20, "en"), (904, "aa bb", "en"), (905, "one two three " * 30, "en")]
    rows += [(906, " ".join(rng.choice(vocab["el"]) for _ in range(5000)), "el")]
    return [(d, t, lang, "s", None if t is None else len(t), "x", 1) for d, t, lang in rows]


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def plain_run(rows):
    langs, tables = plain_model([(d, t, lang) for d, t, lang, *_ in rows])
    rows = [r for r in rows if (p := plain_predict(langs, tables, r[1]))[0] != "und" and p[1] >= 0.5]

    def base_ok(t):
        w = t.split()
        seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        again = {j + x for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for x in range(8)}
        return len(w) >= 20 and 100 * len(again) <= 30 * len(w)

    rows = [r for r in rows if base_ok(r[1])]
    key = lambda line: _lower(line.strip(" \t\n\v\f\r"))
    owner = {}
    for d, t, *_ in rows:
        for line in t.split("\n") if d is not None else []:
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), d), d)
    rows = [(r[0], "\n".join(x for x in r[1].split("\n") if r[0] is None or owner.get(key(x), r[0]) == r[0])) for r in rows]
    docs = sorted({r for r in rows if r[1].split()}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = []
    for _, t in docs:
        w = _lower(t).split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return docs, root


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), KINDS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_equals_the_plain_version(spark, folder):
    from tokenizers import Tokenizer

    import corpus_pipeline

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def pieces(d, t):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        return [(d, k // 2048, k, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k in range(0, len(ids), 2048) for p in [ids[k : k + 2048]]]

    docs, root = plain_run(corpus())
    groups = collections.defaultdict(list)
    for (d, t), r in zip(docs, root, strict=True):
        groups[r].append((d, t))
    assert any(len(g) > 2 for g in groups.values()) and len(groups) > 60
    got = corpus_pipeline.run(spark, folder).collect()
    made = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    for group in groups.values():
        # The smallest id stays; which of several texts of that id (or of no id) is settled by a hash.
        choices = [pieces(d, t) for d, t in group if d == group[0][0]]
        stayed = [c for c in choices if all(made[p] for p in c)]
        assert stayed
        made.subtract(stayed[0])
    assert not any(made.values())
    lengths = [r.length for r in got]
    bins = collections.Counter()
    for r in got:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(lengths) // 2048) + 1


def test_stages_keep_the_columns(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_quality_moves_no_texts(spark, folder, monkeypatch):
    import corpus_pipeline
    from tests.conftest import plan
    from varlake.llm import quality

    plans = {}

    def stored(df, name, keep=quality.stored):
        plans[name] = plan(df)
        return keep(df, name)

    monkeypatch.setattr(quality, "stored", stored)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    for text in (plans["measured"], plan(kept)):
        assert "MapInArrow" in text and "Exchange" not in text and "Join" not in text
