"""The training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import collections
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from varlake.llm import langid, line_dedup, lm_lattice, quality, queries, suffix_pieces, topk_blocks, url_cascade, warc
from varlake.llm.components import components
from varlake.llm.jaccard import jaccard_join
from varlake.llm.line_dedup import dedup_lines
from varlake.llm.packing import pack, plan_bins
from varlake.session import scratch_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key long"


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows: null, empty, blank, repeated, tied, long, and columns with clashing names."""
    rng = random.Random(1)
    vocab = ["the", "of", "Ärger", "naïve", "x1", "a", "bb", "ccc", "Word,", "END."] + [f"w{i}" for i in range(60)]
    base = " ".join(rng.choice(vocab) for _ in range(60))
    texts = [None, "", " \n\t", "one", "two words", base, base, base.upper(), base + " tail", base.replace("w1", "w2", 1)]
    texts += ["\n".join(" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(6)) + "\nA shared line here\n" for _ in range(20)]
    texts += [" ".join(rng.choice(vocab) for _ in range(30_000))]
    rows = [(i, t, ["en", "de", None][i % 3], "s", 0, "r", i) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s", 0, "r", 3), (None, base, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark, empty):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, 7), (1, 2), (1, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (1, 75)])
def test_jaccard_join(spark, k, num):
    rng = random.Random(num)
    rows, n = [], 0
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 60, 150]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, " "), (n + 2, rows[0][1]), (n + 3, "a"), (n + 4, "A")]
    sets = {}
    for i, t in rows:
        w = _words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in root):
            break
    got = {r[0]: (r[1], r[2]) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k, num=num).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_line_dedup(docs):
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    first = {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), r.doc_id), r.doc_id)
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append((r.text, r.n_lines, r.n_dropped))
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), r.doc_id) == r.doc_id]
        want = (None if r.text is None else "\n".join(kept), len(lines), len(lines) - len(kept))
        assert set(by[r.doc_id]) == {want}
    assert len(by[3]) == 2 and by[None][0][2] == 0


def test_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = pack(docs, path, capacity=256).collect()
    bins, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    for r in docs.dropDuplicates(["doc_id"]).collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want = {(k // 256, k, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k in range(0, len(ids), 256) for p in [ids[k : k + 256]]}
        assert set(by[r.doc_id]) == want
    lengths = [r.length for r in got]
    assert len(bins) <= max(-(-sum(lengths) // 256), sum(2 * n > 256 for n in lengths)) + 1


@pytest.mark.parametrize("seed", range(20))
def test_plan_bins_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 20) for _ in range(8)]

    def fewest(left, bins):
        if not left:
            return len(bins)
        best = len(bins) + len(left)
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + left[0] <= 20:
                best = min(best, fewest(left[1:], bins[:i] + (bins[i] + left[0],) + bins[i + 1 :]))
        return min(best, fewest(left[1:], (*bins, left[0])))

    plan = plan_bins(collections.Counter(sizes), 20)
    placed = collections.Counter(x for pattern, n in plan for x in pattern for _ in range(n))
    assert placed == collections.Counter(sizes) and all(sum(p) <= 20 for p, _ in plan)
    assert sum(n for _, n in plan) == fewest(sorted(sizes, reverse=True), ())


def test_quality_counts(docs):
    rows = docs.collect()
    got = quality.measure([None if r.text is None else r.text.encode() for r in rows])
    for i, r in enumerate(rows):
        w = WORD.findall(r.text or "")
        seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        repeats = {j + x for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for x in range(8)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(repeats))
        assert tuple(int(got[c][i]) for c in quality.COUNTS) == want


def test_upper_bound_is_exact():
    for k, n, e in [(0, 50, 0.05), (3, 100, 0.01), (10, 10, 0.1)]:
        p = quality.upper_bound(k, n, e)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert p == 1.0 if k == n else tail == pytest.approx(e, rel=1e-6)


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == docs.count() and all(r.kept != r.base_failed for r in got)
    assert quality.quality_rules(empty, labels).count() == 0
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.keep_good(table, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept.columns == table.columns and 0 < kept.count() <= table.count()


def _measured(spark, groups):
    """Measured documents and their labels, from (stratum, quality or None, rows, {signal: value})."""
    rows = [(stratum, label, *(float(values.get(x, 0)) for x in quality.SIGNALS)) for stratum, label, n, values in groups for _ in range(n)]
    kinds = ", ".join(["id long", "stratum string", "quality int", *(f"{x} double" for x in quality.SIGNALS)])
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], kinds)
    return table.drop("quality").withColumn("base_failed", F.lit(False)), table.selectExpr("id AS doc_id", "quality")


def test_quality_cutoffs_need_the_stratum_s_own_labels(spark):
    measured, labels = _measured(spark, [
        ("big", 1, 2000, {}), ("big", 0, 2000, {"symbols": 3}),
        ("tiny", 1, 40, {"symbols": 3}), ("unseen", None, 30, {"symbols": 3}),
        ("clean", 1, 600, {}),
    ])
    cutoffs = quality.fit(measured, labels)
    assert cutoffs["big", "symbols"] < 3
    kept = {(r.stratum, r.s): r.n for r in measured.where(quality._passes(cutoffs)).groupBy("stratum", F.col("symbols").alias("s")).agg(F.count("*").alias("n")).collect()}
    assert kept == {("big", 0): 2000, ("tiny", 3): 40, ("unseen", 3): 30, ("clean", 0): 600}
    # The proposal of all strata holds where the stratum's own labels certify it.
    assert cutoffs["clean", "symbols"] < 3


def test_quality_signals_share_the_risk(spark):
    """Each of three signals rejects 2.5% of the good documents, all together 7.5%."""
    names = ("symbols", "shouts", "stutters")
    groups = [("en", q, n, {x: 0.9}) for x in names for q, n in ((1, 100), (0, 2500))]
    measured, labels = _measured(spark, [("en", 1, 3700, {}), *groups])
    cutoffs = quality.fit(measured, labels)
    assert cutoffs
    good = measured.join(labels.where("quality = 1"), F.col("id") == F.col("doc_id"))
    assert 0.95 * 4000 <= good.where(quality._passes(cutoffs)).count() < 4000


def test_language_id(spark, docs, empty):
    found = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs.drop("lang"), model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


@pytest.mark.parametrize("ranks", [False, True])
def test_lattice_marginal_is_the_sum_over_segmentations(ranks):
    p = lm_lattice.pieces([("▁a", -1.0), ("▁ab", -2.0), ("b", -3.0), ("bc", -4.0), ("c", -5.0), ("▁", -6.0), ("abc", -7.0)], ranks)
    start = dict(zip(p.start.tolist(), p.start_log, strict=True))
    inner = dict(zip(p.inner.tolist(), p.inner_log, strict=True))

    def total(word, first):
        if not first and not word:
            return math.exp(p.stop_log)
        out = 0.0
        for n in range(0 if first else 1, len(word) + 1):
            key = int(lm_lattice.hashes([word[:n]])[0])
            table = start if first else inner
            if key in table:
                out += math.exp(table[key]) * total(word[n:], False)
        return out

    words = [b"abc", b"ab", b"cab", b"a", "é".encode()]
    assert np.exp(lm_lattice.spell(p, words)) == pytest.approx([total(w, True) for w in words])


def test_lattice_scores(docs, empty):
    vocabulary = [("▁w", -1.0), ("▁t", -2.0), ("he", -3.0)]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = {r.doc_id: r for r in lm_lattice.lattice_scores(docs, held, vocabulary, ranks=True).collect()}
    rows = [(r.doc_id, [*_words(r.text), None]) for r in docs.collect()]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, ws in rows if not is_held(i) for w in ws)
    n, v = c.total(), len(c)
    for i, ws in rows:
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, is_held(i))
        assert r.base_score == pytest.approx(want) and math.isfinite(r.score) and r.score < 0
    assert lm_lattice.lattice_scores(empty, held, vocabulary).count() == 0


def test_unigram_scores_are_used_as_they_are(spark):
    """Whole scores against an enumeration of all segmentations under the vocabulary's own scores."""
    vocabulary = [("▁", -4.0), ("▁ab", -2.5), ("▁a", -3.5), ("b", -3.0), ("a", -3.25), ("ba", -5.0), ("c", -6.0)]
    table = dict(vocabulary)
    least = min(table.values()) - lm_lattice.UNKNOWN
    byte = lambda b: table.get(chr(b), least)

    def inner(word):
        if not word:
            return 1.0
        longer = (math.exp(table[word[:n].decode()]) * inner(word[n:]) for n in range(2, len(word) + 1) if word[:n].isascii() and word[:n].decode() in table)
        return math.exp(byte(word[0])) * inner(word[1:]) + sum(longer)

    def marginal(word):
        return sum(math.exp(table["▁" + word[:n].decode()]) * inner(word[n:]) for n in range(len(word) + 1) if word[:n].isascii() and "▁" + word[:n].decode() in table)

    texts = ["ab ba ab", "Abba caba", "é ab", None, "", "ab cab ba baab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_lattice.lattice_scores(docs, F.col("doc_id") >= 4, vocabulary).collect()}
    words = [[w.lower().encode() for w in (t or "").split()] for t in texts]
    c = collections.Counter(w for ws in words[:4] for w in ws)
    tokens, types, ends = c.total() + 4, len(c) + 1, 4
    for i, ws in enumerate(words):
        each = [max(c[w] - lm_lattice.DISCOUNT, 0) / tokens + lm_lattice.DISCOUNT * types / tokens * marginal(w) for w in ws]
        want = sum(map(math.log10, each)) + math.log10((ends - lm_lattice.DISCOUNT) / tokens)
        assert got[i] == pytest.approx(want)


def test_warc_round_trip(spark):
    rows = [(5, "http://a/", "same"), (2, "http://b/", "same"), (9, None, None), (3, "x\r\ny", ""), (None, "http://n/", "same"), (4, "u", "long " * 50_000)]
    target = scratch_path(spark, "warc")
    made = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), target, file_bytes=200)
    assert made.agg(F.sum("records")).first()[0] == len(rows) and made.count() > 1
    got = {r.key: r for r in warc.read_warc(spark, target).collect()}
    for key, _, html in rows:
        data = (html or "").encode()
        assert got[key].payload_bytes == len(data) and got[key].payload_digest == warc.payload_digest(data)
        assert got[key].payload is None or bytes(got[key].payload) == data
    assert (got[5].record_type, got[5].refers_to) == ("revisit", 2) and got[9].refers_to == 3
    assert got[2].record_type == got[3].record_type == got[None].record_type == "response"


def test_warc_keeps_every_payload_of_a_key(spark):
    """A key's rows are responses or revisits each by its own payload."""
    rows = [(2, "a", "same"), (5, "b", "same"), (5, "c", "UNIQUE payload"), (5, "d", "UNIQUE payload"), (None, "e", "x"), (None, "f", "y")]
    target = scratch_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), target)
    got = sorted(((r.key or 0, r.uri, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_warc(spark, target).collect()), key=repr)
    assert got == sorted([
        (0, "e", "response", None, b"x"), (0, "f", "response", None, b"y"), (2, "a", "response", None, b"same"),
        (5, "b", "revisit", 2, None), (5, "c", "response", None, b"UNIQUE payload"), (5, "d", "response", None, b"UNIQUE payload"),
    ], key=repr)


def test_warc_is_deterministic(spark):
    """Written twice, from other partitions and with other jobs in between: the same files."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    made = []
    for parts in (3, 11):
        target = scratch_path(spark, "warc")
        made.append(sorted(map(tuple, warc.write_warc(df.repartition(parts), target, file_bytes=20_000).collect())))
    assert made[0] == made[1] and len(made[0]) > 40
    empty = warc.write_warc(df.limit(0), scratch_path(spark, "warc"))
    assert empty.count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("h"), F.col("id")).alias("key"))
    listed = universe.where("hash(key) % 7 = 0").unionByName(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    cascade = url_cascade.build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    got = {r.key for r in universe.where(cascade.listed(F.col("key"))).collect()}
    assert got == {r.key for r in universe.where("hash(key) % 7 = 0").collect()}
    none = url_cascade.build_cascade(listed.limit(0), universe)
    assert universe.where(none.listed(F.col("key"))).count() == 0


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x?y#z", "a://example.org/en/12", "b://x.com", "c://com/fr/?q", "d://de.com/de/1", "e://h?x://y/z"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    cascade = url_cascade.build_cascade(spark.createDataFrame([("x.com",)], "key string"), df.select(url_cascade.host_of("url").alias("key")))
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(df, queries.URL_RULES, cascade).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("x.com", "", None, "block"), ("com", "/fr/", "com/fr/", "allow"), ("de.com", "/de/1", "com/de/", "block"), ("h", "", None, "allow"),
    ]


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(700)]
    rows += [(700, rows[0][1]), (701, rows[0][1]), (702, None), (703, [None] * 6), (704, [float("nan")] * 6), (705, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_blocks.top_k(df, F.col("vec_id") % 50 == 0, rows_per_shard=200).collect()
    usable = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q, w in usable.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for i, v in usable.items() if i != q and len(v) == len(w))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])}
    assert {tuple(r) for r in got} == want


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    coded = suffix_pieces.encode(rows, path)
    got = {r.doc_id: r.ids for r in coded.collect()}
    back = {r.doc_id: r.text for r in suffix_pieces.decode_ids(coded, path).collect()}
    for r in rows.collect():
        assert got[r.doc_id] == (None if r.text is None else model.encode(r.text))
        assert back[r.doc_id] == r.text


def test_unigram_best_path():
    v = suffix_pieces.Vocabulary(["<unk>", "▁", "▁a", "a", "b", "ab", "▁ab", "c"], np.array([0, -2, -3, -2.5, -2.25, -3.5, -6, -4.0]), np.array([False] + [True] * 7), {}, 0, False)

    def best(word):
        found = {0: 0.0}
        for i in range(len(word)):
            for n in range(1, v.longest + 1):
                if i in found and word[i : i + n] in v.places and i + n <= len(word):
                    found[i + n] = max(found.get(i + n, -math.inf), found[i] + v.scores[v.places[word[i : i + n]]])
        return found[len(word)]

    words = ["▁ab", "▁aab", "▁abab", "▁cab", "b"]
    for word, ids in zip(words, suffix_pieces.encode_words(v, words), strict=True):
        assert "".join(v.pieces[i] for i in ids) == word
        assert v.scores[ids].sum() == pytest.approx(best(word))


def test_pipeline(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == table.columns
        path = scratch_path(spark, "stage")
        out.write.parquet(path)
        kept = spark.read.parquet(path)
    packed = corpus_pipeline.packing(spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    assert kept.join(good, "doc_id").count() >= 0.8 * table.join(good, "doc_id").count()



def test_columns_of_clashing_names(spark, docs):
    """Counts replace columns of their names, and a helper column takes none of the table's."""
    clash = docs.withColumn("n_lines", F.lit("x")).withColumn("n_dropped", F.lit(None).cast("int"))
    got = dedup_lines(clash)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"] and got.dtypes[-2:] == [("n_lines", "bigint"), ("n_dropped", "bigint")]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, dedup_lines(docs).collect()))
    pages = spark.createDataFrame([(1, "a://x.org/y", "kept", "old")], "page_id long, url string, _rule string, verdict string")
    cascade = url_cascade.build_cascade(pages.selectExpr("'none' AS key"), pages.select(url_cascade.host_of("url").alias("key")))
    judged = url_cascade.judge(pages, queries.URL_RULES, cascade).first()
    assert (judged._rule, judged.rule, judged.verdict) == ("kept", "org/", "allow")


def test_keep_bitmaps():
    for n, dropped in [(1, [0]), (9, [0, 8]), (40, [3]), (17, [15, 16])]:
        keep = line_dedup.unpack_bitmap(line_dedup.pack_bitmap(np.array(dropped)), n)
        assert np.flatnonzero(~keep).tolist() == dropped and len(keep) == n


def test_cascade_of_many_keys(spark):
    """A hundred thousand listed keys over several chunks of filter words."""
    universe = spark.range(200_000).select(F.concat(F.lit("h"), F.col("id")).alias("key"))
    cascade = url_cascade.build_cascade(universe.where("hash(key) % 2 = 0"), universe)
    assert universe.where(cascade.listed(F.col("key")) != F.expr("hash(key) % 2 = 0")).count() == 0


def test_top_k_in_query_groups(spark):
    """Groups and shards don't show in the result; a repeated query id asks with its smallest vector."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)] + [(0, [0.5, -0.25, 0.0, 1.0]), (0, [-2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    cut = [tuple(map(tuple, topk_blocks.top_k(df, F.col("vec_id") % 5 == 0, rows_per_shard=a, queries_per_group=b).collect())) for a, b in [(70, 9), (50_000, 20_000)]]
    assert set(cut[0]) == set(cut[1]) and len(cut[0]) == 60 * 5
    best = sorted((-math.floor(256 * -2.0) * math.floor(256 * v[0]), i) for i, v in rows if i != 0)[:5]
    assert [(r[2], r[3]) for r in sorted(cut[0]) if r[0] == 0] == [(i, -s) for s, i in best]


@pytest.mark.parametrize("num", [80, 90])
def test_jaccard_last_pairs_are_few_and_lose_no_link(spark, num):
    """Nodes that share a passage which their pivot lacks, but don't link, are not all held against each other."""
    import random

    from varlake.llm import jaccard

    rng = random.Random(num)
    passage, rows = list(range(20)), []
    for _ in range(60):
        own = rng.sample(range(100, 100_000), 28)
        for _ in range(4):
            d = {*passage, *own} ^ set(rng.sample([*passage, *own, *range(100, 200)], rng.randrange(17)))
            rows.append((len(rows), rng.randrange(110, 150), d))
    for _ in range(60):  # near the pivot: these may link without a shared difference
        rows.append((len(rows), rng.randrange(60, 150), set(rng.sample(range(200_000, 200_400), rng.randrange(30)))))
    most = lambda n: (100 - num) * (n + n * 100 // num) // (100 + num)
    made = [(1, node, n, node, most(n), sorted(d)) for node, n, d in rows]
    apart = spark.createDataFrame(made, "scope long, node long, n long, root long, most int, d array<long>")
    got = jaccard._cross(jaccard._crowded(jaccard._difference_keys(apart)), num, 100)
    pairs = {(r["a"], r["b"]) for r in got.collect()}
    near = lambda n, m: 100 * min(n, m) >= num * max(n, m)
    links = {(a, b) for a, n, d in rows for b, m, e in rows if a < b and near(n, m) and len(d ^ e) <= (100 - num) * (n + m) // (100 + num)}
    assert len(links) > 50 and links <= pairs
    assert len(pairs) < 4 * len(links)


def test_small_tables_are_stored_in_few_files(spark, monkeypatch):
    from varlake.llm import components as C
    from varlake.llm import jaccard as J

    files = {}

    def cut(df, *a, cut=C.cut_lineage):
        out = cut(df, *a)
        files.setdefault("edges", []).append(out.rdd.getNumPartitions())
        return out

    def store(df, name, *a, stored=J.stored):
        out = stored(df, name, *a)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(C, "cut_lineage", cut)
    monkeypatch.setattr(J, "stored", store)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(old, ("40", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        words = [[f"w{i}-{j}" for j in range(60)] for i in range(40)]
        texts = [" ".join([*w[:at], "x", *w[at:]]) for w in words for at in (0, 30, 60)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join(df).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: i // 3 * 3 for i in range(120)}
    rounds = files["edges"][1:]  # the first table of edges has no bound
    assert rounds.count(1) >= 2 and rounds.count(40) <= 4
    assert all(max(files[name]) <= 2 for name in ("agreeing", "live", "wanted", "pairs", "links"))
