"""The thirteen dealt operators as registered queries over whole tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlake.llm import langid, merkle
from varlake.llm.jaccard import jaccard_join
from varlake.llm.line_dedup import dedup_lines
from varlake.llm.lm_lattice import lattice_scores
from varlake.llm.packing import pack
from varlake.llm.quality import COUNTS, quality_rules
from varlake.llm.simhash_trie import simhash_join
from varlake.llm.spelling import spelling_variants
from varlake.llm.suffix_pieces import digests
from varlake.llm.topk_blocks import top_k
from varlake.llm.url_cascade import build_cascade, host_of, judge, junk_hosts
from varlake.llm.warc import read_warc, write_warc
from varlake.session import scratch_path

QUERIES = {}
ORACLES = {}

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(
    r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), owner AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT doc_id, pos, line, first IS NULL OR first = doc_id AS keep
  FROM keyed LEFT JOIN owner USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"), min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n
  HAVING 100 * count(*) >= 90 * (nx.n + ny.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.r) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id
GROUP BY d.doc_id
"""
)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def _crc32(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


@query()
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _crc32("doc_id") % 4 == 2)
    model = langid.fit(docs.where(~F.coalesce("held_out", F.lit(False))))
    found = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query(
    r"""
WITH p AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), listed AS (
  SELECT host FROM p WHERE host <> '' GROUP BY host
  HAVING sum(CASE WHEN len(regexp_extract_all(coalesce(html, ''),
    '###|%%%|\$\$\$|&&&|\*\*\*|&amp;&amp;&amp;')) >= 3 THEN 1 ELSE 0 END) >= 0.5 * count(*)
), rule(verdict, h, q) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id)
"""
)
def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    cascade = build_cascade(junk_hosts(pages), pages.select(host_of("url").alias("key")))
    return judge(pages.select("page_id", "url"), URL_RULES, cascade).select("page_id", "host", "path", "rule", "verdict")


@query(
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w::DOUBLE[], c.w::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
)
def op4_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def _public_pieces() -> list[tuple[str, float]]:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@query()
def op1_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(_table(spark, sf_dir, "documents"), _crc32("doc_id") % 5 == 1, _public_pieces(), ranks=True)


@query()
def op8_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    found = digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"))


@query(
    """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((('0x' || substr(hex || '0', 1 + (5 * i) // 4, 2))::BIGINT >> (3 - (5 * i) % 4)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""
)
def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), target, least=0)
    return read_warc(spark, target).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join(_table(spark, sf_dir, "documents"), shingle=4, differ=4)


# CRC-32 in SQL: the table of its 256 steps, and the fold over a text's bytes in hexadecimal.
_CRC_STEPS = """list_transform(range(256), lambda b: list_reduce([b] || range(8),
  lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def _sql_crc32(text: str, steps: str) -> str:
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, {steps}[1 + (xor(c, b) & 255)])), 4294967295)"


def _sql_framed(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_framed(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_SQL_RUNS = "unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{6,}'))"
_SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_ABOVE = "array_to_string(list_transform(range(0, (length(s) + 1023) // 1024), lambda i: sha256(substr(s, 1 + 1024 * i, 1024))), '')"
_SQL_STEP = """substr(s, 1 + 1024 * (p // 16 ** (k + 1))::BIGINT, 64 * ((p // 16 ** k) % 16)::BIGINT) || 'X'
  || substr(substr(s, 1 + 1024 * (p // 16 ** (k + 1))::BIGINT, 1024), 65 + 64 * ((p // 16 ** k) % 16)::BIGINT)""".replace("16 ** (k + 1)", "pow(16, k + 1)::BIGINT").replace("16 ** k", "pow(16, k)::BIGINT")


@query(
    f"""
WITH RECURSIVE crc AS (SELECT {_CRC_STEPS} AS steps),
d AS (
  SELECT doc_id, coalesce('s' || source, '') AS g, {_sql_leaf("text")} AS leaf,
    CASE WHEN {_sql_crc32("doc_id::VARCHAR", "steps")} % 5 = 0 THEN {_sql_leaf(_SQL_LOWER.format("text"))} END AS changed
  FROM documents, crc
), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
lev AS (
  SELECT g, 0 AS k, string_agg(leaf, '' ORDER BY p) AS s FROM n GROUP BY g
  UNION ALL SELECT g, k + 1, {_SQL_ABOVE} FROM lev WHERE length(s) > 64
), sub AS (SELECT g, s AS subroot, row_number() OVER (ORDER BY g) - 1 AS q FROM lev WHERE length(s) = 64),
up AS (
  SELECT 0 AS k, string_agg(subroot, '' ORDER BY q) AS s FROM sub
  UNION ALL SELECT k + 1, {_SQL_ABOVE} FROM up WHERE length(s) > 64
), step AS (
  SELECT g, p, k, {_SQL_STEP} AS x FROM n JOIN lev USING (g) WHERE length(s) > 64
  UNION ALL
  SELECT g, m.p, 1000 + k, x FROM n m JOIN (SELECT g, k, {_SQL_STEP} AS x FROM (SELECT g, q AS p FROM sub), up WHERE length(s) > 64) USING (g)
), proof AS (SELECT g, p, list(x ORDER BY k) AS x FROM step GROUP BY g, p),
folded AS (
  SELECT doc_id, leaf, subroot, coalesce(x, []::VARCHAR[]) AS steps, coalesce(changed, leaf) AS shown
  FROM n JOIN sub USING (g) LEFT JOIN proof USING (g, p)
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), 'X', '')) AS proof_sha256,
  list_reduce([shown] || steps, lambda a, b: sha256(replace(b, 'X', a))) AS folded_root, folded_root = root AS verified
FROM folded, (SELECT s AS root FROM up WHERE length(s) = 64)
"""
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    row = ("doc_id", "source", "lang", "n_chars")
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = merkle.leaf_digest(*[F.col(c) for c in row], F.col("text"))
    changed = F.when(_crc32("doc_id") % 5 == 0, merkle.leaf_digest(*[F.col(c) for c in row], tampered))
    rows = merkle.manifest(docs, leaf, "doc_id", "source", {"changed": changed})
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("steps")))
    proof = F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query(
    f"""
WITH RECURSIVE crc AS (SELECT {_CRC_STEPS} AS steps),
run AS (
  SELECT doc_id, {_SQL_LOWER.format(_SQL_RUNS)} AS r FROM documents
), once AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || r AS named, r, count(*) AS c FROM run GROUP BY ALL),
hashed AS (SELECT r, c, {_sql_crc32("named", "steps")} AS h FROM once, crc),
shown AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, c FROM hashed
), w AS (SELECT word, sum(c)::BIGINT AS n FROM shown WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
del AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT del.word, w.word FROM del JOIN w ON del.d = w.word
  UNION SELECT w.word, del.word FROM del JOIN w ON del.d = w.word
), ranked AS (
  SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS place
  FROM near JOIN w ON w.word = other
), v AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM w LEFT JOIN ranked ON ranked.word = w.word AND place = 1
), chain AS (
  SELECT word, word AS root, 0 AS steps FROM v
  UNION ALL SELECT chain.word, v.form, steps + 1 FROM chain JOIN v ON v.word = root WHERE v.form IS NOT NULL
)
SELECT word, form, arg_max(root, steps) AS root, n, n_near, form_n FROM v JOIN chain USING (word) GROUP BY ALL
"""
)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(_table(spark, sf_dir, "documents"), chars=6, least=5, factor=5, every=199)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
