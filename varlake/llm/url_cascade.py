"""URL verdicts from longest rules and an exact Bloom filter cascade, in built-in functions only.

Level 0 encodes the listed keys. Keys of the corpus that it takes for listed are encoded in level
1, listed keys that level 1 takes for unlisted in level 2, and so on until no key is taken wrongly.
As the levels are built over every key of the corpus, the first level that lacks a key tells
exactly whether it is listed, and no key table is joined to the pages.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlake.llm.store import stored

HASHES = 4
BITS_PER_KEY = 8
# Bits of all levels that are sent to every task; a larger list is refused, see build_cascade.
MOST_BITS = 1 << 30


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest (verdict, host, path) rule that fits, else nulls.

    A rule fits its host and all its subdomains where the path starts with the rule's. Longer is
    by host and path together; of equally long ones a block goes first.
    """
    out = F.lit(None)
    kind = "struct<rule:string,verdict:string>"
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out.cast(kind))
    return out.cast(kind)


# Filter words are kept in chunks of this many, 63 bits a word.
CHUNK = 1024


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


def _filter(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the words of a Bloom filter in order, in chunks of ``CHUNK``.

    A row of zero for every word leaves no gap, so words are put in order by sorting alone: first
    within each chunk, then the chunks.
    """
    spots = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, i, bits) for i in range(HASHES)])).alias("bit"))
    cells = spots.select(F.floor(F.col("bit") / 63).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 63 AS int))").alias("v"))
    none = keys.sparkSession.range(bits // 63).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("v"))
    words = cells.unionByName(none).groupBy("word").agg(F.bit_or("v").alias("v"))

    def in_order(place: str, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value])

    chunks = words.groupBy(F.floor(F.col("word") / CHUNK).alias("chunk")).agg(in_order("word", "v").alias("v"))
    return chunks.agg(in_order("chunk", "v").alias("words"))


def _hit(words: Column, key: Column, level: int, bits: int) -> Column:
    ok = F.lit(True)
    for i in range(HASHES):
        bit = _bit(key, level, i, bits)
        chunk = F.element_at(words, F.floor(bit / (63 * CHUNK)).cast("int") + 1)
        word = F.element_at(chunk, F.floor(bit % (63 * CHUNK) / 63).cast("int") + 1)
        ok = ok & (F.call_function("getbit", word, (bit % 63).cast("int")) == 1)
    return ok


@dataclass
class Cascade:
    """The levels in order: (bits, one-row table of filter words)."""

    levels: list[tuple[int, DataFrame]]

    def listed(self, key: Column) -> Column:
        """Is ``key``, one of the universe's, a listed one?"""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            bits, words = self.levels[level]
            out = F.when(_hit(words.scalar(), key, level, bits), out).otherwise(F.lit(level % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 40) -> Cascade:
    """A cascade over one-column tables ``key``; keys of ``listed`` beyond the universe don't count.

    Null keys are never listed. Filters grow with the list, not with the universe; should all
    levels need more than ``MOST_BITS``, it raises rather than send them to every task.
    """
    # Each key with its truth; both tables are made distinct by partial aggregation.
    marked = universe.select("key", F.lit(0).alias("on")).unionByName(listed.select("key", F.lit(2).alias("on")))
    both = marked.where("key IS NOT NULL").groupBy("key").agg(F.max("on").alias("top"), F.min("on").alias("low"))
    truth = stored(both.where("low = 0").select("key", (F.col("top") == 2).alias("on")), "keys")
    inside, outside = truth.where("on").select("key"), truth.where("NOT on").select("key")
    levels: list[tuple[int, DataFrame]] = []
    total = 0
    while True:
        n = inside.count()
        if n == 0:
            return Cascade(levels)
        level = len(levels)
        bits = 63 * max(1, math.ceil(n * BITS_PER_KEY / 63))
        total += bits
        if total > MOST_BITS:
            raise ValueError(f"{n} keys need more than {MOST_BITS} bits; split the list by host hash")
        if level == most_levels:
            raise RuntimeError("keys that no level tells apart")
        words = stored(_filter(inside, level, bits), "filter")
        levels.append((bits, words))
        wrong = stored(outside.where(_hit(words.scalar(), F.col("key"), level, bits)), "wrong")
        inside, outside = wrong, inside


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], cascade: Cascade, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The longest rule decides; without one, the cascade blocks a listed host and allows others. A
    null url or one without ``://`` has an empty host and path. Columns of these names are
    replaced.
    """
    rest = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col])
    found = "_rule"
    while found in rest.columns:
        found += "_"
    out = rest.withColumn("host", host_of(url_col)).withColumn("path", path_of(url_col))
    out = out.withColumn(found, longest_rule(F.col("host"), F.col("path"), rules))
    listed = F.when(cascade.listed(F.col("host")), "block").otherwise("allow")
    return out.withColumn("rule", F.col(f"{found}.rule")).withColumn("verdict", F.coalesce(f"{found}.verdict", listed)).drop(found)


def junk_hosts(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = 0.5, symbols: int = 3) -> DataFrame:
    """Hosts (key) of which at least ``share`` of the pages hold ``symbols`` runs of three
    equal ones of ``# % $ & *`` within their markup."""
    runs = F.size(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"###|%%%|\$\$\$|&&&|\*\*\*|&amp;&amp;&amp;"), F.lit(0)))
    by = pages.select(host_of(url_col).alias("key"), (runs >= symbols).cast("int").alias("junk")).where("key != ''")
    return by.groupBy("key").agg(F.sum("junk").alias("j"), F.count("*").alias("n")).where(F.col("j") >= share * F.col("n")).select("key")
