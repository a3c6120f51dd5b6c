"""Hash-based draws, orders and shard numbers: the same on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*parts) -> Column:
    return F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def _hex_number(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def draw_index(seed, keys, size) -> Column:
    """Zero-based pick below ``size``, fixed by ``seed`` and ``keys`` alone.

    Never ``rand()``: a retried task or another partitioning must draw the same.
    """
    digest = F.md5(_text(F.lit(str(seed)), *keys))
    return _hex_number(digest, 1, 8) % size


def shuffle_key(seed, *keys) -> Column:
    """Uniform 60-bit number fixed by ``seed`` and ``keys``."""
    return _hex_number(F.md5(_text(F.lit(str(seed)), *keys)), 1, 15)


SHUFFLE_KEY_BITS = 60


def shard_of(key, n: int) -> Column:
    """``int(md5(key), 16) mod n``, folded over four 32-bit pieces so it stays in BIGINT."""
    if not 0 < n < 2**31:
        raise ValueError("shard count must be between 1 and 2^31 - 1")
    digest = F.md5((F.col(key) if isinstance(key, str) else key).cast("string"))
    step = F.lit(2**32 % n).cast("bigint")
    acc = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        acc = (acc * step + _hex_number(digest, start, 8)) % F.lit(n).cast("bigint")
    return acc.cast("int")
