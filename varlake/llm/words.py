"""Words and lines of whole Arrow text batches as NumPy arrays, for the Arrow-based operators.

A text is cut into slices of bounded size at white space, so memory follows the slice and the
batch, not the longest word list. Hashes are 64-bit: a polynomial over random byte values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
# Bytes hashed at a time: each takes some thirty in arrays, which a core's cache should hold.
STEP = 1 << 17
_MASK = (1 << 64) - 1

_byte = np.arange(256)
SPACE = (_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D))
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
SAME = _byte.astype(np.uint8)
LETTER = ((_byte | 32) >= 97) & ((_byte | 32) <= 122)
PUNCT = (_byte > 32) & (_byte < 127) & ~LETTER & ~((_byte >= 48) & (_byte <= 57)) & (_byte != 39)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15
_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, STEP + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; nulls stay null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def groups(sizes: list[int], most: int = 4 * SLICE) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts of at most ``most`` bytes; a longer text stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line break after each text, and the place where each text starts."""
    parts = [t or b"" for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), at


def _slices(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    start, n = 0, len(buf)
    while start < n:
        end = min(n, start + STEP)
        if end < n:
            back = np.flatnonzero(SPACE[buf[start:end]])
            if len(back):
                end = start + int(back[-1]) + 1
            else:  # a word longer than a slice: up to its end
                while end < n:
                    ahead = np.flatnonzero(SPACE[buf[end : end + STEP]])
                    if len(ahead):
                        end += int(ahead[0])
                        break
                    end = min(n, end + STEP)
        yield start, end
        start = end


def words(buf: np.ndarray, lower: bool = True, cut_punct: bool = False):
    """Start, end and hash of every run of bytes other than ``[\\x20\\x09-\\x0D]``.

    ``cut_punct`` also cuts between an ASCII letter and ASCII punctuation.
    """
    table = LOWER if lower else SAME
    starts, ends, hashes = [], [], []
    for a, b in _slices(buf):
        part = table[buf[a:b]]
        inside = ~SPACE[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        if cut_punct:
            letter, punct = LETTER[part], PUNCT[part]
            cut = (letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:])
            first[1:] |= cut
            last[:-1] |= cut
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * _power("up", _BASE, len(part)), out=sums[1:])
        back = _power("down", pow(_BASE, -1, 1 << 64), len(part))
        hashes.append(mix((sums[e] - sums[s]) * back[s]))
        starts.append(s + a)
        ends.append(e + a)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def code_points(buf: np.ndarray) -> np.ndarray:
    """Running count of UTF-8 code points: entry i counts those that start before byte i."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out + hashes[i : i + n]) * np.uint64(_BASE)
    return mix(out)


def segment_sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Wrapping 64-bit sums of ``values`` by ``index``; exact for up to 2**20 values in a cell."""
    low = np.bincount(index, weights=(values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(index, weights=(values >> np.uint64(32)).astype(np.float64), minlength=n)
    return (high.astype(np.uint64) << np.uint64(32)) + low.astype(np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[0], starts[0]+1, ... for each run of ``lengths``, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(total)
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
