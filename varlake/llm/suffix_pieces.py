"""SentencePiece encoding by suffix-array matching, and decoding.

A batch's distinct words are laid end to end and their suffixes sorted by as many characters as
the longest piece has. Each piece is looked up by binary search for the range of suffixes that
begin with it; the occurrences, ordered by position, are the edges of every word's lattice.
A unigram model relaxes them from left to right for the best path. A merge (BPE) model has no
best path: there an edge says which two neighbours may join, and the edge of best score joins
first, the leftmost of equals, until none is left. Characters without a piece become bytes.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.llm import words as W
from varlake.session import ship_package

CACHE_WORDS = 1_000_000
BLANK = "▁"


@dataclass
class Vocabulary:
    """What encoding needs of a model file."""

    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray  # pieces that text may match
    byte_ids: dict[int, int]
    unknown: int
    merges: bool  # BPE, else unigram
    places: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.places = {p: i for i, p in enumerate(self.pieces) if self.normal[i]}
        self.longest = max(map(len, self.places))
        chars = sorted({c for p in self.places for c in p})
        if len(chars) > 65_000:
            raise ValueError("more than 65,000 different characters in the vocabulary")
        self.code = {c: i + 1 for i, c in enumerate(chars)}
        self.own = np.array([i for p, i in self.places.items()], np.int32)
        width = -(-self.longest // 4) * 4
        keys = np.zeros((len(self.own), width), ">u2")
        for row, i in enumerate(self.own):
            keys[row, : len(self.pieces[i])] = [self.code[c] for c in self.pieces[i]]
        self.lengths = np.array([len(self.pieces[i]) for i in self.own])
        tops = keys.copy()
        tops[np.arange(width)[None, :] >= self.lengths[:, None]] = 0xFFFF
        self.low, self.high = keys.view(f"S{2 * width}").ravel(), tops.view(f"S{2 * width}").ravel()
        self.width = width
        inner = any(BLANK in p.lstrip(BLANK) for p in self.places)
        if inner:
            raise ValueError("pieces that cross words are not supported")
        loose = "\n" not in self.code  # then a line break joins nothing and can stand alone
        self.split = re.compile(rf"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+" if loose else rf"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        raw = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            raw[i] = bytes([b])
        self.raw = raw


def load(path: str) -> Vocabulary:
    """A SentencePiece model file; its own normalisation must be the identity with a dummy blank."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
        raise ValueError("only models without normalisation rules are supported")
    kind = proto.ModelProto.SentencePiece
    bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
    return Vocabulary(
        [p.piece for p in model.pieces],
        np.array([p.score for p in model.pieces]),
        np.array([p.type == kind.NORMAL for p in model.pieces]),
        bytes_,
        next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN),
        model.trainer_spec.model_type == proto.TrainerSpec.BPE,
    )


def edges(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the words laid end to end, with a gap after each.

    Returns (first character of each word, characters of each word, table): ``table[i, n - 1]``
    is the piece of n characters that begins at i, or -1.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    text = "\0".join(words) + "\0"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    known, back = np.unique(points, return_inverse=True)
    other = len(v.code) + 1
    codes = np.array([0 if c == 0 else v.code.get(chr(c), other) for c in known.tolist()], np.uint64)[back]
    first = np.cumsum(lengths + 1) - lengths - 1
    padded = np.concatenate([codes, np.zeros(v.width, np.uint64)])
    n = len(codes)
    columns = []
    for at in range(0, v.width, 4):
        key = np.zeros(n, np.uint64)
        for i in range(4):
            key = (key << np.uint64(16)) | padded[at + i : at + i + n]
        columns.append(key)
    suffixes = np.lexsort(columns[::-1])
    keys = np.stack([c[suffixes] for c in columns], 1).astype(">u8").view(f"S{2 * v.width}").ravel()
    lo, hi = np.searchsorted(keys, v.low, "left"), np.searchsorted(keys, v.high, "right")
    count = np.maximum(hi - lo, 0)
    begin = suffixes[W.ragged(lo, count)]
    piece = np.repeat(np.arange(len(v.own)), count)
    order = np.argsort(begin, kind="stable")
    table = np.full((n, v.longest), -1, np.int32)
    table[begin[order], v.lengths[piece[order]] - 1] = v.own[piece[order]]
    return first, lengths, table


def _merge(v: Vocabulary, first, lengths, table) -> tuple[np.ndarray, np.ndarray]:
    """(begin, characters) of the symbols left when no neighbours can join."""
    begin = W.ragged(first, lengths)
    size = np.ones(len(begin), np.int64)
    word = np.repeat(np.arange(len(lengths)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(begin):
        both = size[:-1] + size[1:]
        ok = (word[:-1] == word[1:]) & (both <= v.longest)
        score = np.full(len(begin), -np.inf)
        at = np.flatnonzero(ok)
        piece = table[begin[at], both[at] - 1]
        hit = piece >= 0
        score[at[hit]] = v.scores[piece[hit]]
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.maximum.reduceat(score, heads)
        span = np.diff(np.concatenate([heads, [len(begin)]]))
        live = np.repeat(best > -np.inf, span)
        done.append((begin[~live], size[~live]))
        top = np.flatnonzero(live & (score == np.repeat(best, span)))
        _, once = np.unique(word[top], return_index=True)
        top = top[once]
        size[top] += size[top + 1]
        live[top + 1] = False
        begin, size, word = begin[live], size[live], word[live]
    begin, size = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(begin)
    return begin[order], size[order]


def _relax(v: Vocabulary, first, lengths, table) -> tuple[np.ndarray, np.ndarray]:
    """(begin, characters) along each word's path of best total score; the first found of equals."""
    n = len(table)
    best = np.full(n + 1, -np.inf, np.float32)  # the precision that model files are used with
    best[first] = 0.0
    step = np.zeros(n + 1, np.int64)
    scores = v.scores.astype(np.float32)
    lone = scores[v.normal].min() - np.float32(10)
    order = np.argsort(-lengths)
    most = int(lengths.max(initial=0))
    ends = first + lengths
    for i in range(most):
        rows = order[: np.searchsorted(-lengths[order], -i, "left")]
        at = first[rows] + i
        for m in range(1, v.longest + 1):
            inside = at + m <= ends[rows]
            here = at[inside]
            piece = table[here, m - 1]
            gain = np.where(piece >= 0, scores[piece], lone if m == 1 else np.float32(-np.inf))
            to, value = here + m, best[here] + gain
            better = value > best[to]
            best[to[better]] = value[better]
            step[to[better]] = m
    out = []
    at, rows = ends.copy(), np.flatnonzero(lengths > 0)
    while len(rows):
        size = step[at[rows]]
        at[rows] -= size
        out.append((at[rows].copy(), size))
        rows = rows[at[rows] > first[rows]]
    begin, size = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
    order = np.argsort(begin)
    return begin[order], size[order]


def encode_words(v: Vocabulary, words: list[str]) -> list[np.ndarray]:
    """Ids of each word."""
    first, lengths, table = edges(v, words)
    begin, size = (_merge if v.merges else _relax)(v, first, lengths, table)
    ids = np.where(size <= v.longest, table[begin, np.minimum(size, v.longest) - 1], -1)
    bounds = np.searchsorted(begin, first[1:])
    out = np.split(ids, bounds)
    for k in np.unique(np.searchsorted(first, begin[ids < 0], "right") - 1).tolist():
        mine: list[int] = []
        begins = begin[np.searchsorted(begin, first[k]) :][: len(out[k])]
        for i, b in zip(out[k].tolist(), (begins - first[k]).tolist(), strict=True):
            mine += [i] if i >= 0 else [v.byte_ids.get(x, v.unknown) for x in words[k][b].encode()] if v.byte_ids else [v.unknown]
        out[k] = np.array(mine, np.int32)
    return out


class Encoder:
    """Encodes each distinct word once per worker."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.v.split.findall((BLANK + t).replace(" ", BLANK)) if t else [] for t in texts]
        new = {w for s in split for w in s if w not in self.place}
        if new and len(new) + len(self.place) > CACHE_WORDS:
            self.clear()
            new = {w for s in split for w in s}
        for part in _parts(sorted(new)):
            coded = encode_words(self.v, part)
            count = np.array([len(c) for c in coded], np.int64)
            for w in part:
                self.place[w] = len(self.place)
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, *coded])
        out = []
        for s in split:
            at = np.fromiter(map(self.place.__getitem__, s), np.int64, len(s))
            out.append(self.ids[W.ragged(self.at[at], self.count[at])])
        return out


def _parts(words: list[str], most: int = 600_000):
    """Runs of words of at most ``most`` characters in all, or one longer word."""
    for a, b in W.groups([len(w) + 1 for w in words], most):
        yield words[a:b]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids as the model would give it: the dummy blank goes, broken bytes are replaced."""
    raw = v.raw
    text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_loaded: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(load(path))
    return _loaded[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of each text; a null text has null ids, an empty one none.

    ``model_path`` must be readable on every executor. Repeated rows are encoded each.
    """
    ship_package(docs.sparkSession)

    def rows(batches):
        coder = _encoder(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in W.groups([len(t or "") for t in texts]):
                coded = coder.encode(texts[a:b])
                ids = [None if t is None else c for t, c in zip(texts[a:b], coded, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(rows, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(coded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of token ids; null ids give a null text."""
    ship_package(coded.sparkSession)

    def rows(batches):
        v = _encoder(model_path).v
        for batch in batches:
            lists = batch.column(1)
            texts = [decode(v, np.asarray(x.values)) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    base = coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(rows, "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, decoded): each text's encoding in brief, and its decoding."""
    ship_package(docs.sparkSession)

    def rows(batches):
        coder = _encoder(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in W.groups([len(t or "") for t in texts]):
                coded = coder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(c) for c in coded], pa.int64()),
                        pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in coded], pa.int64()),
                        pa.array([decode(coder.v, c) for c in coded], pa.string()),
                    ],
                    ["id", "n_ids", "ids_crc32", "decoded"],
                )

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(rows, "id long, n_ids long, ids_crc32 long, decoded string").withColumnRenamed("id", id_col)
