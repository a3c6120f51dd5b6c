"""Python data source for episode shards: TFRecord files of ``tf.train.Example``.

Spark plans one task per ``split_bytes`` of a shard, so no single file is one task: a
task that starts inside a file looks for the next record header, which carries a
checksum of its own. A task streams its records and hands Arrow batches of a bounded
size to the JVM; the frame and message layouts are the public TFRecord and Example
formats.
"""

from __future__ import annotations

import fnmatch
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from varlake.schemas import STEP

SCHEMA = f"shard STRING, block_start LONG, record_no LONG, file_path STRING, steps ARRAY<{STEP}>, error STRING"

# Feature names of the shard format, with the D1 field each one fills.
FILE_PATH = "episode_metadata/file_path"
FEATURES = {
    "action": "steps/action",
    "discount": "steps/discount",
    "is_first": "steps/is_first",
    "is_last": "steps/is_last",
    "is_terminal": "steps/is_terminal",
    "language_instruction": "steps/language_instruction",
    "reward": "steps/reward",
    "image": "steps/observation/image",
    "wrist_image": "steps/observation/wrist_image",
    "joint_state": "steps/observation/joint_state",
    "state": "steps/observation/state",
}
VECTORS = ("action", "joint_state", "state")
FLOATS = ("discount", "reward")
FLAGS = ("is_first", "is_last", "is_terminal")
IMAGES = ("image", "wrist_image")
OBSERVATION = ("image", "wrist_image", "joint_state", "state")

SPLIT_BYTES = 256 * 1024 * 1024
SEARCH_BYTES = 4 * 1024 * 1024
BATCH_BYTES = 16 * 1024 * 1024
BATCH_RECORDS = 64

# --- frame checksums ------------------------------------------------------------------

# Reflected Castagnoli polynomial and the TFRecord mask.
_POLYNOMIAL = 0x82F63B78
_MASK_DELTA = 0xA282EAD8


_LANE = 16  # bytes that one lane reads


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t.astype(np.uint32)


@lru_cache(maxsize=1)
def _byte_list() -> list[int]:
    return _byte_table().tolist()


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    """What a register becomes after two bytes, by their value."""
    t, words = _byte_table(), np.arange(1 << 16, dtype=np.uint32)
    once = t[words & 0xFF] ^ (words >> 8)
    return t[once & 0xFF] ^ (once >> 8)


@lru_cache(maxsize=64)
def _past(doublings: int) -> np.ndarray:
    """Registers after ``_LANE << doublings`` zero bytes, by byte position and value."""
    if doublings:
        before = _past(doublings - 1)
        return _move(before, before)
    t = _byte_table()
    state = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(_LANE):
        state = t[state & 0xFF] ^ (state >> 8)
    return state


def _move(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return (
        tables[0][state & 0xFF]
        ^ tables[1][(state >> 8) & 0xFF]
        ^ tables[2][(state >> 16) & 0xFF]
        ^ tables[3][state >> 24]
    )


def crc32c(data: bytes) -> int:
    """CRC-32C with all lanes of a message read at once and then joined pairwise.

    Zeros in front do not change a register that starts at zero, so the message is
    padded there to a power of two of lanes, and its first four bytes take in the
    usual all-ones start.
    """
    n = len(data)
    if n < 64:
        reg, bytewise = 0xFFFFFFFF, _byte_list()
        for byte in data:
            reg = bytewise[(reg ^ byte) & 0xFF] ^ (reg >> 8)
        return reg ^ 0xFFFFFFFF
    lanes = 1 << max(0, -(-n // _LANE) - 1).bit_length()
    padded = np.zeros(lanes * _LANE, dtype=np.uint8)
    padded[-n:] = np.frombuffer(data, dtype=np.uint8)
    padded[-n : len(padded) - n + 4] ^= 0xFF
    words = padded.view("<u2").reshape(lanes, _LANE // 2).T.astype(np.uint32)
    table = _word_table()
    state = np.zeros(lanes, dtype=np.uint32)
    for column in words:
        state = table[(state ^ column) & 0xFFFF] ^ (state >> 16)
    doublings = 0
    while len(state) > 1:
        state = _move(_past(doublings), state[0::2]) ^ state[1::2]
        doublings += 1
    return int(state[0]) ^ 0xFFFFFFFF


def _masked(data: bytes) -> int:
    crc = crc32c(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def _unmask(stored: np.ndarray) -> np.ndarray:
    rotated = stored - np.uint32(_MASK_DELTA)
    return (rotated >> np.uint32(17)) | (rotated << np.uint32(15))


def find_header(stream, start: int, end: int, size: int) -> int | None:
    """Offset in [start, end) of the first record that begins there.

    A header is eight bytes of length and their checksum; where the checksum fits, the
    record's own checksum must fit as well.
    """
    table = _byte_table()
    while start < end:
        stream.seek(start)
        raw = np.frombuffer(stream.read(min(SEARCH_BYTES, end - start) + 11), dtype=np.uint8)
        count = len(raw) - 11
        if count <= 0:
            return None
        state = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
        for j in range(8):
            state = table[(state ^ raw[j : j + count]) & 0xFF] ^ (state >> 8)
        stored = sum(raw[8 + j : 8 + j + count].astype(np.uint32) << np.uint32(8 * j) for j in range(4))
        for i in np.flatnonzero((state ^ np.uint32(0xFFFFFFFF)) == _unmask(stored)).tolist():
            length = int.from_bytes(raw[i : i + 8].tobytes(), "little")
            if start + i + 16 + length > size:
                continue
            stream.seek(start + i + 12)
            payload = stream.read(length)
            if struct.unpack("<I", stream.read(4))[0] == _masked(payload):
                return start + i
        start += count
    return None


def read_frames(stream, headers_only: bool, verify: bool, end: int | None = None) -> Iterator[bytes | None]:
    """Payloads of the records that begin before ``end``; None for each with ``headers_only``."""
    while end is None or stream.tell() < end:
        head = stream.read(12)
        if not head:
            return
        if len(head) < 12:
            raise ValueError("truncated record header")
        (size,) = struct.unpack("<Q", head[:8])
        if verify and struct.unpack("<I", head[8:])[0] != _masked(head[:8]):
            raise ValueError("corrupt record header")
        if headers_only:
            stream.seek(size + 4, 1)
            yield None
            continue
        payload = stream.read(size)
        tail = stream.read(4)
        if len(payload) < size or len(tail) < 4:
            raise ValueError("truncated record")
        if verify and struct.unpack("<I", tail)[0] != _masked(payload):
            raise ValueError("corrupt record")
        yield payload


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join(
        (size, struct.pack("<I", _masked(size)), payload, struct.pack("<I", _masked(payload)))
    )


# --- messages ----------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _example_class():
    """``Example`` built from its public field numbers; needs the protobuf runtime."""
    try:
        from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
    except ImportError as e:
        raise ImportError("episode shards need the protobuf package on every executor") from e

    field = descriptor_pb2.FieldDescriptorProto
    proto = descriptor_pb2.FileDescriptorProto(name="varlake_example.proto", package="varlake", syntax="proto3")

    def add(parent, name, number, kind, label=field.LABEL_OPTIONAL, ref=None, oneof=None):
        f = parent.field.add(name=name, number=number, type=kind, label=label)
        if ref:
            f.type_name = f".varlake.{ref}"
        if oneof is not None:
            f.oneof_index = oneof

    for name, kind in (("BytesList", field.TYPE_BYTES), ("FloatList", field.TYPE_FLOAT), ("Int64List", field.TYPE_INT64)):
        add(proto.message_type.add(name=name), "value", 1, kind, field.LABEL_REPEATED)
    feature = proto.message_type.add(name="Feature")
    feature.oneof_decl.add(name="kind")
    for i, (name, ref) in enumerate((("bytes_list", "BytesList"), ("float_list", "FloatList"), ("int64_list", "Int64List"))):
        add(feature, name, i + 1, field.TYPE_MESSAGE, ref=ref, oneof=0)
    features = proto.message_type.add(name="Features")
    entry = features.nested_type.add(name="FeatureEntry")
    entry.options.map_entry = True
    add(entry, "key", 1, field.TYPE_STRING)
    add(entry, "value", 2, field.TYPE_MESSAGE, ref="Feature")
    add(features, "feature", 1, field.TYPE_MESSAGE, field.LABEL_REPEATED, "Features.FeatureEntry")
    add(proto.message_type.add(name="Example"), "features", 1, field.TYPE_MESSAGE, ref="Features")

    pool = descriptor_pool.DescriptorPool()
    pool.Add(proto)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("varlake.Example"))


def _values(features, name: str, kind: str):
    return getattr(features[name], kind).value if name in features else ()


def _decode(payload: bytes) -> dict:
    """Columns of one record, cut to steps; raises when the lengths do not fit."""
    features = _example_class().FromString(payload).features.feature
    path = _values(features, FILE_PATH, "bytes_list")
    flags = {f: np.asarray(_values(features, FEATURES[f], "int64_list"), dtype=np.int64) for f in FLAGS}
    n = len(flags["is_first"])
    out = {"n": n, "file_path": path[0].decode("utf-8", "replace") if len(path) else None}

    def fits(name, values):
        if len(values) not in (0, n):
            raise ValueError(f"{name}: {len(values)} values for {n} steps")
        return values

    for f in FLAGS:
        out[f] = fits(f, flags[f]).astype(bool)
    for f in FLOATS:
        out[f] = fits(f, np.asarray(_values(features, FEATURES[f], "float_list"), dtype=np.float32))
    for f in IMAGES:
        out[f] = fits(f, list(_values(features, FEATURES[f], "bytes_list")))
    for f in VECTORS:
        values = np.asarray(_values(features, FEATURES[f], "float_list"), dtype=np.float32)
        if len(values) and (not n or len(values) % n):
            raise ValueError(f"{f}: {len(values)} values for {n} steps")
        out[f] = values
    text: dict[bytes, str | None] = {}
    raw = fits("language_instruction", list(_values(features, FEATURES["language_instruction"], "bytes_list")))
    for b in set(raw):
        try:
            text[b] = b.decode("utf-8")
        except UnicodeDecodeError:
            text[b] = None
    out["language_instruction"] = [text[b] for b in raw]
    return out


def _column(rows: list[dict], name: str, kind: pa.DataType) -> pa.Array:
    """One step field of many records end to end; a feature a record lacks is null there."""
    if name in VECTORS:
        parts, starts, missing, at = [], [], [], 0
        for r in rows:
            n, values = r["n"], r[name]
            dim = len(values) // n if n else 0
            starts.append(at + dim * np.arange(n, dtype=np.int64))
            missing.append(np.full(n, not len(values)))
            parts.append(values)
            at += len(values)
        offsets = np.concatenate([*starts, [at]]).astype(np.int32)
        flat = pa.array(np.concatenate(parts), pa.float32())
        mask = pa.array(np.concatenate(missing), pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=mask if mask.true_count else None)
    values: list = []
    for r in rows:
        column = r[name]
        values.extend(column.tolist() if isinstance(column, np.ndarray) else column)
        if not len(column):
            values.extend([None] * r["n"])
    return pa.array(values, kind)


def _batch(shard: str, block_start: int, group: list[tuple[int, dict | None, str | None]]) -> pa.RecordBatch:
    rows = [r for _, r, _ in group if r is not None]
    rows = rows or [{"n": 0, **{f: np.zeros(0, np.float32) for f in FEATURES}}]
    kinds = {**dict.fromkeys(FLAGS, pa.bool_()), **dict.fromkeys(FLOATS, pa.float32()), **dict.fromkeys(IMAGES, pa.binary())}
    kinds["language_instruction"] = pa.string()
    column = {f: _column(rows, f, kinds.get(f)) for f in FEATURES}
    observation = pa.StructArray.from_arrays([column[f] for f in OBSERVATION], list(OBSERVATION))
    top = ("action", "discount", "is_first", "is_last", "is_terminal", "language_instruction", "reward")
    step = pa.StructArray.from_arrays([*[column[f] for f in top], observation], [*top, "observation"])
    sizes = [0 if r is None else r["n"] for _, r, _ in group]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    steps = pa.ListArray.from_arrays(pa.array(offsets), step)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * len(group), pa.string()),
            pa.array([block_start] * len(group), pa.int64()),
            pa.array([no for no, _, _ in group], pa.int64()),
            pa.array([None if r is None else r["file_path"] for _, r, _ in group], pa.string()),
            steps,
            pa.array([e for _, _, e in group], pa.string()),
        ],
        names=["shard", "block_start", "record_no", "file_path", "steps", "error"],
    )


def _step_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Offsets of the records, and every step field of the batch end to end."""
    steps = batch.column(batch.schema.get_field_index("steps"))
    sizes = np.asarray(steps.value_lengths().fill_null(0))
    flat = steps.flatten()
    observation = flat.field(flat.type.get_field_index("observation"))
    fields = {}
    for f in FEATURES:
        parent = observation if f in OBSERVATION else flat
        fields[f] = parent.field(parent.type.get_field_index(f))
    return np.concatenate([[0], np.cumsum(sizes)]), fields


def _encode(batch: pa.RecordBatch) -> Iterator[bytes]:
    """One serialized record per row."""
    offsets, fields = _step_arrays(batch)
    paths = batch.column(batch.schema.get_field_index("file_path")).to_pylist()
    for i, path in enumerate(paths):
        start, n = int(offsets[i]), int(offsets[i + 1] - offsets[i])
        example = _example_class()()
        features = example.features.feature
        features[FILE_PATH].bytes_list.value.append((path or "").encode("utf-8"))
        for f, name in FEATURES.items():
            values = fields[f].slice(start, n)
            if values.null_count == n:
                continue
            if values.null_count:
                raise ValueError(f"{f} is missing in some steps of {path}")
            if f in VECTORS:
                features[name].float_list.value.extend(np.asarray(values.flatten()).tolist())
            elif f in FLOATS:
                features[name].float_list.value.extend(values.to_pylist())
            elif f in FLAGS:
                features[name].int64_list.value.extend(np.asarray(values.cast(pa.int64())).tolist())
            else:
                features[name].bytes_list.value.extend(values.cast(pa.binary()).to_pylist())
        yield example.SerializeToString(deterministic=True)


# --- data source ---------------------------------------------------------------------------


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class EpisodeShards(DataSource):
    """``spark.read.format("episode_shards").option("split", ..).load(dir)``, and its writer.

    Options: ``split`` (train), ``split_bytes``, ``verify`` (true), ``headers_only`` (false), ``name``.
    """

    @classmethod
    def name(cls) -> str:
        return "episode_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EpisodeShardReader:
        return EpisodeShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> EpisodeShardWriter:
        return EpisodeShardWriter(self.options, overwrite)


class ShardBlock(InputPartition):
    """The records that begin in [start, end) of a file."""

    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class EpisodeShardReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = options.get("split", "train")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.verify = options.get("verify", "true").lower() == "true"
        self.headers_only = options.get("headers_only", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.path)
        pattern = f"*-{self.split}.tfrecord*"
        found = sorted(
            (f.path, f.size)
            for f in files.get_file_info(pafs.FileSelector(root))
            if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith("_")
        )
        if not found:
            raise FileNotFoundError(f"no episode shards {pattern} in {self.path}")
        return [
            ShardBlock(path, start, min(start + self.split_bytes, size), size)
            for path, size in found
            for start in range(0, max(size, 1), self.split_bytes)
        ]

    def read(self, block: ShardBlock) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        shard = block.path.rsplit("/", 1)[-1]
        group, held = [], 0
        with files.open_input_file(block.path) as stream:
            if block.start:
                first = find_header(stream, block.start, block.end, block.size)
                if first is None:
                    return
                stream.seek(first)
            for no, payload in enumerate(read_frames(stream, self.headers_only, self.verify, block.end)):
                record, error = None, None
                if payload is None:
                    record = {"n": 0, "file_path": None, **{f: np.zeros(0, np.float32) for f in FEATURES}}
                else:
                    held += len(payload)
                    try:
                        record = _decode(payload)
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                group.append((no, record, error))
                if held >= BATCH_BYTES or len(group) >= (8192 if self.headers_only else BATCH_RECORDS):
                    yield _batch(shard, block.start, group)
                    group, held = [], 0
        if group:
            yield _batch(shard, block.start, group)


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str | None, final: str | None):
        self.temporary, self.final = temporary, final


class EpisodeShardWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        if overwrite:
            raise ValueError("episode shards are appended; write to a new folder instead")
        self.path = options["path"]
        self.split = options.get("split", "train")
        self.prefix = options.get("name", "episodes")
        self.job = uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        final = f"{root}/{self.prefix}-{self.split}.tfrecord-{part:05d}-{self.job}"
        temporary = f"{root}/_{self.job}-{part:05d}-{uuid.uuid4().hex}"
        count = 0
        with files.open_output_stream(temporary) as out:
            for batch in iterator:
                for payload in _encode(batch):
                    out.write(frame(payload))
                    count += 1
        return _Written(temporary, final if count else None)

    def commit(self, messages) -> None:
        files, _ = _open(self.path)
        for m in messages:
            if m is None:
                continue
            if m.final:
                files.move(m.temporary, m.final)
            else:
                files.delete_file(m.temporary)

    def abort(self, messages) -> None:
        files, _ = _open(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(m.temporary)
