from __future__ import annotations

import json
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varlake.schemas import EPISODE
from varlake.sources import episode_shards as E
from varlake.sources import files as S
from varlake.sources.episodes import explode_steps, read_episode_shards, write_episode_shards

EVENT = "a INT, b STRING"


def test_json_map_keeps_document_order(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"9": "x", "10": "é", "1": "z"}, indent=2, ensure_ascii=False))
    got = S.read_json_map(spark, str(tmp_path / "m.json")).orderBy("pos").collect()
    assert [(r["pos"], r["key"], r["value"]) for r in got] == [(0, "9", "x"), (1, "10", "é"), (2, "1", "z")]


@pytest.mark.parametrize("text", ["", "{", '{"a": "b"} tail', "{'a': 'b'}", '{"a": "b"}}'])
def test_bad_json_map_is_empty_or_an_error(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    path = str(tmp_path / "m.json")
    assert S.read_json_map(spark, path).count() == 0
    if text:
        with pytest.raises(Exception, match="not a JSON object"):
            S.read_json_map(spark, path, strict=True).collect()


def test_missing_map(spark, tmp_path):
    with pytest.warns(UserWarning, match="does not exist"):
        assert S.read_json_map(spark, str(tmp_path / "no.json")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_json_map(spark, str(tmp_path / "no.json"), strict=True)


def test_map_round_trip_in_chunks(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("o"), F.concat(F.lit("k"), "id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    S.write_json_map(df, str(tmp_path / "m"), "k", "v", "o", chunk=10)
    got = S.read_json_map(spark, str(tmp_path / "m"))
    assert got.select("path").distinct().count() == 3
    assert rows(got.select("key", "value")) == rows(df.select("k", "v"))
    assert [r["key"] for r in got.orderBy("pos").collect()] == [f"k{i}" for i in range(25)]
    assert [r["pos"] for r in got.orderBy("pos").collect()] == list(range(25))


def test_a_map_is_one_document(spark, tmp_path):
    """Any value, any key, in order; Python reads the same object."""
    data = [(2, 'q"\\', None, ["x"]), (0, "é\n", "1", None), (1, "", "ü", [None, "y"]), (3, None, "n", [])]
    df = spark.createDataFrame(data, "o INT, k STRING, v STRING, w ARRAY<STRING>").repartition(3)
    for value, kind in (("v", "STRING"), ("w", "ARRAY<STRING>")):
        S.write_json_map(df, str(tmp_path / value), "k", value, "o")
        (file,) = (tmp_path / value).glob("first=0/part*")
        want = {("null" if r[1] is None else r[1]): r[2 if value == "v" else 3] for r in sorted(data)}
        got = json.loads(file.read_text())
        assert {("null" if k is None else k): x for k, x in got.items()} == want and list(got) == list(want)
        back = S.read_json_map(spark, str(tmp_path / value), kind).orderBy("pos").collect()
        assert [(r["key"], r["value"]) for r in back] == list(want.items())


def test_repeated_keys_and_broken_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": "1", "y": "2", "x": "3", "z": "4", "y": "5", "x": "6"}')
    (tmp_path / "b.json").write_text('{"x": "1", ')
    (tmp_path / "c.json").write_text("{}")
    got = S.read_json_map(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["key"], r["value"]) for r in got] == [(0, "x", "6"), (1, "y", "5"), (2, "z", "4")]
    assert [(r["path"][-6:], r["text"]) for r in S.bad_documents(spark, str(tmp_path)).collect()] == [("b.json", '{"x": "1", ')]


def test_variant_documents(spark, tmp_path):
    data = [("kitchen", s, o, f'do "{o}"', p, f"{s} é {o} {p}") for s in ("one", "all") for o in range(3) for p in range(2 + o)]
    df = spark.createDataFrame(data, "suite STRING, scope STRING, ord INT, instruction STRING, pos INT, variant STRING")
    S.write_variants(df.repartition(4), str(tmp_path / "v"))
    for s in ("one", "all"):
        (file,) = (tmp_path / "v").glob(f"file={s}_kitchen.json/part*")
        assert json.loads(file.read_text()) == {f'do "{o}"': [f"{s} é {o} {p}" for p in range(2 + o)] for o in range(3)}
    got = S.read_variants(spark, str(tmp_path / "v"), scopes=None)
    assert rows(got.select(df.columns)) == rows(df)


def test_prefix_reads_store_no_lines(spark, tmp_path, monkeypatch):
    """What is stored between the two passes has one row per split, and no text."""
    (tmp_path / "1.jsonl").write_text('{"a": 1}\noops\n{"a": 2}\n')
    seen = []
    keep = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: seen.append(df.columns) or keep(df))
    got, _ = S.read_jsonl(spark, str(tmp_path / "1.jsonl"), EVENT, on_error="prefix")
    assert [r["a"] for r in got.collect()] == [1]
    assert seen == [["path", "block_start", "from", "lines", "bad"]]


def test_records_tolerate_missing_fields(spark, tmp_path):
    for scope, field in (("zero", {}), ("one", {"instruction": "Open it"})):
        d = tmp_path / "kitchen" / scope
        d.mkdir(parents=True)
        (d / "instruction.json").write_text(json.dumps([{"task": "open_it", **field, "new_instroduction": scope}], indent=4))
    got = S.read_eval_texts(spark, f"{tmp_path}/*/*/instruction.json")
    assert rows(got) == [("kitchen", "one", "open_it", "Open it", "one"), ("kitchen", "zero", "open_it", "open it", "zero")]


def test_eval_texts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "open_it", "open it", "öffne"), (0, "shut_it", "shut it", "zu")], "o INT, task STRING, instruction STRING, new_instruction STRING")
    path = tmp_path / "kitchen" / "all" / "instruction.json"
    S.write_eval_texts(df, str(path), "o")
    (file,) = path.glob("chunk=0/part*")
    assert json.loads(file.read_text()) == [
        {"task": "shut_it", "instruction": "shut it", "new_instroduction": "zu"},
        {"task": "open_it", "instruction": "open it", "new_instroduction": "öffne"},
    ]
    got = S.read_eval_texts(spark, str(path))
    assert rows(got) == [("kitchen", "all", "open_it", "open it", "öffne"), ("kitchen", "all", "shut_it", "shut it", "zu")]


def test_record_lists(spark, tmp_path):
    df = spark.range(7).select("id", F.when(F.col("id") > 2, F.lit("ü")).alias("t"))
    S.write_record_lists(df, str(tmp_path / "l"), "id", chunk=3)
    files = sorted((tmp_path / "l").glob("chunk=*/part*"))
    assert [len(json.loads(f.read_text())) for f in files] == [3, 3, 1]
    assert rows(S.read_records(spark, str(tmp_path / "l"), "id LONG, t STRING")) == rows(df)


def test_ordered_records(spark, tmp_path):
    S.write_records(spark.range(50).repartition(4), str(tmp_path / "r"), order_by=["id"])
    text = "".join(f.read_text() for f in sorted((tmp_path / "r").glob("part*")))
    assert [json.loads(x)["id"] for x in text.splitlines()] == list(range(50))


def test_jsonl_modes(spark, tmp_path):
    good = ['{"a": 1, "b": "x"}', '{"a": 2, "b": "é"}']
    (tmp_path / "1.jsonl").write_text("\n".join([good[0], "{broken", good[1]]) + "\n")
    (tmp_path / "2.jsonl").write_text("\n".join([good[1], "null", good[0]]) + "\n")
    (tmp_path / "3.jsonl").write_text("\n".join([*good, '{"a": 3}']) + "\n")
    (tmp_path / "4.jsonl").write_text("\n".join([good[0], "", good[1], "{'a': 4}", '{"a": "word"}']) + "\n")
    path = f"{tmp_path}/*.jsonl"

    def per_file(df, *cols):
        name = F.regexp_extract("path", r"(\d)\.jsonl", 1)
        return rows(df.select(name.alias("f"), *cols))

    kept, bad = S.read_jsonl(spark, path, EVENT)
    assert per_file(kept, "a", "b") == [
        ("1", 1, "x"), ("1", 2, "é"), ("2", 1, "x"), ("2", 2, "é"), ("3", 1, "x"), ("3", 2, "é"), ("3", 3, None), ("4", 1, "x"), ("4", 2, "é"),
    ]
    assert set(per_file(bad, "line")) == {("1", "{broken"), ("2", "null"), ("4", ""), ("4", '{"a": "word"}'), ("4", "{'a': 4}")}
    prefix, _ = S.read_jsonl(spark, path, EVENT, on_error="prefix")
    assert per_file(prefix, "a", "b") == [("1", 1, "x"), ("2", 2, "é"), ("3", 1, "x"), ("3", 2, "é"), ("3", 3, None), ("4", 1, "x")]
    with pytest.raises(Exception, match="bad line"):
        S.read_jsonl(spark, path, EVENT, on_error="fail")[0].collect()
    assert S.read_jsonl(spark, f"{tmp_path}/3.jsonl", EVENT, on_error="fail")[0].count() == 3
    with pytest.raises(ValueError):
        S.read_jsonl(spark, path, EVENT, on_error="shrug")


def test_jsonl_prefix_across_splits(spark, tmp_path):
    lines = [json.dumps({"a": i, "b": "x" * 30}) for i in range(200)]
    lines[120] = "oops"
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got, bad = S.read_jsonl(spark, str(tmp_path / "big.jsonl"), EVENT, on_error="prefix")
        assert got.rdd.getNumPartitions() > 5
        assert sorted(r["a"] for r in got.collect()) == list(range(120))
        assert bad.count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_append_and_overwrite(spark, tmp_path):
    p = str(tmp_path / "j")
    S.append_jsonl(spark.range(2), p)
    S.append_jsonl(spark.range(3), p)
    assert S.record_count(spark.read.json(p)) == 5
    S.overwrite_jsonl(spark.range(1), p)
    assert S.record_count(spark.read.json(p)) == 1


def test_split_write(spark, tmp_path):
    S.split_write(spark.range(10), 4, "id", str(tmp_path / "s"))
    got = spark.read.schema("id LONG, part INT").json(str(tmp_path / "s"))
    assert rows(got.select("part", "id")) == [(p, i) for i, p in enumerate([0, 0, 0, 1, 1, 1, 2, 2, 3, 3])]
    S.split_write(spark.range(2), 4, "id", str(tmp_path / "few"))
    assert rows(spark.read.schema("id LONG, part INT").json(str(tmp_path / "few"))) == [(0, 0), (1, 1)]


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = S.read_images(spark, str(tmp_path), "*.{png,jpg}").select("suffix", F.base64("content"))
    assert rows(got) == [("jpg", "/9g="), ("png", "iVBORw==")]


# --- shards ------------------------------------------------------------------------------


def _slow_crc(data):
    table, reg = E._byte_list(), 0xFFFFFFFF
    for b in data:
        reg = table[(reg ^ b) & 0xFF] ^ (reg >> 8)
    return reg ^ 0xFFFFFFFF


def test_crc():
    assert E.crc32c(b"123456789") == 0xE3069283
    data = bytes((i * 131 + i // 7) % 256 for i in range(70_000))
    for n in (0, 1, 3, 63, 64, 65, 127, 128, 1000, 4097, 70_000):
        assert E.crc32c(data[:n]) == _slow_crc(data[:n])


def _steps(n, text="tâche", dim=2, image=b"\x00\xff"):
    return [
        ([float(i)] * dim, 1.0, i == 0, i == n - 1, False, text, 0.5, (bytearray(image), bytearray(image), [1.0, 2.0, 3.0], [float(i)]))
        for i in range(n)
    ]


def test_shard_round_trip(spark, tmp_path):
    data = [(i, f"f{i}", _steps(i % 4, dim=1 + i % 3, image=bytes([i]) * (i * 100))) for i in range(12)]
    df = spark.createDataFrame(data, EPISODE)
    write_episode_shards(df, str(tmp_path / "s"), shards=3)
    names = sorted(p.name for p in (tmp_path / "s").iterdir())
    assert all(n.startswith("episodes-train.tfrecord-") for n in names) and 1 <= len(names) <= 3
    good, bad = read_episode_shards(spark, str(tmp_path / "s"))
    assert bad.count() == 0
    got = good.select("file_path", "steps")
    assert rows(got) == rows(df.select("file_path", "steps"))
    assert sorted(r["episode_id"] for r in good.collect()) == list(range(12))
    assert explode_steps(good).count() == sum(i % 4 for i in range(12))


@pytest.mark.parametrize("split_bytes", [64, 900, 10_000])
def test_one_large_shard_is_read_in_blocks(spark, tmp_path, split_bytes):
    data = [(i, f"f{i}", _steps(1 + i % 3, image=bytes(range(256)) * (i % 5))) for i in range(20)]
    df = spark.createDataFrame(data, EPISODE)
    write_episode_shards(df.coalesce(1), str(tmp_path / "s"))
    assert len(list((tmp_path / "s").iterdir())) == 1
    raw = spark.read.format("episode_shards").option("split_bytes", split_bytes).load(str(tmp_path / "s"))
    assert raw.rdd.getNumPartitions() > 1
    good, bad = read_episode_shards(spark, str(tmp_path / "s"), split_bytes=split_bytes)
    assert bad.count() == 0
    assert rows(good.select("file_path", "steps")) == rows(df.select("file_path", "steps"))
    assert [r["file_path"] for r in good.orderBy("episode_id").collect()] == [f"f{i}" for i in range(20)]


def test_header_search_is_not_fooled():
    records = [bytes([i]) * (50 + i) for i in range(30)]
    blob = b"".join(E.frame(r) for r in records)
    starts, at = [], 0
    for r in records:
        starts.append(at)
        at += len(r) + 16
    import io

    for probe in (1, 17, 40, 66, 67, 500, len(blob) - 70):
        want = next((s for s in starts if s >= probe), None)
        assert E.find_header(io.BytesIO(blob), probe, len(blob), len(blob)) == want
    assert E.find_header(io.BytesIO(blob), 1, 5, len(blob)) is None


def _record(**features):
    example = E._example_class()()
    for name, (kind, values) in features.items():
        getattr(example.features.feature[name], kind).value.extend(values)
    return example.SerializeToString()


def test_bad_records_are_set_aside(spark, tmp_path):
    base = {"episode_metadata/file_path": ("bytes_list", [b"f"]), "steps/is_first": ("int64_list", [1, 0])}
    shard = [
        _record(**base, **{"steps/action": ("float_list", [1, 2, 3, 4]), "steps/language_instruction": ("bytes_list", [b"go", b"go"])}),
        _record(**base, **{"steps/action": ("float_list", [1, 2, 3])}),
        _record(**base, **{"steps/reward": ("float_list", [1])}),
        _record(**base, **{"steps/language_instruction": ("bytes_list", [b"\xff", b"go"])}),
        b"\xff\xff not a message",
    ]
    (tmp_path / "x-train.tfrecord-00000").write_bytes(b"".join(E.frame(r) for r in shard))
    (tmp_path / "x-test.tfrecord-00000").write_bytes(E.frame(shard[0]))
    good, bad = read_episode_shards(spark, str(tmp_path))
    got = {r["episode_id"]: [(s["action"], s["language_instruction"], s["reward"]) for s in r["steps"]] for r in good.collect()}
    assert got == {0: [([1.0, 2.0], "go", None), ([3.0, 4.0], "go", None)], 3: [(None, None, None), (None, "go", None)]}
    assert [(r["record_no"], r["error"].split(":")[0]) for r in bad.orderBy("record_no").collect()][:2] == [(1, "ValueError"), (2, "ValueError")]
    assert bad.count() == 3


def test_corrupt_frames_fail(spark, tmp_path):
    data = bytearray(E.frame(_record(**{"steps/is_first": ("int64_list", [1])})))
    data[14] ^= 1
    (tmp_path / "x-train.tfrecord").write_bytes(bytes(data))
    with pytest.raises(Exception, match="corrupt record"):
        read_episode_shards(spark, str(tmp_path))[0].collect()


def test_no_shards(spark, tmp_path):
    with pytest.raises(Exception, match="no episode shards"):
        read_episode_shards(spark, str(tmp_path))[0].collect()


def test_frame_layout():
    f = E.frame(b"abc")
    assert struct.unpack("<Q", f[:8]) == (3,) and f[12:15] == b"abc" and len(f) == 19
