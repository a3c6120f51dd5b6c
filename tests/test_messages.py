from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from varlake.functions import messages as C

SCHEMA = "prompts ARRAY<STRING>, images ARRAY<STRUCT<content: BINARY, suffix: STRING>>"


def build(spark, prompts, images, column):
    """A message as Python data, null fields dropped; None when it may not be built."""
    data = [(prompts, [(bytearray(b), s) for b, s in images])]
    m = spark.createDataFrame(data, SCHEMA).select(column.alias("m")).first()["m"]
    if m is None:
        return None
    m = m.asDict(recursive=True)
    parts = m["content"] and [{k: v for k, v in p.items() if v is not None} for p in m["content"]]
    return m["role"], m["text"] if m["text"] is not None else (parts or [])


A, B = (b"a", "png"), (b"b", "jpg")
MARK = {"type": "image", "text": "<image>"}


def text(x):
    return {"type": "text", "text": x}


def test_text_message_drops_empty_prompts(spark):
    assert build(spark, ["a", "", "b"], [], C.user_message("prompts")) == ("user", [text("a"), text("b")])
    assert build(spark, [""], [], C.user_message("prompts")) == ("user", [])


@pytest.mark.parametrize(
    "prompts, images, want",
    [
        (["x", "y"], [A], [text("x"), MARK, text("y")]),
        (["x"], [A, B], [text("x"), MARK, MARK]),
        (["", "y"], [A, B], [MARK, text("y"), MARK]),
        ([], [A], [MARK]),
        (["x"], [], [text("x")]),
    ],
)
def test_interleave(spark, prompts, images, want):
    assert build(spark, prompts, images, C.user_message("prompts", "images", "marker")) == ("user", want)


def test_payload_styles(spark):
    b64 = base64.b64encode(b"b").decode()
    url = f"data:image/jpg;base64,{b64}"
    assert build(spark, ["x"], [B], C.user_message("prompts", "images", "bare"))[1] == [text("x"), {"type": "image"}]
    assert build(spark, ["x"], [B], C.user_message("prompts", "images", "url"))[1] == [
        text("x"), {"type": "image_url", "image_url": url},
    ]
    assert build(spark, ["x"], [B], C.user_message("prompts", "images", "base64"))[1] == [
        text("x<image>"), {"type": "image", "media_type": "image/jpeg", "data": b64},
    ]


@pytest.mark.parametrize("prompts, images", [(["x"], [A, B]), ([""], [A]), ([], [A]), (["x", ""], [A, B])])
def test_marker_needs_a_text_before_every_image(spark, prompts, images):
    assert build(spark, prompts, images, C.user_message("prompts", "images", "base64")) is None


def test_long_payload_stays_on_one_line(spark):
    data = bytes(range(256)) * 20
    got = build(spark, ["x"], [(data, "png")], C.user_message("prompts", "images", "base64"))
    assert got[1][1]["data"] == base64.b64encode(data).decode()


def test_assistant_kinds(spark):
    box = F.array(
        F.struct(F.array(F.lit(1.0), F.lit(2.0)).alias("bbox"), F.lit("cup").alias("label")),
        F.struct(F.array(F.lit(3.0), F.lit(4.0)).alias("bbox"), F.lit("pot").alias("label")),
    )
    assert build(spark, ["", "b"], [], C.assistant_message("prompts"))[1] == [text(""), text("b")]
    assert build(spark, ["a"], [], C.assistant_message("prompts", style="plain")) == ("assistant", "a")
    assert build(spark, ["a"], [], C.assistant_message("prompts", box, "bbox"))[1] == [
        text("a"), {"type": "bbox", "bbox": [1.0, 2.0], "label": "cup"}, {"type": "bbox", "bbox": [3.0, 4.0], "label": "pot"},
    ]
    points = F.transform(box, lambda b: F.struct(b["bbox"].alias("point"), b["label"].alias("label")))
    assert build(spark, ["a", "b", "c"], [], C.assistant_message("prompts", points, "point"))[1][-1] == text("c")
    reason = F.array(F.lit("because"))
    assert build(spark, ["a"], [], C.assistant_message("prompts", reason, "reason"))[1] == [
        {"type": "think", "text": "because"}, text("a"),
    ]
    two = F.array(F.lit("because"), F.lit("also"))
    assert build(spark, ["a"], [], C.assistant_message("prompts", two, "reason")) is None
    assert build(spark, [], [], C.assistant_message("prompts", reason, "reason")) is None


def test_unknown_kinds_and_styles():
    for bad in (
        lambda: C.user_message("p", "i", "film"),
        lambda: C.assistant_message("p", "s", "song"),
        lambda: C.assistant_message("p", "s", "point", "plain"),
        lambda: C.system_message("p", "loud"),
        lambda: C.image_payload("c", "s", "marker"),
    ):
        with pytest.raises((ValueError, Exception)):
            bad()


def test_system_message_and_hoist(spark):
    df = spark.range(1)
    user, system = C.user_message(F.array(F.lit("hi"))), C.system_message(F.lit("be brief"))
    h = df.select(C.hoist_system(F.array(system, user)).alias("h")).first()["h"]
    assert h["system"]["text"] == "be brief\n" and [m["role"] for m in h["messages"]] == ["user"]
    h = df.select(C.hoist_system(F.array(user, system)).alias("h")).first()["h"]
    assert h["system"] is None and [m["role"] for m in h["messages"]] == ["user", "system"]
    empty = F.slice(F.array(user), 1, 0)
    assert df.select(C.hoist_system(empty).alias("h")).first()["h"]["messages"] == []


def test_wire_form(spark):
    df = spark.createDataFrame([(["x"], [(bytearray(b"b"), "jpg")])], SCHEMA)
    got = {
        s: json.loads(df.select(C.content_json(C.user_message("prompts", "images", s), s)).first()[0])
        for s in C.IMAGE_STYLES
    }
    url = "data:image/jpg;base64,Yg=="
    assert got["marker"] == [text("x"), MARK]
    assert got["bare"] == [text("x"), {"type": "image"}]
    assert got["url"][1] == {"type": "image_url", "image_url": url}
    assert got["url_object"][1] == {"type": "image_url", "image_url": {"url": url}}
    assert got["base64"] == [
        text("x<image>"),
        {"type": "image", "source": {"type": "base64", "media_type": "image/jpeg", "data": "Yg=="}},
    ]


def test_suffix(spark):
    names = ["a.png", "/x.y/b.tar.gz", "noext", ".hidden", None]
    df = spark.createDataFrame([(n,) for n in names], "p STRING")
    assert [r[0] for r in df.select(C.image_suffix("p")).collect()] == ["png", "gz", "", "", "jpeg"]
