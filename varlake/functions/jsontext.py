"""Strict JSON checks and response fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlake.schemas import RESPONSE, REVISION

STRICT = {"allowSingleQuotes": "false"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_json(text) -> Column:
    """True when the whole text is one JSON value.

    Spark's JSON functions stop after the first value and ignore what follows. No
    tail can close both an array and an object, so wrapping the text in each and
    asking both to parse leaves no room for one.
    """
    t = _col(text)
    in_array = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit("}")))
    return F.coalesce(in_array.isNotNull() & in_object.isNotNull(), F.lit(False))


def _frame(kind: T.DataType, text: Column) -> tuple[T.DataType, Column, Callable[[Column], Column]]:
    """A type that holds ``kind`` and a marker, the marker as JSON, and a test for it.

    The marker holds the text's own digest, which no text can hold.
    """
    mark = F.md5(text.cast("binary"))
    if isinstance(kind, T.StructType):
        framed = T.StructType([*kind.fields, T.StructField("__mark", T.StringType())])
        return framed, F.concat(F.lit('{"__mark":"'), mark, F.lit('"}')), lambda x: x["__mark"] == mark
    if isinstance(kind, T.MapType):
        return kind, F.concat(F.lit('{"'), mark, F.lit('":null}')), lambda x: F.coalesce(F.map_contains_key(x, mark), F.lit(False))
    raise TypeError("a JSON object is read as a struct or as a map")


def parse_whole(text, kind: str) -> Column:
    """The one JSON object of type ``kind`` (a struct or a map) that makes up the whole text, or null.

    Null when the text is malformed, is followed by more, is a literal null, or does not fit
    ``kind``. Spark's JSON functions stop after the first value and ignore what follows, so the
    text is parsed, once, as the middle one of three elements between two markers: a text that
    closes the list early, or opens another, leaves other than three.
    """
    t = _col(text)
    middle = T.DataType.fromDDL(kind)
    framed, marker, is_marker = _frame(middle, t)
    whole = T.StructType([T.StructField("x", T.ArrayType(framed)), T.StructField("_corrupt", T.StringType())])
    options = {**STRICT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(F.concat(F.lit('{"x":['), marker, F.lit(","), t, F.lit(","), marker, F.lit("]}")), whole, options)

    def middle_of(p: Column) -> Column:
        x = p["x"]
        fits = p["_corrupt"].isNull() & (F.size(x) == 3) & is_marker(x[0]) & is_marker(x[2])
        found = x[1]
        if isinstance(middle, T.StructType):
            found = F.when(found.isNotNull(), F.struct(*[found[f].alias(f) for f in middle.names]))
        return F.when(fits, found)

    # A lambda names the parsed value, so that it is parsed once however often it is used.
    return F.transform(F.array(parsed), middle_of)[0]


def revision(text) -> Column:
    """``{RAW, REVISED}`` of a model reply, or null when it is not usable.

    Usable: one JSON object, nothing before or after it, with a ``REVISED`` list.
    """
    parsed = F.array(parse_whole(text, REVISION))
    return F.transform(parsed, lambda p: F.when(p["REVISED"].isNotNull(), p))[0]


def response_fields(text) -> Column:
    """content, reasoning_content and token counts of a stored response."""
    return F.from_json(_col(text), RESPONSE, STRICT)
