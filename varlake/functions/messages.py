"""Chat messages built from columns.

A message is ``{role, text, content}``: ``text`` for plain-string content, ``content``
for a list of typed parts. A message that may not be built is null, so callers
split it off with one filter instead of failing the job.

Styles of a user message's images:

* ``marker``   an image part whose text is ``<image>``
* ``bare``     an image part without text
* ``url``      a data URL
* ``url_object`` a data URL, wrapped in an object on the wire
* ``base64``   media type and data; ``<image>`` is appended to the text before it
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varlake.schemas import MESSAGE, PART

IMAGE_STYLES = ("marker", "bare", "url", "url_object", "base64")
IMAGE_MARKER = "<image>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(**fields) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _wide(kind: Column | str, **fields) -> Column:
    """One part with every field present; missing ones null."""
    types = {
        "text": "string",
        "image_url": "string",
        "media_type": "string",
        "data": "string",
        "bbox": "array<double>",
        "point": "array<double>",
        "label": "string",
    }
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        kind.alias("type"),
        *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()],
    )


def _message(role: str, content: Column | None = None, text: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(role).alias("role"),
        (none if text is None else text).cast("string").alias("text"),
        (none if content is None else content).cast(f"ARRAY<{PART}>").alias("content"),
    ).cast(MESSAGE)


def as_list(text) -> Column:
    """A single prompt as a list; an empty one as no prompt."""
    t = _col(text)
    return F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def image_suffix(path) -> Column:
    """File suffix without its dot; in-memory frames (null path) count as jpeg."""
    suffix = F.regexp_extract(_col(path), r"[^/.][^/]*\.([^./]*)$", 1)
    return F.coalesce(suffix, F.lit("jpeg"))


def _base64(content: Column) -> Column:
    # Spark's base64 breaks lines on some releases; a payload must be one line.
    return F.regexp_replace(F.base64(content), r"\s", "")


def image_payload(content, suffix, style: str = "url") -> Column:
    """``{image_url}`` for the URL styles, ``{media_type, data}`` for ``base64``."""
    c, s = _col(content), _col(suffix)
    if style in ("url", "url_object"):
        url = F.concat(F.lit("data:image/"), s, F.lit(";base64,"), _base64(c))
        return F.struct(url.alias("image_url"))
    if style == "base64":
        kind = F.when(s == "jpg", F.lit("jpeg")).otherwise(s)
        return F.struct(
            F.concat(F.lit("image/"), kind).alias("media_type"), _base64(c).alias("data")
        )
    raise ValueError(f"no payload for image style {style!r}")


def _image_part(image: Column, style: str) -> Column:
    if style == "marker":
        return _wide("image", text=F.lit(IMAGE_MARKER))
    if style == "bare":
        return _wide("image")
    payload = image_payload(image["content"], image["suffix"], style)
    if style == "base64":
        return _wide("image", media_type=payload["media_type"], data=payload["data"])
    return _wide("image_url", image_url=payload["image_url"])


def _interleave(prompts: Column, others: Column, make_other, suffix_text=None) -> Column:
    """text i (when not empty), then item i while one exists; what is left over follows."""
    n = F.size(others)
    texts = F.transform(
        prompts,
        lambda p, i: F.when(
            p != "",
            _wide(
                "text",
                text=p if suffix_text is None else F.when(i < n, F.concat(p, suffix_text)).otherwise(p),
            ),
        ),
    )
    items = F.transform(others, make_other)
    pairs = F.zip_with(texts, items, lambda t, o: F.array(t, o))
    return F.filter(F.flatten(pairs), lambda x: x.isNotNull())


def user_message(prompts, images=None, style: str = "marker") -> Column:
    """Text-only when ``images`` is None, else text and images interleaved."""
    p = _col(prompts)
    if images is None:
        kept = F.filter(p, lambda x: x != "")
        return _message("user", F.transform(kept, lambda x: _wide("text", text=x)))
    if style not in IMAGE_STYLES:
        raise ValueError(f"unknown image style {style!r}")
    im = _col(images)
    marker = F.lit(IMAGE_MARKER) if style == "base64" else None
    message = _message("user", _interleave(p, im, lambda i: _image_part(i, style), marker))
    if style != "base64":
        return message
    # The marker needs a text right before every image.
    n = F.size(im)
    enough = n <= F.size(p)
    all_text = F.forall(F.slice(p, F.lit(1), F.least(n, F.size(p))), lambda x: x != "")
    return F.when(enough & all_text, message)


def assistant_message(prompts, sources=None, kind: str = "text", style: str = "parts") -> Column:
    """``text``, ``bbox``, ``point`` (text with located items) or ``reason`` (think, then text)."""
    p = _col(prompts)
    if style not in ("parts", "plain"):
        raise ValueError(f"unknown message style {style!r}")
    if kind == "text":
        if style == "plain":
            return _message("assistant", text=F.array_join(p, ""))
        return _message("assistant", F.transform(p, lambda x: _wide("text", text=x)))
    if kind not in ("bbox", "point", "reason"):
        raise ValueError(f"unknown answer kind {kind!r}")
    if style == "plain":
        raise ValueError(f"{kind} answers have no plain form")
    s = _col(sources)
    if kind == "reason":
        parts = F.array(
            _wide("think", text=F.try_element_at(s, F.lit(1))),
            _wide("text", text=F.try_element_at(p, F.lit(1))),
        )
        return F.when((F.size(s) == 1) & (F.size(p) >= 1), _message("assistant", parts))
    return _message(
        "assistant",
        _interleave(p, s, lambda x: _wide(kind, **{kind: x[kind], "label": x["label"]})),
    )


def system_message(text, style: str = "plain") -> Column:
    """The prompt and a line end, as a string or as a one-part list."""
    t = F.concat(_col(text), F.lit("\n"))
    if style == "plain":
        return _message("system", text=t)
    if style == "parts":
        return _message("system", F.array(_wide("text", text=t)))
    raise ValueError(f"unknown message style {style!r}")


def hoist_system(messages) -> Column:
    """``{system, messages}``: a leading system turn leaves the list."""
    m = _col(messages)
    first = F.try_element_at(m, F.lit(1))
    leads = F.coalesce(first["role"] == "system", F.lit(False))
    return F.struct(
        F.when(leads, first).alias("system"),
        F.when(leads, F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0))))
        .otherwise(m)
        .alias("messages"),
    )


def content_json(message, style: str = "marker") -> Column:
    """Wire form of a message's content: text as is, parts as JSON without null fields."""
    m = _col(message)

    def wire(p):
        url = F.when(p["image_url"].isNotNull(), F.struct(p["image_url"].alias("url")))
        source = F.when(
            p["data"].isNotNull(),
            F.struct(
                F.lit("base64").alias("type"),
                p["media_type"].alias("media_type"),
                p["data"].alias("data"),
            ),
        )
        return _part(
            type=p["type"],
            text=p["text"],
            image_url=url if style == "url_object" else p["image_url"],
            source=source,
            bbox=p["bbox"],
            point=p["point"],
            label=p["label"],
        )

    return F.coalesce(m["text"], F.to_json(F.transform(m["content"], wire)))
