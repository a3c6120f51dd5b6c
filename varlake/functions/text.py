"""Names, slugs, ids and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varlake.fixed_values import SLUG_LENGTH


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def task_to_sentence(task) -> Column:
    """``pick_up_the_cup`` -> ``pick up the cup``."""
    return F.replace(_col(task), F.lit("_"), F.lit(" "))


def suite_of(dataset) -> Column:
    """The first two underscore-separated words of a dataset name."""
    return F.substring_index(_col(dataset), "_", 2)


def decode_text(raw, binary: bool = True) -> Column:
    """Bytes as text; bytes that are not UTF-8 give null instead of failing the job."""
    text = _col(raw).cast("string")
    return F.try_validate_utf8(text) if binary else text


def task_slug(name) -> Column:
    """File-name form of a task: lower case, blanks and dots as underscores, cut short."""
    return F.substring(F.translate(F.lower(_col(name)), " \n.", "___"), 1, SLUG_LENGTH)


def strip_scene_prefix(sentence) -> Column:
    """Drop a leading ``KITCHEN SCENE3``-style marker."""
    return F.regexp_replace(_col(sentence), r"^([A-Z]+ )+SCENE\d+ ", "")


def matches_any(name, patterns: list[str]) -> Column:
    """Does the beginning of the text match one of the patterns?"""
    if not patterns:
        return F.lit(False)
    return _col(name).rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def run_id(suite, family, scope, started_at, note=None) -> Column:
    """``EVAL-suite-family-scope-time`` with an optional ``--note``."""
    base = F.concat_ws("-", F.lit("EVAL"), _col(suite), _col(family), _col(scope), _col(started_at))
    if note is None:
        return base
    return F.concat(base, F.coalesce(F.concat(F.lit("--"), _col(note)), F.lit("")))


def parse_run_id(run) -> Column:
    """Back to its parts; names with dashes are kept whole where the date ends them."""
    pattern = r"^EVAL-(.+?)-([^-]+)-([^-]+)-(\d{4}_\d{2}_\d{2}-\d{2}_\d{2}_\d{2})(?:--(.*))?$"
    part = lambda i: F.regexp_extract(_col(run), pattern, i)
    return F.struct(
        part(1).alias("suite"),
        part(2).alias("model_family"),
        part(3).alias("scope"),
        part(4).alias("started_at"),
        F.when(part(5) != "", part(5)).alias("note"),
    )


def bool_text(flag) -> Column:
    return F.when(_col(flag), F.lit("True")).when(~_col(flag), F.lit("False"))


def rollout_path(run, started_at, episode, success, task) -> Column:
    """Path of the recording of one rollout."""
    return F.concat(
        F.lit("./rollouts/"),
        _col(run),
        F.lit("/"),
        _col(started_at),
        F.lit("--episode="),
        _col(episode).cast("string"),
        F.lit("--success="),
        bool_text(success),
        F.lit("--task="),
        task_slug(task),
        F.lit(".mp4"),
    )


def parse_rollout_path(path) -> Column:
    """Inverse of :func:`rollout_path` (the task only as its slug)."""
    pattern = r"^(?:.*/)?([^/]+)/([^/]+?)--episode=(\d+)--success=(True|False)--task=(.*)\.mp4$"
    part = lambda i: F.regexp_extract(_col(path), pattern, i)
    return F.when(
        _col(path).rlike(pattern),
        F.struct(
            part(1).alias("run_id"),
            part(2).alias("started_at"),
            part(3).cast("int").alias("episode"),
            (part(4) == "True").alias("success"),
            part(5).alias("slug"),
        ),
    )


def stamp_columns() -> list[Column]:
    """A fresh id and the local wall-clock time, for new records."""
    return [
        F.uuid().alias("id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    ]


def percent_text(ratio) -> Column:
    """Percentage with one decimal, rounded on the exact binary value, ties to even."""
    return F.format_number(_col(ratio) * 100, 1)


def float_text(value) -> Column:
    """Shortest text of a double in 0 <= x < 1e7: plain down to 1e-4, ``5e-05`` below."""
    v = _col(value)
    plain = v.cast("string")
    fixed = F.rtrim(F.trim(v.cast("decimal(38,25)").cast("string")), F.lit("0"))
    small = F.regexp_replace(plain, r"(?:\.0)?E-", "e-")
    padded = F.regexp_replace(small, r"e-(\d)$", "e-0$1")
    return F.when((v == 0) | (v >= 1e-3), plain).when(v >= 1e-4, fixed).otherwise(padded)
