"""Joins against small tables with a default, prompts, and request routing."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlake.fixed_values import (
    DEFAULT_MAX_TOKENS,
    DEFAULT_MODEL,
    DEFAULT_TEMPERATURE,
    IDENTITY_SCOPE,
    MODELS,
    OTHER_PROVIDER,
    STATS_SUFFIX,
)
from varlake.session import BROADCAST_BYTES, broadcast_checked

# One template per scope; pass your own wording to the functions below. Braces follow
# str.format: {sentence} is filled in, doubled braces stand for themselves.
_ANSWER = """
Sentence: {sentence}
Answer with one JSON object and nothing else:
{{"RAW": "<the sentence as given>", "REVISED": ["<version 1>", "<version 2>", "<version 3>"]}}
"""
TEMPLATES = {
    "one": "Write three versions of the sentence, each with a single word swapped for a synonym." + _ANSWER,
    "two": "Write three versions of the sentence, each with two words or one phrase reworded." + _ANSWER,
    "all": "Write three versions of the sentence that say the same in entirely different words." + _ANSWER,
}


def lookup_text(
    tasks: DataFrame, texts: DataFrame, key: str = "task", default: str = "language", order: str = "ord",
    value: str = "new_instruction", limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each task with its evaluation text, or its own; of a repeated task the last text counts."""
    last = texts.groupBy(key).agg(F.max_by(value, order).alias("__text"))
    return (
        tasks.join(broadcast_checked(last, limit), key, "left")
        .withColumn(value, F.coalesce("__text", default))
        .drop("__text")
    )


def lookup_with_suffix(
    keys: DataFrame, stats: DataFrame, key: str = "key", suffix: str = STATS_SUFFIX, limit: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Keys with the statistics key that serves them (itself, else with ``suffix``), and the rest.

    ``stats`` is reduced to its distinct keys first, so it may repeat them.
    """
    known = broadcast_checked(stats.select(F.col(key).alias("__known")).distinct(), limit)
    # Both candidates meet the known keys in one join; the better one is kept per row.
    plain = keys.join(known, keys[key] == F.col("__known"), "left").withColumnRenamed("__known", "__plain")
    both = plain.join(known, F.concat(F.col(key), F.lit(suffix)) == F.col("__known"), "left")
    found = both.withColumn("stats_key", F.coalesce("__plain", "__known")).drop("__plain", "__known")
    return found.where("stats_key IS NOT NULL"), found.where("stats_key IS NULL").drop("stats_key")


def check_scope(df: DataFrame, scopes, column: str = "scope") -> tuple[DataFrame, DataFrame]:
    """Rows whose scope is one of ``scopes``, and the others (null included)."""
    known = F.coalesce(F.col(column).isin(*scopes), F.lit(False))
    return df.where(known), df.where(~known)


def fill_template(template: str, sentence) -> Column:
    """``template.format(sentence=...)`` as a column."""
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    pieces = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            if field != "sentence":
                raise ValueError(f"unknown template field {field!r}")
            pieces.append(s)
    return F.concat(*pieces) if pieces else F.lit("")


def render_prompts(
    sentences: DataFrame, templates: dict[str, str] | None = None, column: str = "instruction", identity: bool = False
) -> DataFrame:
    """Every sentence with every scope's prompt.

    The handful of templates is an array literal in the plan, exploded row by row, so no
    join is needed. With ``identity`` the unchanged scope is added: no prompt,
    ``new_instruction`` already set.
    """
    templates = TEMPLATES if templates is None else templates
    none = F.lit(None).cast("string")
    rows = [
        F.struct(
            F.lit(scope).alias("scope"),
            fill_template(text, column).alias("prompt"),
            none.alias("new_instruction"),
        )
        for scope, text in templates.items()
    ]
    if identity:
        rows.append(
            F.struct(F.lit(IDENTITY_SCOPE).alias("scope"), none.alias("prompt"), F.col(column).alias("new_instruction"))
        )
    return sentences.withColumn("__p", F.explode(F.array(*rows))).select(*sentences.columns, "__p.*")


def route_models(requests: DataFrame, models: dict | None = None, column: str = "model_id") -> DataFrame:
    """Add the provider that serves each model id.

    The table is a literal map of a few dozen names, so routing is a projection.
    """
    models = MODELS if models is None else models
    pairs = [F.lit(x) for provider, names in models.items() for name in names for x in (name, provider)]
    known = F.try_element_at(F.create_map(*pairs), F.col(column))
    return requests.withColumn("provider", F.coalesce(known, F.lit(OTHER_PROVIDER)))


def with_defaults(requests: DataFrame, **defaults) -> DataFrame:
    """Fill missing request fields; what a request sets itself wins."""
    values = {
        "model_id": DEFAULT_MODEL,
        "temperature": DEFAULT_TEMPERATURE,
        "max_tokens": DEFAULT_MAX_TOKENS,
        **defaults,
    }
    if "api_key" in values:
        raise ValueError("keys belong to the client, not into a table")
    present = set(requests.columns)
    return requests.withColumns(
        {n: F.coalesce(F.col(n), F.lit(v)) if n in present else F.lit(v) for n, v in values.items()}
    )


def thinking_temperature(requests: DataFrame, column: str = "thinking", providers=("anthropic",)) -> DataFrame:
    """Requests that ask these providers to think run at temperature 1, whatever they say."""
    forced = F.col(column).isNotNull() & F.col("provider").isin(*providers)
    return requests.withColumn("temperature", F.when(forced, F.lit(1.0)).otherwise(F.col("temperature")))
