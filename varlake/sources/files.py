"""JSON, JSONL, text and image files."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlake.fixed_values import SCOPES
from varlake.functions.jsontext import STRICT, parse_whole
from varlake.functions.messages import image_suffix
from varlake.functions.text import parse_run_id
from varlake.operators.segments import split_ids, with_ordinal
from varlake.schemas import EVAL_TEXT_WIRE
from varlake.session import broadcast_checked, cut_lineage


def _paths(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _text(spark: SparkSession, paths, strict: bool, **options) -> DataFrame:
    """Text of all paths that exist; a missing one is a warning, or an error if ``strict``."""
    found = []
    for path in _paths(paths):
        try:
            found.append(spark.read.format("text").options(**options).load(path).select("*", "_metadata"))
        except AnalysisException as e:
            if strict or e.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"{path} does not exist; nothing read", stacklevel=3)
    if not found:
        empty = spark.range(0)
        meta = F.struct(
            F.lit("").alias("file_path"), F.lit("").alias("file_name"), F.lit(0).alias("file_block_start")
        )
        return empty.select(F.lit("").alias("value"), meta.alias("_metadata"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


# --- JSON objects -------------------------------------------------------------------


def _last_wins(doc: Column) -> Column:
    """Entries of a map as (key, value): a repeated key has its last value, at its first place."""
    placed = F.transform(F.map_entries(doc), lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))

    def once(s: Column) -> Column:
        n = F.size(s)
        firsts = F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["key"] != e["key"]))
        lasts = F.filter(s, lambda e, i: (i == n - 1) | (F.get(s, i + 1)["key"] != e["key"]))
        met = F.zip_with(firsts, lasts, lambda a, b: F.struct(a["i"].alias("i"), a["key"].alias("key"), b["value"].alias("value")))
        return F.array_sort(met)

    # By key, then place; the lambda names the sorted entries, which are used many times.
    return F.transform(F.array(F.array_sort(placed)), once)[0]


def _documents(spark: SparkSession, paths, kind: str, strict: bool) -> DataFrame:
    """(path, text, doc): every file, parsed as one JSON object or null."""
    docs = _text(spark, paths, strict, wholetext=True, recursiveFileLookup=True)
    parsed = F.explode_outer(F.array(parse_whole("value", f"MAP<STRING, {kind}>"))).alias("doc")
    return docs.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), parsed)


def read_json_map(spark: SparkSession, paths, kind: str = "STRING", strict: bool = False) -> DataFrame:
    """(path, pos, key, value) of files that each hold one JSON object, in document order.

    A repeated key has its last value, at the place of its first. ``pos`` counts from 0; in a map
    that was written in several documents it goes on from one to the next. A missing or
    unreadable file contributes nothing (:func:`bad_documents` lists the unreadable), or fails
    the read if ``strict``. A document is one row, so keep documents at file size; bulk data
    belongs in JSONL.
    """
    docs = _documents(spark, paths, kind, strict)
    if strict:
        message = F.concat(F.lit("not a JSON object: "), F.col("path"))
        docs = docs.withColumn("doc", F.coalesce("doc", F.raise_error(message)))
    before = F.coalesce(F.try_to_number(F.regexp_extract("path", r"/first=(\d+)/[^/]*$", 1), F.lit("9" * 18)).cast("bigint"), F.lit(0))
    entries = docs.select("path", before.alias("before"), F.posexplode(_last_wins(F.col("doc"))).alias("p", "e"))
    return entries.select("path", (F.col("before") + F.col("p")).alias("pos"), "e.key", "e.value")


def bad_documents(spark: SparkSession, paths, kind: str = "STRING") -> DataFrame:
    """(path, text) of the files that :func:`read_json_map` can't read as one JSON object."""
    return _documents(spark, paths, kind, False).where("doc IS NULL").select("path", "text")


def read_variants(
    spark: SparkSession, paths, scopes=SCOPES, strict: bool = False, suites: list[str] | None = None
) -> DataFrame:
    """(suite, scope, ord, instruction, pos, variant) from ``{scope}_{suite}.json`` files or folders.

    A scope without a file contributes nothing, or is an error if ``strict``. ``scopes=None``
    reads files of every name, for :func:`varlake.operators.variants.unknown_scopes` to list.
    """
    pattern = r"/(?:file=)?([^/_]+)_([^/]+)\.json(?:/|$)"
    rows = read_json_map(spark, paths, "ARRAY<STRING>", strict).select(
        F.regexp_extract("path", pattern, 2).alias("suite"),
        F.regexp_extract("path", pattern, 1).alias("scope"),
        F.col("pos").alias("ord"),
        F.col("key").alias("instruction"),
        F.posexplode("value").alias("pos", "variant"),
    )
    rows = rows if scopes is None else rows.where(F.col("scope").isin(*scopes))
    if strict:
        lacking = missing_scopes(rows, scopes or SCOPES, suites).first()
        if lacking:
            raise FileNotFoundError(f"{lacking['suite']} has no file for {', '.join(lacking['missing'])}")
    return rows


def _json_text(value: Column) -> Column:
    """A value of any type as JSON, null included."""
    in_list = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(in_list, F.lit(2), F.length(in_list) - 2)


def _list_pieces(first: Column, key: Column, pos: Column, item: Column) -> Column:
    """A row's piece of a JSON object of lists: ``first`` opens the object, place 0 a key's list."""
    head = F.concat(F.when(first, F.lit("{")).otherwise(F.lit("],")), _json_text(key), F.lit(": ["))
    return F.concat(F.when(pos == 0, head).otherwise(F.lit(",")), _json_text(item))


def write_index(index: DataFrame, path: str) -> None:
    """An inverted index as one JSON object, ``{instruction: [key, ..]}``, by first appearance.

    ``index`` is the result of :func:`varlake.operators.variants.episodes_per_instruction`; it is
    written piece by piece in order, so no list is ever built.
    """
    names = with_ordinal(index.select("instruction", "first_ord").distinct(), "first_ord", "__o", ties=("instruction",))
    numbered = index.join(broadcast_checked(names.select("instruction", (F.col("__o") - 1).alias("ord"))), "instruction")
    pos = F.col("pos") - 1
    piece = _list_pieces(F.col("ord") == 0, F.col("instruction"), pos, F.col("key"))
    rows = numbered.select(F.lit(0).alias("first"), "ord", pos.alias("pos"), piece.alias("value"))
    ends = rows.groupBy("first").agg((F.max("ord") + 1).alias("ord")).select("first", "ord", F.lit(0).cast("bigint").alias("pos"), F.lit("]}").alias("value"))
    _write_pieces(rows.unionByName(ends), path, "first", "ord", "pos")


def read_index(spark: SparkSession, path: str, kind: str = "BIGINT") -> DataFrame:
    """(instruction, ord, pos, key) of an exported index, places from 0."""
    lists = read_json_map(spark, path, f"ARRAY<{kind}>")
    return lists.select(F.col("key").alias("instruction"), F.col("pos").alias("ord"), F.posexplode("value").alias("pos", "key"))


def write_variants(variants: DataFrame, path: str) -> None:
    """``{scope}_{suite}.json`` folders below ``path``, for :func:`read_variants` to find.

    ``variants`` is (suite, scope, ord, instruction, pos, variant), ``ord`` and ``pos`` from 0. Each
    scope and suite is one document, however long: its task writes it piece by piece in
    order, and no list is ever built.
    """
    name = F.concat(F.col("scope"), F.lit("_"), F.col("suite"), F.lit(".json")).alias("file")
    piece = _list_pieces(F.col("ord") == 0, F.col("instruction"), F.col("pos"), F.col("variant"))
    at = [F.col("ord").cast("bigint").alias("ord"), F.col("pos").cast("bigint").alias("pos")]
    rows = variants.select(name, *at, piece.alias("value"))
    ends = rows.groupBy("file").agg((F.max("ord") + 1).alias("ord")).select("file", "ord", F.lit(0).cast("bigint").alias("pos"), F.lit("]}").alias("value"))
    _write_pieces(rows.unionByName(ends), path, "file", "ord", "pos")


def _write_pieces(rows: DataFrame, path: str, folder: str, *order: str) -> None:
    """The ``value`` of each row as a line, one file per folder, in order."""
    laid = rows.repartition(folder).sortWithinPartitions(folder, *order)
    laid.select(folder, "value").write.mode("overwrite").partitionBy(folder).text(path)


def missing_scopes(variants: DataFrame, scopes=SCOPES, suites: list[str] | None = None) -> DataFrame:
    """(suite, missing) for every suite that lacks one of the scopes."""
    have = variants.groupBy("suite").agg(F.collect_set("scope").alias("have"))
    if suites is not None:
        wanted = variants.sparkSession.createDataFrame([(s,) for s in suites], "suite STRING")
        have = wanted.join(have, "suite", "left")
    all_scopes = F.array(*[F.lit(s) for s in scopes])
    missing = F.array_except(all_scopes, F.coalesce("have", F.array().cast("array<string>")))
    return have.select("suite", missing.alias("missing")).where(F.size("missing") > 0)


def write_json_map(df: DataFrame, path: str, key: str, value: str, order: str, chunk: int | None = None) -> None:
    """A JSON object with the entries in ``order``, an integer from 0 without gaps.

    One document, written piece by piece by one task. With ``chunk``, documents of at most that
    many entries, each a file of its own in a folder named by its first place, so that
    :func:`read_json_map` counts on from one to the next.
    """
    at = F.col(order).cast("bigint")
    first = F.lit(0).cast("bigint") if chunk is None else F.floor(at / chunk).cast("bigint") * chunk
    opens = F.when(at == first, F.lit("{")).otherwise(F.lit(","))
    piece = F.concat(opens, _json_text(F.coalesce(F.col(key).cast("string"), F.lit("null"))), F.lit(": "), _json_text(F.col(value)))
    rows = df.select(first.alias("first"), at.alias("at"), piece.alias("value"))
    ends = rows.groupBy("first").agg((F.max("at") + 1).alias("at")).withColumn("value", F.lit("}"))
    _write_pieces(rows.unionByName(ends), path, "first", "at")


# --- records -------------------------------------------------------------------------


def read_records(spark: SparkSession, paths, schema) -> DataFrame:
    """Files, or folders of files, holding a JSON list of records each; a missing field is null."""
    options = {**STRICT, "multiLine": True, "recursiveFileLookup": True}
    return spark.read.schema(schema).options(**options).json(_paths(paths))


def write_record_lists(
    df: DataFrame, path: str, order: str, chunk: int = 10_000, keep_order: bool = True
) -> None:
    """JSON lists of at most ``chunk`` consecutive records each, one file per list.

    The ``order`` column is part of the records only with ``keep_order``.
    """
    rows = with_ordinal(df, order, "__o")
    part = F.floor((F.col("__o") - 1) / chunk).cast("bigint").alias("chunk")
    fields = [F.col(f"`{c}`") for c in df.columns if keep_order or c != order]
    lists = rows.groupBy(part).agg(
        F.array_sort(F.collect_list(F.struct("__o", F.struct(*fields).alias("r"))))["r"].alias("e")
    )
    text = F.to_json("e", {"ignoreNullFields": "false"})
    lists.select("chunk", text.alias("value")).write.mode("overwrite").partitionBy("chunk").text(path)


def read_eval_texts(spark: SparkSession, paths) -> DataFrame:
    """(suite, scope, task, instruction, new_instruction) from ``suite/scope/instruction.json``.

    A file without the instruction field takes it from the task name.
    """
    rows = read_records(spark, paths, EVAL_TEXT_WIRE).select("*", "_metadata.file_path")
    folder = r"/([^/]+)/([^/]+)/instruction\.json(?:/|$)"
    return rows.select(
        F.regexp_extract("file_path", folder, 1).alias("suite"),
        F.regexp_extract("file_path", folder, 2).alias("scope"),
        "task",
        F.coalesce("instruction", F.replace(F.col("task"), F.lit("_"), F.lit(" "))).alias("instruction"),
        F.col("new_instroduction").alias("new_instruction"),
    )


def write_eval_texts(df: DataFrame, path: str, order: str) -> None:
    """JSON lists of {task, instruction, new_instroduction}, in ``order``."""
    wire = F.col("new_instruction").alias("new_instroduction")
    write_record_lists(df.select(order, "task", "instruction", wire), path, order, keep_order=False)


def write_records(df: DataFrame, path: str, mode: str = "overwrite", order_by: list[str] | None = None) -> None:
    """JSON lines, nulls kept, non-ASCII text as is; ``order_by`` sorts across all files."""
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_records(df, path, "append")


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    write_records(df, path, "overwrite")


def record_count(df: DataFrame) -> int:
    return df.count()


def read_jsonl(
    spark: SparkSession, paths, schema: str, on_error: str = "quarantine", strict_paths: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Records with (path, block_start, line_seq), and the lines that are not records.

    ``quarantine`` keeps every good line; ``prefix`` keeps the lines of a file before its
    first bad one; ``fail`` stops at a bad line. A literal null counts as bad. Lines are
    ordered by where their block starts and by their place in it, which a split file
    keeps.
    """
    if on_error not in ("quarantine", "prefix", "fail"):
        raise ValueError("on_error is 'quarantine', 'prefix' or 'fail'")
    lines = _text(spark, paths, strict_paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_seq"),
        F.col("value").alias("line"),
    )
    parsed = lines.withColumn("r", parse_whole("line", T.StructType.fromDDL(schema).simpleString()))
    good = F.col("r").isNotNull()
    place = ["path", "block_start", "line_seq"]
    if on_error == "fail":
        message = F.concat(F.lit("bad line in "), F.col("path"), F.lit(": "), F.col("line"))
        parsed = parsed.withColumn("r", F.when(good, F.col("r")).otherwise(F.raise_error(message)))
        return parsed.select(*place, "r.*"), lines.limit(0)
    bad = parsed.where(~good).select(*place, "line")
    kept = _before_first_bad(parsed) if on_error == "prefix" else parsed.where(good)
    return kept.select(*place, "r.*"), bad


def _before_first_bad(parsed: DataFrame) -> DataFrame:
    """Lines of a file before its first bad one.

    A first pass finds, per split of a file, its lines' numbers and the first bad one: one row per
    split is all that is stored. Line numbers hold as long as files are split alike; the second
    pass checks that against the first and fails rather than compare other numbers.
    """
    splits = parsed.groupBy("path", "block_start").agg(
        F.min("line_seq").alias("from"),
        F.count("*").alias("lines"),
        F.min(F.when(F.col("r").isNull(), F.col("line_seq"))).alias("bad"),
    )
    splits = cut_lineage(splits)
    first = splits.where("bad IS NOT NULL").groupBy("path").agg(F.min(F.struct("block_start", "bad")).alias("first_bad"))
    known = splits.join(first, "path", "left").drop("bad")
    met = parsed.join(broadcast_checked(known), ["path", "block_start"], "left")
    alike = F.coalesce(F.col("line_seq").between(F.col("from"), F.col("from") + F.col("lines") - 1), F.lit(False))
    moved = F.raise_error(F.concat(F.lit("files are split otherwise than before, read again: "), F.col("path"))).cast("boolean")
    ahead = F.col("first_bad").isNull() | (F.struct("block_start", "line_seq") < F.col("first_bad"))
    return met.where(F.when(alike, ahead).otherwise(moved))


def split_write(df: DataFrame, n: int, key: str, path: str) -> None:
    """``n`` contiguous parts in ``key`` order, sizes within one, as ``part=0 .. n-1``."""
    parts = split_ids(df, key, n)
    parts.sortWithinPartitions("part", key).write.mode("overwrite").partitionBy("part").json(path)


# --- evaluation logs -------------------------------------------------------------------

_BLOCK_BREAK = "\n\nTask: "


def read_eval_logs(spark: SparkSession, paths, strict: bool = False) -> DataFrame:
    """(run columns, path, block_start, block_no, block): one row per rollout in a log.

    The blank line and ``Task:`` that open a rollout serve as the record separator, so
    a log of any length is split between tasks and no line loses its context.
    """
    raw = _text(spark, paths, strict, lineSep=_BLOCK_BREAK, recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    run = F.regexp_extract(path, r"(EVAL-[^/]*?)(?:\.txt)?(?:/[^/]*){0,2}$", 1)
    return raw.select(
        run.alias("run_id"),
        parse_run_id(run).alias("p"),
        path.alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("block_no"),
        F.regexp_replace("value", r"^\s*Task: ", "").alias("block"),
    ).select("run_id", "p.*", "path", "block_start", "block_no", "block")


def write_report(blocks: DataFrame, path: str, episodes_per_file: int = 100_000) -> None:
    """Log files, one directory per run, in episode order.

    A long run is cut into several files by episode; each is readable on its own.
    """
    head = F.concat(F.lit("Task suite: "), F.col("suite"), F.lit("\n"))
    first = F.col("episode_in_run") == 1
    text = F.concat(F.when(first, head).otherwise(F.lit("")), F.lit("\n"), F.col("block"))
    part = F.floor((F.col("episode_in_run") - 1) / episodes_per_file).cast("bigint")
    (
        blocks.select("run_id", part.alias("part"), "episode_in_run", text.alias("value"))
        .repartition("run_id", "part")
        .sortWithinPartitions("run_id", "part", "episode_in_run")
        .select("run_id", "part", "value")
        .write.mode("overwrite")
        .partitionBy("run_id", "part")
        .text(path)
    )


# --- images ------------------------------------------------------------------------------


def read_images(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, suffix, content): whole files, read only where ``content`` is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", image_suffix("path").alias("suffix"), "content")
