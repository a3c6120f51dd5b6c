"""Chat-message queries over ``conversations``: a turn's lines are its prompts, its long words its images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlake.functions import messages as C
from varlake.functions.jsontext import response_fields as read_response
from varlake.operators.enrich import parse_response
from varlake.operators.lookups import route_models, with_defaults
from varlake.plans.registry import query, table


def _turns(spark, sf_dir) -> DataFrame:
    words = F.filter(F.split("text", " "), lambda w: F.length(w) > 14)
    images = F.transform(
        words, lambda w: F.struct(F.encode(w, "UTF-8").alias("content"), F.lit("jpg").alias("suffix"))
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.split("text", "\n").alias("prompts"), words.alias("words"), images.alias("images")
    )


_TURNS_SQL = """WITH t AS (
  SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS prompts,
         list_filter(string_split(text, ' '), lambda w: length(w) > 14) AS words FROM conversations),
p AS (SELECT conv_id, turn, unnest(prompts) AS x, generate_subscripts(prompts, 1) AS i FROM t),
w AS (SELECT conv_id, turn, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM t),
good AS (  -- a text right before every image
  SELECT conv_id, turn FROM t WHERE len(words) <= len(prompts)
    AND NOT list_contains(prompts[1:len(words)], '')) """


def _parts(df: DataFrame, message: Column, *fields: str) -> DataFrame:
    """One row per part of a message, numbered from 1."""
    parts = df.select("conv_id", "turn", message.alias("m")).select(
        "conv_id", "turn", F.posexplode("m.content").alias("pos", "p")
    )
    return parts.select(
        "conv_id", "turn", (F.col("pos") + 1).cast("bigint").alias("part"), *[F.col(f"p.{f}").alias(f) for f in fields]
    )


def _numbered(rows: str, columns: str) -> str:
    return (
        f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, k) AS part, {columns} "
        f"FROM ({rows})"
    )


_TEXT_ROWS = "SELECT conv_id, turn, i, 0 AS k, 'text' AS type, x AS text FROM p WHERE x <> ''"


@query(_TURNS_SQL + _numbered(_TEXT_ROWS, "type, text"))
def messages_text(spark, sf_dir):
    return _parts(_turns(spark, sf_dir), C.user_message("prompts"), "type", "text")


@query(
    _TURNS_SQL
    + _numbered(_TEXT_ROWS + " UNION ALL SELECT conv_id, turn, i, 1, 'image', '<image>' FROM w", "type, text")
)
def messages_interleaved(spark, sf_dir):
    return _parts(_turns(spark, sf_dir), C.user_message("prompts", "images", "marker"), "type", "text")


@query(
    _TURNS_SQL
    + _numbered(
        "SELECT conv_id, turn, i, 0 AS k, 'text' AS type, x AS text, NULL AS image_url FROM p WHERE x <> '' "
        "UNION ALL SELECT conv_id, turn, i, 1, 'image_url', NULL, 'data:image/jpg;base64,' || base64(encode(x)) FROM w",
        "type, text, image_url",
    )
)
def messages_url(spark, sf_dir):
    return _parts(_turns(spark, sf_dir), C.user_message("prompts", "images", "url"), "type", "text", "image_url")


@query(
    _TURNS_SQL
    + _numbered(
        """SELECT p.conv_id, p.turn, p.i, 0 AS k, 'text' AS type,
  p.x || CASE WHEN w.x IS NULL THEN '' ELSE '<image>' END AS text, NULL AS media_type, NULL AS data
FROM p JOIN good USING (conv_id, turn) LEFT JOIN w ON w.conv_id = p.conv_id AND w.turn = p.turn AND w.i = p.i
WHERE p.x <> ''
UNION ALL SELECT conv_id, turn, i, 1, 'image', NULL, 'image/jpeg', base64(encode(x)) FROM w JOIN good USING (conv_id, turn)""",
        "type, text, media_type, data",
    )
)
def messages_marked(spark, sf_dir):
    """The style that marks images in the text before them; turns it cannot serve are left out."""
    message = C.user_message("prompts", "images", "base64")
    return _parts(_turns(spark, sf_dir), message, "type", "text", "media_type", "data")


@query(_TURNS_SQL + "SELECT conv_id, turn FROM t ANTI JOIN good USING (conv_id, turn)")
def messages_rejected(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumn("m", C.user_message("prompts", "images", "base64"))
    return turns.where("m IS NULL").select("conv_id", "turn")


@query(
    _TURNS_SQL
    + _numbered(
        "SELECT conv_id, turn, i, 0 AS k, 'text' AS type, x AS text, NULL::DOUBLE AS width, NULL AS label FROM p WHERE x <> '' "
        "UNION ALL SELECT conv_id, turn, i, 1, 'bbox', NULL, length(x)::DOUBLE, x FROM w",
        "type, text, width, label",
    )
)
def assistant_parts(spark, sf_dir):
    sources = F.transform(
        "words",
        lambda w: F.struct(
            F.array(F.lit(0.0), F.lit(0.0), F.length(w).cast("double"), F.lit(1.0)).alias("bbox"), w.alias("label")
        ),
    )
    message = C.assistant_message("prompts", sources, "bbox")
    rows = _parts(_turns(spark, sf_dir), message, "type", "text", "bbox", "label")
    return rows.withColumn("width", F.try_element_at("bbox", F.lit(3))).drop("bbox")


@query(
    _TURNS_SQL
    + _numbered(
        "SELECT conv_id, turn, i, 0 AS k, 'text' AS type, x AS text, NULL::DOUBLE AS place, NULL AS label FROM p WHERE x <> '' "
        "UNION ALL SELECT conv_id, turn, i, 1, 'point', NULL, length(x)::DOUBLE, x FROM w",
        "type, text, place, label",
    )
)
def assistant_points(spark, sf_dir):
    """Texts with located points."""
    sources = F.transform("words", lambda w: F.struct(F.array(F.lit(0.0), F.length(w).cast("double")).alias("point"), w.alias("label")))
    message = C.assistant_message("prompts", sources, "point")
    rows = _parts(_turns(spark, sf_dir), message, "type", "text", "point", "label")
    return rows.withColumn("place", F.try_element_at("point", F.lit(2))).drop("point")


@query("SELECT conv_id, turn, 1::BIGINT AS part, 'text' AS type, text || chr(10) AS text FROM conversations")
def system_parts(spark, sf_dir):
    """System messages whose content is a list of one part."""
    return _parts(table(spark, sf_dir, "conversations"), C.system_message("text", style="parts"), "type", "text")


@query(
    _TURNS_SQL
    + """SELECT conv_id, turn, k::BIGINT AS part, type, text FROM (
  SELECT conv_id, turn, 1 AS k, 'think' AS type, words[1] AS text FROM t WHERE len(words) = 1
  UNION ALL SELECT conv_id, turn, 2, 'text', prompts[1] FROM t WHERE len(words) = 1)"""
)
def assistant_reasons(spark, sf_dir):
    """Thinking, then the answer, where there is exactly one reason."""
    message = C.assistant_message("prompts", "words", "reason")
    return _parts(_turns(spark, sf_dir), message, "type", "text")


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN text || chr(10) END AS system,
  CASE WHEN role = 'system' THEN 1 ELSE 2 END::INT AS n_messages, role = 'system' AS hoisted FROM conversations"""
)
def system_hoist(spark, sf_dir):
    """Two messages per turn; the first leaves the list when it is a system message."""
    answer = C.assistant_message(C.as_list("text"))
    lead = F.when(F.col("role") == "system", C.system_message("text")).otherwise(C.user_message(C.as_list("text")))
    hoisted = C.hoist_system(F.array(lead, answer))
    out = table(spark, sf_dir, "conversations").select("conv_id", "turn", hoisted.alias("h"))
    return out.select(
        "conv_id",
        "turn",
        F.col("h.system.text").alias("system"),
        F.size("h.messages").alias("n_messages"),
        F.col("h.system").isNotNull().alias("hoisted"),
    )


@query(
    """SELECT page_id, 'image/jpeg' AS media_type, md5('data:image/jpg;base64,' || base64(encode(html))) AS url_md5,
  length(base64(encode(html))) AS n FROM pages"""
)
def image_payload(spark, sf_dir):
    raw, suffix = F.encode("html", "UTF-8"), F.lit("jpg")
    data = C.image_payload(raw, suffix, "base64")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        data["media_type"].alias("media_type"),
        F.md5(C.image_payload(raw, suffix, "url")["image_url"]).alias("url_md5"),
        F.length(data["data"]).cast("bigint").alias("n"),
    )


@query(
    """SELECT doc_id, text AS content, CASE WHEN lang <> 'en' THEN source END AS reasoning, n_chars AS tokens_in,
  length(source) AS tokens_out FROM documents"""
)
def response_fields(spark, sf_dir):
    body = F.to_json(
        F.struct(
            F.col("text").alias("content"),
            F.when(F.col("lang") != "en", F.col("source")).alias("reasoning_content"),
            F.struct(F.col("n_chars").alias("input"), F.length("source").alias("output")).alias("token"),
        )
    )
    r = table(spark, sf_dir, "documents").select("doc_id", body.alias("body")).withColumn("r", read_response("body"))
    return r.select(
        "doc_id",
        F.col("r.content").alias("content"),
        F.col("r.reasoning_content").alias("reasoning"),
        F.col("r.token.input").alias("tokens_in"),
        F.col("r.token.output").alias("tokens_out"),
    )


# --- replies ------------------------------------------------------------------------------------

_REPLY_SQL = """WITH g AS (
  SELECT event_id, event_type, user_id,
    '{"RAW": "u' || user_id || '", "REVISED": ["a' || (props->>'$.k') || '", "b"]}' AS ok FROM events),
r AS (SELECT event_id, event_type, CASE event_type
    WHEN 'error' THEN chr(96) || chr(96) || chr(96) || 'json ' || ok
    WHEN 'view' THEN CASE WHEN user_id < 40 THEN replace(ok, '"', chr(39)) WHEN user_id < 80 THEN ok || ' done'
                     WHEN user_id < 120 THEN ok || '}' ELSE ok || '] [' END
    WHEN 'signup' THEN '{"RAW": "u' || user_id || '", "REVISED": "none"}'
    ELSE '  ' || ok || chr(10) END AS content FROM g),
j AS (SELECT *, json_valid(content) AND CASE WHEN json_valid(content) THEN json_type(content, '$.REVISED') = 'ARRAY' ELSE false END AS good
      FROM r) """


def _replies(spark, sf_dir) -> DataFrame:
    """Model replies of every kind: good, fenced, single-quoted, with a tail, without a list."""
    user = F.col("user_id").cast("string")
    k = F.from_json("props", "k INT")["k"].cast("string")
    ok = F.concat(F.lit('{"RAW": "u'), user, F.lit('", "REVISED": ["a'), k, F.lit('", "b"]}'))
    tails = (
        F.when(F.col("user_id") < 40, F.replace(ok, F.lit('"'), F.lit("'")))
        .when(F.col("user_id") < 80, F.concat(ok, F.lit(" done")))
        .when(F.col("user_id") < 120, F.concat(ok, F.lit("}")))
        .otherwise(F.concat(ok, F.lit("] [")))
    )
    kind = F.col("event_type")
    content = (
        F.when(kind == "error", F.concat(F.lit("```json "), ok))
        .when(kind == "view", tails)
        .when(kind == "signup", F.concat(F.lit('{"RAW": "u'), user, F.lit('", "REVISED": "none"}')))
        .otherwise(F.concat(F.lit("  "), ok, F.lit("\n")))
    )
    return table(spark, sf_dir, "events").select("event_id", "event_type", content.alias("content"))


@query(
    _REPLY_SQL + """SELECT event_id, content->>'$.RAW' AS raw, content->>'$.REVISED[0]' || '|' || (content->>'$.REVISED[1]') AS revised
FROM j WHERE good"""
)
def parse_json_props(spark, sf_dir):
    ok, _ = parse_response(_replies(spark, sf_dir))
    return ok.select("event_id", "raw", F.array_join("revised", "|").alias("revised"))


@query(_REPLY_SQL + "SELECT event_id, event_type, content FROM j WHERE NOT good")
def parse_failures(spark, sf_dir):
    return parse_response(_replies(spark, sf_dir))[1]


@query(
    """SELECT conv_id, turn,
  CASE role WHEN 'assistant' THEN 'gpt-4o-mini' WHEN 'user' THEN 'claude-3-5-sonnet' ELSE 'gpt-4o' END AS model_id,
  CASE role WHEN 'assistant' THEN 'openai' WHEN 'user' THEN 'anthropic' ELSE 'openai' END AS provider,
  CASE WHEN turn = 0 THEN 0.1 ELSE 0.7 END::DOUBLE AS temperature, 4096 AS max_tokens FROM conversations"""
)
def provider_routing(spark, sf_dir):
    model = F.when(F.col("role") == "assistant", "gpt-4o-mini").when(F.col("role") == "user", "claude-3-5-sonnet")
    requests = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", model.alias("model_id"), F.when(F.col("turn") == 0, F.lit(0.1)).alias("temperature")
    )
    return route_models(with_defaults(requests))


@query(
    """SELECT doc_id, source AS model_id, CASE WHEN source IN ('src1', 'src2') THEN 'local' ELSE 'openai_compatible' END
  AS provider FROM documents"""
)
def provider_routing_custom(spark, sf_dir):
    requests = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model_id"))
    return route_models(requests, {"local": ("src1", "src2")})
