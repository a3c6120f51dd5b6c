"""Table shapes shared by readers, operators and tests (DDL strings)."""

from __future__ import annotations

# One recorded episode: a row with its steps nested.
STEP = (
    "STRUCT<action: ARRAY<FLOAT>, discount: FLOAT, is_first: BOOLEAN, is_last: BOOLEAN, "
    "is_terminal: BOOLEAN, language_instruction: STRING, reward: FLOAT, "
    "observation: STRUCT<image: BINARY, wrist_image: BINARY, joint_state: ARRAY<FLOAT>, state: ARRAY<FLOAT>>>"
)
EPISODE = f"episode_id LONG, file_path STRING, steps ARRAY<{STEP}>"

# episode ordinal -> instruction, and instruction -> variants.
INSTRUCTION_MAP = "episode_id LONG, instruction STRING"
VARIANT = "suite STRING, scope STRING, ord INT, instruction STRING, pos INT, variant STRING"

# Texts used by an evaluation run. The wire spelling of the last field is fixed.
EVAL_TEXT_WIRE = "task STRING, instruction STRING, new_instroduction STRING"

# Model request and response.
RESPONSE = (
    "STRUCT<content: STRING, reasoning_content: STRING, token: STRUCT<input: LONG, output: LONG>>"
)
REVISION = "STRUCT<RAW: STRING, REVISED: ARRAY<STRING>>"

# One part of a chat message; unused fields stay null.
PART = (
    "STRUCT<type: STRING, text: STRING, image_url: STRING, media_type: STRING, data: STRING, "
    "bbox: ARRAY<DOUBLE>, point: ARRAY<DOUBLE>, label: STRING>"
)
# ``text`` holds plain-string content, ``content`` typed parts; exactly one is set.
MESSAGE = f"STRUCT<role: STRING, text: STRING, content: ARRAY<{PART}>>"

# One finished rollout.
ROLLOUT = (
    "run_id STRING, suite STRING, model_family STRING, scope STRING, started_at STRING, "
    "task_name STRING, task_text STRING, episode_in_task INT, episode_in_run INT, success BOOLEAN"
)

# One training batch.
TRAIN_METRIC = "run_id STRING, batch_idx LONG, loss DOUBLE, action_accuracy DOUBLE, l1_loss DOUBLE"

# Keyed table.
KEYED = "key STRING, value STRING, seq LONG, shard INT"
