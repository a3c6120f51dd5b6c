"""These must equal the published ones for results to agree."""

from __future__ import annotations

# Scopes in merge order; "zero" leaves the instruction unchanged.
SCOPES = ("one", "two", "all")
IDENTITY_SCOPE = "zero"

# Longest rollout per task suite, in steps, not counting the settling steps.
STEP_BUDGETS = {
    "libero_spatial": 220,
    "libero_object": 280,
    "libero_goal": 300,
    "libero_10": 520,
    "libero_90": 400,
}
SETTLING_STEPS = 10

# Inputs per external call batch.
CHUNK_SIZE = 80

# Longest task slug in a rollout file name.
SLUG_LENGTH = 50

# Request defaults.
DEFAULT_MODEL = "gpt-4o"
DEFAULT_TEMPERATURE = 0.7
DEFAULT_MAX_TOKENS = 4096

# Suffix tried when a statistics key is missing.
STATS_SUFFIX = "_no_noops"

# Public model ids by provider; anything else speaks the OpenAI protocol.
OTHER_PROVIDER = "openai_compatible"
MODELS = {
    "anthropic": (
        "claude-1",
        "claude-2",
        "claude-2.0",
        "claude-2.1",
        "claude-3-haiku-20240307",
        "claude-3-haiku-20240307-vertex",
        "claude-3-sonnet-20240229",
        "claude-3-sonnet-20240229-vertex",
        "claude-3-5-sonnet",
        "claude-3-5-sonnet-20240620",
        "claude-3-5-sonnet-20241022",
        "claude-3-7-sonnet-20250219",
        "claude-sonnet-4-20250514",
        "claude-opus-4-20250514",
        "claude-3-opus-20240229",
        "claude-instant-1",
        "claude-instant-1.2",
    ),
    "openai": (
        "gpt-3.5-turbo",
        "gpt-3.5-turbo-0301",
        "gpt-3.5-turbo-0613",
        "gpt-3.5-turbo-1106",
        "gpt-3.5-turbo-0125",
        "gpt-4",
        "gpt-4-0314",
        "gpt-4-0613",
        "gpt-4-turbo",
        "gpt-4-1106-preview",
        "gpt-4-0125-preview",
        "gpt-4-turbo-browsing",
        "gpt-4-turbo-2024-04-09",
        "gpt2-chatbot",
        "im-also-a-good-gpt2-chatbot",
        "im-a-good-gpt2-chatbot",
        "gpt-4o-mini-2024-07-18",
        "gpt-4o-2024-05-13",
        "gpt-4o-2024-08-06",
        "gpt-4o-2024-11-20",
        "gpt-4o",
        "gpt-4o-mini",
        "chatgpt-4o-latest-20240903",
        "chatgpt-4o-latest",
        "o1-preview",
        "o1-mini",
    ),
    "deepseek": (
        "deepseek-chat",
        "deepseek-reasoner",
    ),
}
