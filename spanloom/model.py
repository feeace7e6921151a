"""Table schemas, wire aliases, ceilings and windows.

Timestamps are UTC instants, ids are lowercase canonical UUID text (its byte
order is the UUID order), documents are VARIANT.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, B, I, TS = T.StringType(), T.BooleanType(), T.LongType(), T.TimestampType()
DOC = T.MapType(S, T.VariantType())
COST = T.DecimalType(18, 8)
SCORE = T.DecimalType(18, 6)
RATE = T.DecimalType(12, 6)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RAW_BATCHES = _schema(
    batch_id=S, received_at=TS, api_key=S, sdk_version_header=S, body=S
)

TRACES = _schema(
    id=S, project_id=S, name=S, user_id=S, session_id=S, tags=T.ArrayType(S),
    environment=S, release=S, metadata=DOC, started_at=TS, ended_at=TS,
    created_at=TS, updated_at=TS, sdk_version=S,
    observations_started_min=TS, observations_started_max=TS,
)

OBSERVATIONS = _schema(
    id=S, project_id=S, trace_id=S, parent_observation_id=S, type=S, name=S,
    model=S, provider=S, input=T.VariantType(), output=T.VariantType(),
    prompt_tokens=I, completion_tokens=I, cached_tokens=I, reasoning_tokens=I,
    total_tokens=I, cost_usd=COST, latency_ms=I, prompt_name=S, prompt_version=S,
    level=S, status_message=S, metadata=DOC, started_at=TS, ended_at=TS, created_at=TS,
)

SCORES = _schema(
    id=S, project_id=S, trace_id=S, observation_id=S, name=S, data_type=S,
    value=SCORE, value_text=S, comment=S, source=S, metadata=DOC, scored_at=TS,
    created_at=TS,
)

API_KEYS = _schema(
    id=S, project_id=S, key_hash=S, key_prefix=S, label=S, scopes=T.ArrayType(S),
    created_at=TS, revoked_at=TS,
)

MODEL_PRICES = _schema(
    model_key=S, input_usd_per_mtok=RATE, output_usd_per_mtok=RATE,
    cached_input_usd_per_mtok=RATE,
)

# --- Fixed values: wire aliases, first present key wins -----------------------
ALIASES = {
    "parent_observation_id": ["parent_observation_id", "parent_id", "parent"],
    "model": ["model", "gen_ai.request.model", "gen_ai.response.model"],
    "provider": ["provider", "gen_ai.system"],
    "prompt_tokens": ["prompt_tokens", "input_tokens", "gen_ai.usage.input_tokens"],
    "completion_tokens": [
        "completion_tokens", "output_tokens", "gen_ai.usage.output_tokens",
    ],
    "cached_tokens": [
        "cached_tokens", "cache_read_input_tokens",
        "gen_ai.usage.cache_read.input_tokens",
    ],
    "reasoning_tokens": ["reasoning_tokens", "gen_ai.usage.reasoning_tokens"],
    "level": ["level", "status"],
    "started_at": ["started_at", "start_time", "startTime"],
    "trace_started_at": ["started_at", "start_time", "startTime", "timestamp"],
    "ended_at": ["ended_at", "end_time", "endTime"],
    "user_id": ["user_id", "userId"],
    "session_id": ["session_id", "sessionId"],
    "scored_at": ["scored_at", "timestamp", "created_at"],
}

# --- Fixed values: batch ceilings ---------------------------------------------
MAX_TRACES_PER_BATCH = 1_000
MAX_OBSERVATIONS_PER_TRACE = 2_000
MAX_FLAT_OBSERVATIONS_PER_BATCH = 10_000
MAX_SCORES_PER_BATCH = 10_000
CONFIG_MAX_TRACES = 1_000
CONFIG_MAX_OBSERVATIONS = 5_000

# --- Fixed values: text widths that clip --------------------------------------
MAX_TAGS = 32
MAX_TAG_CHARS = 64
CLIP_ENVIRONMENT = 64
CLIP_RELEASE = 128
CLIP_PROMPT_NAME = 255
CLIP_PROMPT_VERSION = 64
CLIP_SCORE_LABEL = 255

# --- Fixed values: column widths that refuse ----------------------------------
WIDTHS = {
    "name": 255, "user_id": 255, "session_id": 255, "type": 32, "model": 255,
    "provider": 64, "level": 16, "status_message": 1024, "source": 32,
    "sdk_version": 64,
}
MAX_INT = 2_147_483_647

# --- Fixed values: event-time windows, in days --------------------------------
MAX_EVENT_AGE_DAYS = 7
MAX_EVENT_FUTURE_DAYS = 1
PARTITION_DAYS_BEHIND = 8
PARTITION_DAYS_AHEAD = 30

# --- Fixed values: domains ----------------------------------------------------
SCORE_TYPES = ["numeric", "boolean", "categorical"]
KEY_SCOPES = ["ingest", "read"]
MEMBER_ROLES = ["owner", "member"]
ERROR_LEVELS = ["error", "fatal", "critical"]

# --- Fixed values: page sizes -------------------------------------------------
DEFAULT_PAGE = 50
MAX_PAGE = 200

# --- Fixed values: model-id qualifiers ----------------------------------------
VENDOR_QUALIFIERS = [
    "openai/", "anthropic/", "azure/", "bedrock/", "vertex_ai/", "vertexai/",
    "google/", "models/", "us.", "eu.", "apac.",
]
DOTTED_VENDORS = ["anthropic.", "openai.", "meta.", "mistral."]

# --- Fixed values: metadata keys shown first ----------------------------------
LEADING_METADATA = [
    "finish_reason", "refusal", "tool_calls", "tools", "time_to_first_token_ms",
    "output_tokens_per_second", "stream_completed", "request_id", "http_status",
    "http_attempts", "upstream_processing_ms", "rate_limit", "system_fingerprint",
    "service_tier",
]
