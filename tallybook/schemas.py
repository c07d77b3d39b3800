"""Record layouts and enumerations. Epoch seconds on the wire, timestamps in tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Topic names.
STARTED = "requests.started"
METERED = "requests.metered"
USAGE = "provider.usage"
SETTLEMENTS = "settlements"
DRIFT = "drift"

# How a stream ended.
COMPLETED = "completed"
CLIENT_DISCONNECT = "client_disconnect"
PROVIDER_ERROR = "provider_error"
BUDGET_EXCEEDED = "budget_exceeded"
GATEWAY_SHUTDOWN = "gateway_shutdown"
TERMINAL_STATES = (COMPLETED, CLIENT_DISCONNECT, PROVIDER_ERROR, BUDGET_EXCEEDED, GATEWAY_SHUTDOWN)

# Settlement status.
SETTLED = "settled"
SETTLED_WITH_DRIFT = "settled_with_drift"
FORCE_SETTLED = "force_settled"

# Why two ledgers disagree.
RETRY_DOUBLE_COUNT = "retry_double_count"
CLIENT_DISCONNECT_PARTIAL = "client_disconnect_partial"
BUDGET_TRUNCATED = "budget_truncated"
GATEWAY_CRASH_PARTIAL = "gateway_crash_partial"
TOKENIZER_MISMATCH = "tokenizer_mismatch"
PROVIDER_UNDERREPORT = "provider_underreport"
UNSETTLED_TIMEOUT = "unsettled_timeout"

# The drift reason a cut stream explains.
PARTIAL_STATES = {
    CLIENT_DISCONNECT: CLIENT_DISCONNECT_PARTIAL,
    BUDGET_EXCEEDED: BUDGET_TRUNCATED,
    GATEWAY_SHUTDOWN: GATEWAY_CRASH_PARTIAL,
}

UNKNOWN_MODEL = "unknown"
DEFAULT_TENANT = "default"


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "timestamp": T.TimestampType(),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(fields: str) -> T.StructType:
    """A schema from "name type, ..."; unlike the DDL parser it needs no running session."""
    pairs = [field.split() for field in fields.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


STARTED_SCHEMA = _struct(
    "request_id string, idempotency_key string, tenant_id string, model string, "
    "prompt_tokens bigint, started_at timestamp"
)
METERED_SCHEMA = _struct(
    "request_id string, idempotency_key string, tenant_id string, model string, "
    "prompt_tokens bigint, completion_tokens bigint, terminal_state string, ended_at timestamp"
)
USAGE_SCHEMA = _struct(
    "request_id string, prompt_tokens bigint, completion_tokens bigint, reported_at timestamp"
)
SETTLEMENT_SCHEMA = _struct(
    "request_id string, tenant_id string, model string, status string, metered_total bigint, "
    "provider_total bigint, drift_tokens bigint, drift_reason string, settled_at timestamp"
)
PENDING_SCHEMA = _struct("request_id string, tenant_id string, started_at timestamp")
DRIFT_SCHEMA = _struct(
    "request_id string, tenant_id string, reason string, drift_tokens bigint, "
    "detail map<string,string>"
)
FEED_SCHEMA = _struct(
    "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
)

TOPIC_SCHEMAS = {STARTED: STARTED_SCHEMA, METERED: METERED_SCHEMA, USAGE: USAGE_SCHEMA}
ARRIVAL = {STARTED: "started_at", METERED: "ended_at", USAGE: "reported_at"}
