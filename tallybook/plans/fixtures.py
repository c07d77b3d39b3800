"""Inputs derived from the given tables.

Each block is SQL that Spark and DuckDB both run unchanged, so queries and their SQL twins share it.
``sql(select, *blocks)`` puts the blocks a statement needs in front of it as CTEs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallybook.session import configure

TABLES = ("events", "conversations", "documents")

BLOCKS = {
    "base": """
SELECT event_id, concat('req-', event_id) AS request_id,
  concat('s', event_id % 3, '-', CAST(floor(event_id / 3) AS BIGINT) % 4) AS tenant_id,
  concat('key-', CASE WHEN event_id % 31 = 1 AND event_id >= 12 THEN event_id - 12 ELSE event_id END)
    AS idempotency_key,
  CASE user_id % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE 'model-c' END AS model,
  10 + user_id % 90 AS prompt_tokens,
  1 + CAST(floor(value) AS BIGINT) AS completion_tokens,
  CASE event_type WHEN 'view' THEN 'client_disconnect' WHEN 'purchase' THEN 'budget_exceeded'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'gateway_shutdown' ELSE 'provider_error' END
    ELSE 'completed' END AS terminal_state,
  event_type, ts AS started_at
FROM events""",
    "requests_started": """
SELECT request_id, idempotency_key, tenant_id, model, prompt_tokens, started_at
FROM base WHERE event_id % 59 <> 1
UNION ALL
SELECT request_id, idempotency_key, tenant_id, model, prompt_tokens,
  started_at + INTERVAL 30 SECOND AS started_at
FROM base WHERE event_id % 61 = 1""",
    "requests_metered": """
SELECT request_id, idempotency_key, tenant_id, model, prompt_tokens, completion_tokens,
  terminal_state, started_at + INTERVAL 5 SECOND AS ended_at
FROM base WHERE event_id % 17 <> 0
UNION ALL
SELECT request_id, idempotency_key, tenant_id, model, prompt_tokens, completion_tokens + 5,
  terminal_state, started_at + INTERVAL 20 SECOND AS ended_at
FROM base WHERE event_id % 17 <> 0 AND event_id % 29 = 0
UNION ALL
SELECT request_id, idempotency_key, tenant_id, model, prompt_tokens - 1 AS prompt_tokens,
  completion_tokens + 3 AS completion_tokens, terminal_state,
  started_at + INTERVAL 5 SECOND AS ended_at
FROM base WHERE event_id % 17 <> 0 AND event_id % 71 = 0
UNION ALL
SELECT request_id, idempotency_key, tenant_id, model, prompt_tokens,
  completion_tokens + 7 AS completion_tokens, terminal_state,
  started_at + INTERVAL 300 SECOND AS ended_at
FROM base WHERE event_id % 13 = 0""",
    "provider_usage": """
SELECT request_id, prompt_tokens,
  completion_tokens + CASE event_id % 7 WHEN 1 THEN 4 WHEN 2 THEN -3 WHEN 3 THEN 1 ELSE 0 END
    AS completion_tokens,
  CASE WHEN event_id % 23 = 0 THEN started_at + INTERVAL 600 SECOND
    ELSE started_at + INTERVAL 6 SECOND END AS reported_at
FROM base WHERE event_id % 10 <> 0
UNION ALL
SELECT request_id, prompt_tokens, completion_tokens + 9 AS completion_tokens,
  started_at + INTERVAL 3 SECOND AS reported_at
FROM base WHERE event_id % 37 = 0
UNION ALL
SELECT request_id, prompt_tokens, completion_tokens + 1 AS completion_tokens,
  started_at + INTERVAL 300 SECOND AS reported_at
FROM base WHERE event_id % 30 = 0""",
    # The published feed: six partitions, offsets rising inside each and with gaps.
    "feed": """
SELECT 'requests.started' AS topic, event_id % 6 AS part, event_id * 2 AS pos, request_id
FROM base
UNION ALL
SELECT 'requests.metered' AS topic, event_id % 6 AS part, event_id * 2 AS pos, request_id
FROM base WHERE event_id % 17 <> 0
UNION ALL
SELECT 'requests.metered' AS topic, event_id % 6 AS part, event_id * 2 + 1 AS pos, request_id
FROM base WHERE event_id % 17 <> 0 AND event_id % 29 = 0
UNION ALL
SELECT 'provider.usage' AS topic, event_id % 6 AS part, event_id * 2 AS pos, request_id
FROM base WHERE event_id % 10 <> 0""",
    # Wire values of ledger A, some of them broken in three ways, some with numbers as text.
    "wire": """
SELECT request_id AS key, event_id,
  CASE WHEN event_id % 41 = 0 THEN concat('{"request_id": "', request_id, '", "tenant_id": ')
    ELSE concat('{"request_id": "', request_id, '", "idempotency_key": "', idempotency_key,
      '", "tenant_id": "', tenant_id, '", "model": "', model, '", "extra": [1, {"x": 2}]',
      CASE WHEN event_id % 43 = 0 THEN '' WHEN event_id % 5 = 0
        THEN concat(', "prompt_tokens": "', prompt_tokens, '"')
        ELSE concat(', "prompt_tokens": ', prompt_tokens) END,
      ', "completion_tokens": ', completion_tokens, ', "terminal_state": "',
      CASE WHEN event_id % 47 = 0 THEN 'vanished' ELSE terminal_state END,
      '", "ended_at": ', event_id, '.5}') END AS value
FROM base""",
    "stream_outcomes": """
SELECT request_id, tenant_id,
  CASE WHEN event_id % 19 = 0 THEN 500 WHEN event_id % 19 = 1 THEN 429 ELSE 200 END AS http_status,
  event_id % 11 = 0 AS transport_failed, event_type = 'purchase' AS draw_refused,
  event_id % 53 = 0 AS cancelled, event_type = 'view' AS client_gone
FROM base""",
    "raw_requests": """
SELECT concat('req-', event_id) AS request_id,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN ''
    ELSE concat('key-', event_id) END AS idempotency_key,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('t', user_id % 7) END AS tenant_id,
  CASE WHEN event_type = 'view' THEN NULL ELSE concat('model-', user_id % 3) END AS model
FROM events""",
    "attempts": """
SELECT concat('req-', event_id) AS request_id, concat('s', event_id % 3) AS tenant_id,
  1 AS attempt, event_id % 9 = 0 AS failed,
  CASE WHEN event_id % 9 = 0 AND event_id % 2 = 0 THEN 0 ELSE 1 + CAST(floor(value) AS BIGINT) END
    AS tokens
FROM events
UNION ALL
SELECT concat('req-', event_id) AS request_id, concat('s', event_id % 3) AS tenant_id,
  2 AS attempt, event_id % 27 = 0 AS failed,
  CASE WHEN event_id % 27 = 0 THEN 0 ELSE 2 + CAST(floor(value) AS BIGINT) END AS tokens
FROM events WHERE event_id % 9 = 0
UNION ALL
SELECT concat('req-', event_id) AS request_id, concat('s', event_id % 3) AS tenant_id,
  3 AS attempt, FALSE AS failed, 7 AS tokens
FROM events WHERE event_id % 27 = 0""",
    "budget_draws": """
SELECT event_id, concat('s', event_id % 3, '-', user_id % 4) AS tenant_id,
  event_id * 100 AS now_ms, 11 + user_id % 90 + CAST(floor(value) AS BIGINT) AS tokens
FROM events""",
    "claim_log": """
SELECT event_id, concat('t', CAST(floor(event_id / 8) AS BIGINT) % 4) AS tenant_id,
  concat('key-', event_id - event_id % 8) AS idempotency_key,
  concat('req-', event_id) AS request_id,
  event_id * 60000 + event_id % 7 * 1000 AS t_ms,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id % 6 * 33000 + 500 END AS dur_ms,
  event_id % 13 = 0 AS released
FROM events""",
    # Streams: one per assistant turn. Times are milliseconds since the log began.
    "streams": """
SELECT concat('chat-', conv_id, '-', turn) AS request_id, concat('t', conv_id % 4) AS tenant_id,
  conv_id, turn, text, 100 + conv_id % 60 * 5 AS admitted, 5 + conv_id % 20 AS prompt_tokens,
  conv_id * 1500 + turn * 9000 AS opened_ms, (conv_id * 733 + turn * 97) % 12000 AS wait_ms,
  3 + conv_id % 40 AS gap_ms, length(text) - length(replace(text, ' ', '')) + 1 AS words
FROM conversations WHERE role = 'assistant'""",
    # The words of each stream are its content lines; line numbers start after two lead-in lines.
    "stream_spans": """
SELECT request_id, tenant_id, opened_ms,
  CASE WHEN conv_id % 25 <> 0 THEN opened_ms + wait_ms + (words + 4) * gap_ms END AS closed_ms
FROM streams""",
}

# Which blocks each block reads.
NEEDS = {
    "requests_started": ["base"],
    "requests_metered": ["base"],
    "provider_usage": ["base"],
    "feed": ["base"],
    "wire": ["base"],
    "stream_outcomes": ["base"],
    "stream_spans": ["streams"],
}


def with_needs(names: list[str]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for part in [*NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    return ordered


def sql(select: str, *names: str, recursive: bool = False, extra: dict[str, str] | None = None):
    """``select`` with its input blocks, and any ``extra`` named statements, in front."""
    parts = {name: BLOCKS[name] for name in with_needs(list(names))} | (extra or {})
    ctes = ",\n".join(f"{name} AS ({body.strip()})" for name, body in parts.items())
    if not ctes:
        return select
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


# The columns of the given tables the blocks read.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table, under its known schema, so that a read starts no job."""
    configure(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One block as a DataFrame over the tables in ``folder``."""
    text = sql(f"SELECT * FROM {name}", name)
    for source in TABLES:
        if f"FROM {source}" in text:
            given = f"given_{source}"
            table(spark, folder, source).createOrReplaceTempView(given)
            text = text.replace(f"FROM {source}", f"FROM {given}")
    return spark.sql(text)


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines each stream was received in.

    A keep-alive comment, an early usage block, a chunk per word, a broken chunk, the final usage
    block and the end marker. One stream in ten reports no usage, one in seven lacks the marker.
    """
    streams = view(spark, folder, "streams").repartition(spark.sparkContext.defaultParallelism)
    blank = F.lit(None).cast("string")
    slots = F.concat(F.array(blank, blank), F.split("text", " "), F.array(blank, blank, blank))
    rows = streams.select(
        "request_id", "conv_id", "turn", "opened_ms", "wait_ms", "gap_ms", "words", "prompt_tokens",
        F.posexplode(slots).alias("seq", "word"),
    )
    gap = F.when(F.col("seq") < F.col("words") + 1, " ").otherwise("")
    delta = F.struct(F.concat("word", gap).alias("content"))
    chunk = F.to_json(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices")))
    reports = F.col("conv_id") % 10 != 0
    early = 'data: {"choices": [], "usage": {"prompt_tokens": 1, "completion_tokens": 1}}'
    short = F.format_string('data: {"choices": [], "usage": {"completion_tokens": %d}}', "words")
    full = F.format_string(
        'data:{"usage": {"prompt_tokens": %d, "completion_tokens": %d}}  ', "prompt_tokens", "words"
    )
    after = F.col("seq") - F.col("words")
    line = (
        F.when(F.col("word").isNotNull(), F.concat(F.lit("data: "), chunk))
        .when(F.col("seq") == 0, ": keep-alive")
        .when(F.col("seq") == 1, F.when(reports, early).otherwise(""))
        .when(after == 2, "data: {not json")
        .when(after == 3, F.when(reports & (F.col("turn") % 4 == 3), short)
              .when(reports, full).otherwise("data: 5"))
        .otherwise(F.when(F.col("conv_id") % 7 != 0, "data: [DONE]").otherwise(""))
    )
    return rows.select(
        "request_id",
        F.col("seq").cast("bigint").alias("seq"),
        line.alias("line"),
        (
            F.col("opened_ms")
            + F.when(F.col("seq") >= 2, F.col("wait_ms")).otherwise(0)
            + F.col("seq") * F.col("gap_ms")
        ).alias("arrived_ms"),
    )


def chat_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """A request body per conversation turn; every third message comes as a list of parts."""
    text = F.col("text")
    plain = F.to_json(
        F.struct(
            F.lit("m").alias("model"),
            F.array(F.struct("role", text.alias("content"))).alias("messages"),
        )
    )

    def part(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("text"))

    parts = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    "role",
                    F.array(
                        part("text", F.substring(text, 1, 10)),
                        part("image_url", F.lit(None).cast("string")),
                        part("text", F.substr(text, F.lit(11))),
                    ).alias("content"),
                )
            ).alias("messages")
        )
    )
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("turn") % 3 == 1, parts).otherwise(plain).alias("body"),
        F.when(F.col("conv_id") % 3 == 1, 0)
        .when(F.col("conv_id") % 3 == 2, F.col("conv_id") * 7)
        .cast("bigint")
        .alias("max_tokens"),
    )
