"""Ledger event feeds: Kafka or files in, typed rows out, typed rows back to the wire."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallybook import schemas as S
from tallybook.functions.tokens import from_epoch, to_epoch

INPUT_TOPICS = (S.STARTED, S.METERED, S.USAGE)
REPLAY_LIMIT = 5_000


def kafka_feed(
    spark: SparkSession,
    bootstrap: str,
    topics: Sequence[str] = INPUT_TOPICS,
    *,
    max_per_trigger: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """The topics as one stream from the earliest record. Needs Spark's Kafka connector."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .options(**(options or {}))
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(
        F.col("key").cast("string"), F.col("value").cast("string"),
        "topic", "partition", "offset", "timestamp",
    )


def file_feed(
    spark: SparkSession, folder: str, *, stream: bool = True, max_files: int | None = None
) -> DataFrame:
    """The same columns from JSON files, as a stream or a batch."""
    if not stream:
        return spark.read.schema(S.FEED_SCHEMA).json(folder)
    reader = spark.readStream.schema(S.FEED_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def _whole(text: Column) -> Column:
    """A whole number, also when written with an empty fraction."""
    number = text.try_cast("decimal(38,6)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def _typed(schema: T.StructType) -> tuple[dict[str, Column], Column]:
    """Typed columns of the variant ``_r``, and the first field that is missing or of the wrong type."""
    typed, bad = {}, F.lit(None).cast("string")
    for field in reversed(schema.fields):
        path = f"$.{field.name}"
        text = F.try_variant_get("_r", path, "string")
        if isinstance(field.dataType, T.LongType):
            value = _whole(text)
        elif isinstance(field.dataType, T.TimestampType):
            value = from_epoch(text.try_cast("double"))
        elif field.name == "terminal_state":
            value = F.when(text.isin(*S.TERMINAL_STATES), text)
        else:
            kind = F.schema_of_variant(F.try_variant_get("_r", path, "variant"))
            value = F.when(kind == "STRING", text)
        typed[field.name] = value
        bad = F.when(value.isNull(), F.lit(field.name)).otherwise(bad)
    return typed, F.when(F.col("_r").isNull(), F.lit("not json")).otherwise(bad)


def decode(feed: DataFrame, topic: str) -> DataFrame:
    """Records of one topic as typed columns, the record as ``value`` and an ``error``, NULL if good.

    Unknown fields are ignored. A record fails when it is not JSON, lacks a field, holds a value of
    the wrong type or an unknown terminal state.
    """
    schema = S.TOPIC_SCHEMAS[topic]
    typed, bad = _typed(schema)
    return (
        feed.where(F.col("topic") == topic)
        .withColumn("_r", F.try_parse_json("value"))
        .withColumn("error", bad)
        .withColumns({f.name: typed[f.name] for f in schema.fields})
        .drop("_r")
    )


def decode_all(feed: DataFrame) -> DataFrame:
    """Records of all input topics in one read of the feed.

    Gives the columns of every topic (NULL where a topic has none), the arrival time as ``at``, and
    ``error``. Records of other topics are left out.
    """
    fields = {f.name: f for topic in INPUT_TOPICS for f in S.TOPIC_SCHEMAS[topic].fields}
    every = T.StructType(list(fields.values()))
    times = [S.ARRIVAL[topic] for topic in INPUT_TOPICS]
    bad, at = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    typed, _ = _typed(every)
    for topic in INPUT_TOPICS:
        here = F.col("topic") == topic
        bad = F.when(here, _typed(S.TOPIC_SCHEMAS[topic])[1]).otherwise(bad)
        at = F.when(here, typed[S.ARRIVAL[topic]]).otherwise(at)
    return (
        feed.where(F.col("topic").isin(*INPUT_TOPICS))
        .withColumn("_r", F.try_parse_json("value"))
        .withColumn("error", bad)
        .withColumns({n: c for n, c in typed.items() if n not in times} | {"at": at})
        .drop("_r")
    )


def good(decoded: DataFrame, topic: str) -> DataFrame:
    return decoded.where(F.col("error").isNull()).select(
        *[f.name for f in S.TOPIC_SCHEMAS[topic].fields]
    )


def quarantine(decoded: DataFrame) -> DataFrame:
    """Records that could not be decoded, as they came, with the reason."""
    kept = [c for c in S.FEED_SCHEMA.names if c in decoded.columns]
    return decoded.where(F.col("error").isNotNull()).select(*kept, "error")


def route(feed: DataFrame) -> dict[str, DataFrame]:
    """The good records of each input topic."""
    return {topic: good(decode(feed, topic), topic) for topic in INPUT_TOPICS}


def encode(rows: DataFrame, topic: str, key: str = "request_id") -> DataFrame:
    """Rows as keyed JSON records of a topic, times as epoch seconds."""
    fields = [
        to_epoch(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
        else F.col(f.name)
        for f in rows.schema.fields
    ]
    return rows.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"),
        F.lit(topic).alias("topic"),
    )


def publish(
    records: DataFrame, bootstrap: str, options: dict[str, str] | None = None
) -> None:
    """Write encoded records to Kafka (a batch; streams use ``writeStream`` on the same columns)."""
    (
        records.write.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .options(**(options or {}))
        .save()
    )


def tail_replay(feed: DataFrame, limit: int = REPLAY_LIMIT) -> DataFrame:
    """The records of the last ``limit`` offsets of each topic partition, as a second delivery
    would bring them. Where offsets have gaps these are fewer records than offsets.

    The ends are one row per topic partition, whose number brokers bound, so they are broadcast and the
    feed is read and filtered without being moved.
    """
    ends = feed.groupBy("topic", "partition").agg(F.max("offset").alias("_end"))
    first = F.greatest(F.col("_end") + 1 - limit, F.lit(0))
    return (
        feed.join(F.broadcast(ends), ["topic", "partition"])
        .where(F.col("offset") >= first)
        .select(*feed.columns)
    )


def with_replay(feed: DataFrame, limit: int = REPLAY_LIMIT) -> DataFrame:
    """The feed followed by the second delivery of its tail."""
    return feed.unionByName(tail_replay(feed, limit))


def ledger_scan(started: DataFrame, metered: DataFrame, usage: DataFrame) -> DataFrame:
    """The three event tables under their topic names, with one arrival column."""
    parts = [
        rows.select(F.lit(topic).alias("topic"), "*").withColumnRenamed(S.ARRIVAL[topic], "at")
        for topic, rows in ((S.STARTED, started), (S.METERED, metered), (S.USAGE, usage))
    ]
    feed = parts[0]
    for part in parts[1:]:
        feed = feed.unionByName(part, allowMissingColumns=True)
    return feed
