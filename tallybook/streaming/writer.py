"""Write a stream's outcomes so that replaying a batch changes nothing."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tallybook import schemas as S
from tallybook.operators.ledger import drift_events, first_writes, pending
from tallybook.streaming.reconcile_stream import (
    ABSORBED,
    LATE_USAGE,
    ORPHAN,
    OUTCOME_SCHEMA,
    QUARANTINE,
    STARTED,
    settlements_of,
)

TRIGGER = "2 seconds"
LOOKBACK_DAYS = 2


def stored(spark: SparkSession, folder: str, schema=S.SETTLEMENT_SCHEMA) -> DataFrame:
    """A table kept as one folder per day and batch; empty before the first one."""
    kept = T.StructType([*schema.fields, T.StructField("day", T.DateType())])
    kept = kept.add("batch_id", T.LongType())
    try:
        return spark.read.schema(kept).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kept)


def keep(rows: DataFrame, batch_id: int, folder: str, at: str) -> bool:
    """Put a batch's rows under their day and the batch, in place of what it wrote before.

    Writes nothing for no rows; tells whether there were any.
    """
    if rows.isEmpty():
        return False
    days = rows.withColumns({"day": F.to_date(at), "batch_id": F.lit(batch_id).cast("bigint")})
    (
        days.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "batch_id")
        .parquet(folder)
    )
    return True


def settle_batch(
    rows: DataFrame, batch_id: int, folder: str, *, lookback_days: int = LOOKBACK_DAYS
) -> DataFrame:
    """Append the settlements of one batch that the table does not hold yet; returns them as stored.

    The batch's own folders are replaced, so a replay after a crash leaves the same rows. A repeat
    only comes back within replay range, so ids are looked up in the folders from ``lookback_days``
    before the batch's first day to its last; other days are never listed.
    """
    spark = rows.sparkSession
    first, last = rows.agg(F.min(F.to_date("settled_at")), F.max(F.to_date("settled_at"))).first()
    held = stored(spark, folder)
    if first is None:
        return held.limit(0).select(*S.SETTLEMENT_SCHEMA.names)
    near = F.col("day").between(first - timedelta(days=lookback_days), last)
    ids = held.where(near & (F.col("batch_id") != batch_id)).select("request_id")
    if not keep(first_writes(rows, ids).drop("attempts"), batch_id, folder, "settled_at"):
        return held.limit(0).select(*S.SETTLEMENT_SCHEMA.names)
    mine = stored(spark, folder).where(
        F.col("day").between(first, last) & (F.col("batch_id") == batch_id)
    )
    return mine.select(*S.SETTLEMENT_SCHEMA.names)


def compact(spark: SparkSession, folder: str, day: str, schema=S.SETTLEMENT_SCHEMA) -> None:
    """Rewrite the batches of a day that no replay can reach any more as one batch, -1."""
    rows = stored(spark, folder, schema).where(F.col("day") == day)
    staged = f"{folder}-compacting/day={day}"
    rows.drop("day", "batch_id").write.mode("overwrite").parquet(staged)
    whole = spark.read.schema(schema).parquet(staged)
    whole = whole.withColumn("batch_id", F.lit(-1).cast("bigint"))
    whole.write.mode("overwrite").partitionBy("batch_id").parquet(f"{folder}/day={day}")


def pending_now(spark: SparkSession, folder: str) -> DataFrame:
    """The requests of a kept ledger that were started and have not settled."""
    starts = stored(spark, f"{folder}/started", OUTCOME_SCHEMA)
    starts = starts.select("request_id", "tenant_id", F.col("at").alias("started_at"))
    return pending(starts, stored(spark, f"{folder}/settlements"))


def write_ledger(
    outcomes: DataFrame,
    folder: str,
    checkpoint: str,
    *,
    tolerance: int = 0,
    lookback_days: int = LOOKBACK_DAYS,
    on_drift=None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep a ledger under ``folder`` from a stream of outcomes.

    Its tables are ``settlements``, ``drift``, ``started`` (``pending_now`` takes the settled ones
    out), ``leftovers`` (absorbed, late and orphaned rows) and ``quarantine``. Offsets are committed
    after the writes. ``on_drift(events, batch_id)`` may send the drift events elsewhere; it can be
    called again for a batch that is replayed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            new = settle_batch(
                settlements_of(batch, tolerance=tolerance),
                batch_id,
                f"{folder}/settlements",
                lookback_days=lookback_days,
            )
            days = new.select("request_id", F.col("settled_at").alias("at"))
            drift = drift_events(new)
            keep(drift.join(days, "request_id"), batch_id, f"{folder}/drift", "at")
            left = batch.drop("topic", "value", "error")
            kind = F.col("kind")
            keep(left.where(kind == STARTED), batch_id, f"{folder}/started", "at")
            others = left.where(kind.isin(ABSORBED, LATE_USAGE, ORPHAN))
            keep(others, batch_id, f"{folder}/leftovers", "at")
            if "error" in batch.columns:
                broken = batch.where(kind == QUARANTINE).select("topic", "value", "error")
                if not broken.isEmpty():
                    target = f"{folder}/quarantine/batch_id={batch_id}"
                    broken.write.mode("overwrite").parquet(target)
            if on_drift is not None:
                on_drift(drift, batch_id)
        finally:
            batch.unpersist()

    return (
        outcomes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": TRIGGER}))
        .start()
    )
