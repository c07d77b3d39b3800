"""Token-bucket and idempotency decisions over live logs, one small record of state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybook.operators.budget import CAPACITY, REFILL_PER_SECOND, _units
from tallybook.operators.claims import CLAIMED, COMPLETED_TTL_MS, IN_FLIGHT, LEASE_MS, REPLAY
from tallybook.streaming.reconcile_stream import ROCKSDB


def budget_stream(
    draws: DataFrame,
    *,
    capacity: int = CAPACITY,
    refill_per_second: float = REFILL_PER_SECOND,
    order: str = "event_id",
) -> DataFrame:
    """Decide a stream of draws (tenant_id, now_ms, tokens, ``order``).

    Draws of one trigger are taken in time order. A draw older than the bucket's clock is decided at
    the bucket's time, so no refill is counted twice.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    unit, full, refill = _units(capacity, refill_per_second)

    class Bucket(StatefulProcessor):
        def init(self, handle):
            self.level = handle.getValueState("level", "level bigint, since bigint")

        def handleInputRows(self, key, rows, timerValues):
            level, since = self.level.get() or (full, None)
            for row in sorted(rows, key=lambda r: (r.now_ms, r.ordinal)):
                granted, left = True, capacity
                if row.tokens > 0:
                    since = row.now_ms if since is None else since
                    level = min(full, level + max(0, row.now_ms - since) * refill)
                    granted = level >= row.tokens * unit
                    level -= row.tokens * unit if granted else 0
                    since, left = max(since, row.now_ms), level // unit
                yield Row(
                    tenant_id=key[0], ordinal=row.ordinal, now_ms=row.now_ms, tokens=row.tokens,
                    granted=granted, remaining=left,
                )
            if since is not None:
                self.level.update((level, since))

        def close(self):
            pass

    draws.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        draws.select("tenant_id", F.col(order).alias("ordinal"), "now_ms", "tokens")
        .groupBy("tenant_id")
        .transformWithState(
            statefulProcessor=Bucket(),
            outputStructType="tenant_id string, ordinal bigint, now_ms bigint, tokens bigint, "
            "granted boolean, remaining bigint",
            outputMode="append",
            timeMode="None",
        )
        .withColumnRenamed("ordinal", order)
    )


def claim_stream(
    log: DataFrame,
    *,
    lease_ms: int = LEASE_MS,
    completed_ttl_ms: int = COMPLETED_TTL_MS,
    order: str | None = None,
    expire: bool = True,
) -> DataFrame:
    """Decide a stream of claim, complete and release events as they happen.

    Events are rows (tenant_id, idempotency_key, request_id, t_ms, event). A completion overwrites
    whoever holds the key, as the last writer does. Events of one millisecond are taken by the
    column ``order``; without it a completion comes first and a release, which ends a claim, last.
    A record lives no longer than it can matter: it goes once nothing was written to it for the lease
    and the completed TTL together, by the wall clock. Spark never ends an ``availableNow`` run that
    watches the wall clock; a log that is read to its end wants ``expire=False``.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    class Key(StatefulProcessor):
        def init(self, handle):
            self.record = handle.getValueState(
                "record",
                "holder string, done boolean, expiry bigint",
                ttlDurationMs=lease_ms + completed_ttl_ms if expire else None,
            )

        def handleInputRows(self, key, rows, timerValues):
            rank = {"complete": 0, "claim": 1, "release": 2}
            held = self.record.get()
            for row in sorted(rows, key=lambda r: (r.t_ms, r.ordinal or 0, rank[r.event])):
                if row.event == "complete":
                    held = (row.request_id, True, row.t_ms + completed_ttl_ms)
                    continue
                if row.event == "release":
                    held = None
                    continue
                outcome = CLAIMED
                if held is not None and row.t_ms < held[2]:
                    outcome = REPLAY if held[1] else IN_FLIGHT
                else:
                    held = (row.request_id, False, row.t_ms + lease_ms)
                yield Row(
                    tenant_id=key[0], idempotency_key=key[1], request_id=row.request_id,
                    t_ms=row.t_ms, outcome=outcome, holder=held[0],
                )
            if held is None:
                self.record.clear()
            else:
                self.record.update(held)

        def close(self):
            pass

    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ordinal = F.col(order) if order else F.lit(None)
    rows = log.select(
        "tenant_id", "idempotency_key", "request_id", "t_ms", "event",
        ordinal.cast("bigint").alias("ordinal"),
    )
    return rows.groupBy("tenant_id", "idempotency_key").transformWithState(
        statefulProcessor=Key(),
        outputStructType="tenant_id string, idempotency_key string, request_id string, t_ms bigint, "
        "outcome string, holder string",
        outputMode="append",
        timeMode="ProcessingTime" if expire else "None",
    )
