"""The settlement table: first write wins, everything else is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallybook import schemas as S
from tallybook.operators.reconcile import after
from tallybook.operators.skew import salted_join


def first_writes(attempts: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The rows a set of settlement attempts would create, with how many attempts each took.

    The earliest attempt of a request wins; of one instant, one that is no repeat. Attempts for requests already ``stored`` create nothing.
    Repeats are combined before the shuffle, so a request settled a million times costs no more
    than one settled once.
    """
    others = [c for c in attempts.columns if c not in ("request_id", "settled_at")]
    repeat = F.coalesce(F.col("drift_reason") == S.RETRY_DOUBLE_COUNT, F.lit(False))
    winners = attempts.groupBy("request_id").agg(
        F.min(F.struct("settled_at", repeat.alias("_repeat"), *others)).alias("_row"),
        F.count("*").alias("attempts"),
    )
    rows = winners.select(
        "request_id", *[f"_row.{c}" for c in attempts.columns if c != "request_id"], "attempts"
    )
    if stored is not None:
        rows = rows.join(stored.select("request_id"), "request_id", "left_anti")
    return rows


def late_attempts(late_metered: DataFrame) -> DataFrame:
    """Metered copies that are known to have come after settlement, as the attempts they amount to."""
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return late_metered.select(
        "request_id",
        "tenant_id",
        "model",
        F.lit(S.SETTLED_WITH_DRIFT).alias("status"),
        total.alias("metered_total"),
        F.lit(None).cast("bigint").alias("provider_total"),
        total.alias("drift_tokens"),
        F.lit(S.RETRY_DOUBLE_COUNT).alias("drift_reason"),
        F.col("ended_at").alias("settled_at"),
    )


def duplicate_attempts(metered: DataFrame, settlements: DataFrame) -> DataFrame:
    """The same from all metered copies and the settlements of another run."""
    settled = settlements.select("request_id", F.col("status").alias("_status"), "settled_at")
    late = salted_join(metered, settled, ["request_id"]).where(
        after(F.col("ended_at"), F.col("settled_at"), F.col("_status"))
    )
    return late_attempts(late)


def first_starts(started: DataFrame) -> DataFrame:
    """One row per started request, the earliest start."""
    return (
        started.groupBy("request_id")
        .agg(F.min(F.struct("started_at", "tenant_id")).alias("_first"))
        .select("request_id", "_first.tenant_id", "_first.started_at")
    )


def pending(started: DataFrame, settlements: DataFrame) -> DataFrame:
    """Started and not settled. Derived, so a late start never brings a settled request back."""
    return first_starts(started).join(settlements.select("request_id"), "request_id", "left_anti")


def unaccounted(started: DataFrame, settlements: DataFrame) -> DataFrame:
    """The started requests no settlement accounts for, by name."""
    return pending(started, settlements).select("request_id", "tenant_id")


def expired_pending(
    pending_rows: DataFrame, older_than: Column, limit: int | None = None
) -> DataFrame:
    """The pending requests started at or before ``older_than``, with ``limit`` the oldest of them."""
    rows = pending_rows.where(F.col("started_at") <= older_than)
    return rows if limit is None else rows.orderBy("started_at", "request_id").limit(limit)


def drift_events(settlements: DataFrame, *, include_swept: bool = False) -> DataFrame:
    """One event per settlement that carries a reason. Swept settlements raise none by default."""
    statuses = [S.SETTLED_WITH_DRIFT] + ([S.FORCE_SETTLED] if include_swept else [])
    return settlements.where(
        F.col("status").isin(statuses) & F.col("drift_reason").isNotNull()
    ).select(
        "request_id",
        "tenant_id",
        F.col("drift_reason").alias("reason"),
        "drift_tokens",
        F.create_map(F.lit("status"), F.col("status")).alias("detail"),
    )


def idempotency_index(keyed: DataFrame) -> DataFrame:
    """The first settled request of each (tenant, key)."""
    return (
        keyed.groupBy("tenant_id", "idempotency_key")
        .agg(F.min(F.struct("settled_at", "request_id")).alias("_first"), F.count("*").alias("uses"))
        .select("tenant_id", "idempotency_key", F.col("_first.request_id").alias("request_id"), "uses")
    )


def duplicate_keys(keyed: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Requests that reuse the (tenant, key) of an earlier settled request.

    ``heavy`` may give the heavy keys from a cheaper table than ``keyed``, such as the starts.
    """
    keys = ["tenant_id", "idempotency_key"]
    rows = keyed.select(*keys, "request_id", "settled_at")
    reused = (
        idempotency_index(rows)
        .where("uses > 1")
        .select(*keys, F.col("request_id").alias("original_request_id"))
    )
    return (
        salted_join(rows, reused, keys, heavy=heavy)
        .where("request_id <> original_request_id")
        .select(*keys, "request_id", "original_request_id")
    )


def billing_facts(settlements: DataFrame, metered: DataFrame) -> DataFrame:
    """Settlements with the terminal state and key of the metered copy they were settled on."""
    times = settlements.select("request_id", "settled_at", "status")
    total = (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total")
    facts = (
        salted_join(metered, times, ["request_id"])
        .where(~after(F.col("ended_at"), F.col("settled_at"), F.col("status")))
        .groupBy("request_id")
        .agg(
            F.max(
                F.struct(
                    "ended_at",
                    total,
                    "prompt_tokens",
                    "completion_tokens",
                    "terminal_state",
                    "model",
                    "tenant_id",
                    "idempotency_key",
                )
            ).alias("_copy")
        )
        .select("request_id", "_copy.terminal_state", "_copy.idempotency_key")
    )
    return settlements.join(facts, "request_id", "left")


def drift_by_terminal_state(settlements: DataFrame, metered: DataFrame | None = None) -> DataFrame:
    """Drift by how the stream ended; settlements that do not know it take it from ``metered``."""
    facts = settlements if metered is None else billing_facts(settlements, metered)
    return (
        facts.where(F.col("drift_reason").isNotNull())
        .groupBy("terminal_state", "drift_reason")
        .agg(F.count("*").alias("requests"), F.sum(F.abs("drift_tokens")).alias("drift_tokens"))
    )
