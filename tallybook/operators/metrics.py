"""Counters, rates and quantiles derived from the event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook import schemas as S

# Upper bounds of the time-to-first-token histogram, in seconds.
TTFT_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)
QUANTILES = (0.50, 0.95, 0.99)


def per_minute(
    rows: DataFrame, at: str, by: Sequence[str], extra: dict[str, Column] | None = None
) -> DataFrame:
    """Rows per tumbling minute and group, with the mean rate per second over that minute."""
    sums = [column.alias(name) for name, column in (extra or {}).items()]
    return (
        rows.groupBy(F.window(at, "1 minute").alias("_w"), *by)
        .agg(F.count("*").alias("n"), *sums)
        .select(F.col("_w.start").alias("minute"), *by, "n", (F.col("n") / 60.0).alias("per_second"), *(extra or {}))
    )


def settlements_by_status(settlements: DataFrame, *, include_swept: bool = True) -> DataFrame:
    rows = settlements if include_swept else settlements.where(F.col("status") != S.FORCE_SETTLED)
    return per_minute(rows, "settled_at", ["status"])


def drift_rate(settlements: DataFrame, *, include_swept: bool = False) -> DataFrame:
    """Drift events and the tokens they carry, per minute and reason."""
    rows = settlements.where(F.col("drift_reason").isNotNull())
    if not include_swept:
        rows = rows.where(F.col("status") != S.FORCE_SETTLED)
    return per_minute(
        rows, "settled_at", ["drift_reason"], {"drift_tokens": F.sum(F.abs("drift_tokens"))}
    )


def first_records(metered: DataFrame) -> DataFrame:
    """One metered record per request, the first: redelivery counts nothing twice."""
    total = (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total")
    return (
        metered.groupBy("request_id")
        .agg(F.min(F.struct("ended_at", total, "tenant_id", "model", "terminal_state")).alias("r"))
        .select("request_id", "r.*")
    )


def requests_by_state(metered: DataFrame) -> DataFrame:
    return (
        first_records(metered)
        .groupBy("tenant_id", "terminal_state")
        .agg(F.count("*").alias("requests"))
    )


def tokens_by_tenant_model(metered: DataFrame) -> DataFrame:
    return (
        first_records(metered).groupBy("tenant_id", "model").agg(F.sum("total").alias("tokens"))
    )


def budget_rejections(decisions: DataFrame) -> DataFrame:
    """Refused draws by tenant and stage; an admission has a ``seq`` below 0."""
    stage = F.when(F.col("seq") < 0, "admission").otherwise("mid_stream")
    return (
        decisions.where(~F.col("granted"))
        .groupBy("tenant_id", stage.alias("stage"))
        .agg(F.count("*").alias("rejected"))
    )


def idempotency_outcomes(claims: DataFrame) -> DataFrame:
    return claims.groupBy("outcome").agg(F.count("*").alias("claims"))


def bucket_counts(
    seconds: Column, bounds: Sequence[float] = TTFT_BOUNDS
) -> Column:
    """Cumulative histogram counts, the last one over everything, as an array aggregate."""
    return F.array(*[F.count_if(seconds <= b) for b in bounds], F.count(seconds))


def ttft_buckets(
    first_tokens: DataFrame, seconds: str = "ttft_seconds", bounds: Sequence[float] = TTFT_BOUNDS
) -> DataFrame:
    labels = F.array(*[F.lit(f"{b:g}") for b in bounds], F.lit("+Inf"))
    return (
        first_tokens.agg(bucket_counts(F.col(seconds), bounds).alias("n"))
        .select(F.explode(F.arrays_zip(labels.alias("le"), F.col("n").alias("n"))).alias("b"))
        .select("b.le", F.col("b.n").alias("requests"))
    )


def quantile_from_buckets(
    counts: Column, q: float, bounds: Sequence[float] = TTFT_BOUNDS
) -> Column:
    """Linear interpolation inside the bucket the rank falls into.

    Beyond the last bound the answer is that bound. NULL when nothing was observed.
    """
    rank = F.lit(q) * F.element_at(counts, -1)
    answer = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = F.lit(float(bounds[i - 1]) if i else 0.0)
        under = F.get(counts, F.lit(i - 1)) if i else F.lit(0)
        here = F.get(counts, F.lit(i))
        inside = (rank - under) / F.nullif(here - under, F.lit(0))
        value = low + (F.lit(float(bounds[i])) - low) * F.coalesce(inside, F.lit(1.0))
        answer = F.when(here >= rank, value).otherwise(answer)
    return F.when(F.element_at(counts, -1) > 0, answer)


def ttft_quantiles(
    first_tokens: DataFrame,
    seconds: str = "ttft_seconds",
    bounds: Sequence[float] = TTFT_BOUNDS,
    quantiles: Sequence[float] = QUANTILES,
) -> DataFrame:
    """Quantiles as the dashboard shows them, from the counts of the buckets."""
    found = first_tokens.agg(bucket_counts(F.col(seconds), bounds).alias("n"))
    entries = F.array(
        *[
            F.struct(
                F.lit(f"p{round(q * 100)}").alias("quantile"),
                quantile_from_buckets(F.col("n"), q, bounds).alias("estimate"),
            )
            for q in quantiles
        ]
    )
    return found.select(F.inline(entries))


def in_flight(streams: DataFrame, opened: str = "opened_ms", closed: str = "closed_ms") -> DataFrame:
    """Streams opened, closed and open at the end of each minute that saw a change.

    Opens and closes are counted per minute first, so the running sum reads one row per minute of
    the log whatever the traffic was. A NULL close is a stream still open.
    """
    def minute(column: str) -> Column:
        return F.floor(F.col(column) / 60_000).alias("minute")

    changes = streams.select(minute(opened), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        streams.where(F.col(closed).isNotNull()).select(
            minute(closed), F.lit(0).alias("up"), F.lit(1).alias("down")
        )
    )
    so_far = Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        changes.groupBy("minute")
        .agg(F.sum("up").alias("opened"), F.sum("down").alias("closed"))
        .withColumn("open", F.sum(F.col("opened") - F.col("closed")).over(so_far))
    )


def stream_counters(outcomes: DataFrame, attempts: DataFrame) -> DataFrame:
    """Streams drained after their client left, and upstream retries, by tenant."""
    drained = outcomes.where(F.col("terminal_state") == S.CLIENT_DISCONNECT).select(
        "tenant_id", F.lit("orphaned_drains").alias("counter")
    )
    retried = attempts.where("retried").select("tenant_id", F.lit("provider_retries").alias("counter"))
    return (
        drained.unionByName(retried).groupBy("tenant_id", "counter").agg(F.count("*").alias("n"))
    )
