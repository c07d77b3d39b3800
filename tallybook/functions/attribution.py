"""Why two ledgers disagree, as column expressions shared by batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallybook import schemas as S


def attribution(
    metered_total: Column,
    provider_total: Column,
    terminal_state: Column,
    *,
    tolerance: int = 0,
    duplicate_key: Column | None = None,
) -> dict[str, Column]:
    """status, drift_tokens and drift_reason for one request.

    A reused key outranks every other explanation and charges the whole metered total;
    then a missing report; then agreement within ``tolerance``; then the sign of the gap.
    """
    duplicate = F.coalesce(duplicate_key, F.lit(False)) if duplicate_key is not None else F.lit(False)
    delta = provider_total - metered_total
    no_report = provider_total.isNull()
    agrees = F.abs(delta) <= F.lit(tolerance)

    cut_short = F.lit(S.TOKENIZER_MISMATCH)
    for state, reason in S.PARTIAL_STATES.items():
        cut_short = F.when(terminal_state == state, reason).otherwise(cut_short)

    return {
        "status": F.when(duplicate, S.SETTLED_WITH_DRIFT)
        .when(no_report, S.FORCE_SETTLED)
        .when(agrees, S.SETTLED)
        .otherwise(S.SETTLED_WITH_DRIFT),
        "drift_tokens": F.when(duplicate, metered_total)
        .when(no_report | agrees, F.lit(0).cast("bigint"))
        .otherwise(delta),
        "drift_reason": F.when(duplicate, S.RETRY_DOUBLE_COUNT)
        .when(no_report, S.UNSETTLED_TIMEOUT)
        .when(agrees, F.lit(None).cast("string"))
        .when(delta > 0, cut_short)
        .otherwise(S.PROVIDER_UNDERREPORT),
    }


def terminal_state(
    http_status: Column,
    transport_failed: Column,
    draw_refused: Column,
    cancelled: Column,
    client_gone: Column,
) -> Column:
    """How a stream ended. A cut without an error still counts as completed."""
    return (
        F.when((http_status >= 400) | transport_failed, S.PROVIDER_ERROR)
        .when(draw_refused, S.BUDGET_EXCEEDED)
        .when(cancelled, S.GATEWAY_SHUTDOWN)
        .when(client_gone, S.CLIENT_DISCONNECT)
        .otherwise(S.COMPLETED)
    )
