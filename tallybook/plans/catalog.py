"""The named queries. Each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallybook import schemas as S
from tallybook.functions import tokens
from tallybook.functions.attribution import terminal_state
from tallybook.operators import audit, budget, claims, ledger, long_text, metering, metrics, reconcile as rec
from tallybook.operators.audit import Scenario
from tallybook.operators.skew import running_sum
from tallybook.plans import fixtures as fx
from tallybook.sources import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

AS_OF = "2024-01-15 12:00:00"
DAY = 86_400
BUDGET = {"capacity": 500, "refill_per_second": 50.0}
STREAM_BUDGET = {"capacity": 500, "refill_per_second": 40.0}
CLAIMS = {"lease_ms": 180_000, "completed_ttl_ms": 240_000}
DRAIN_TENANT = "s1-2"
EXPIRY_CUTOFF = "2024-01-15 06:00:00"
WORDS_AND_SIGNS = "[ ]?[A-Za-z0-9]+|[^A-Za-z0-9]"

# Scenario names and the drift reasons each permits.
SCENARIOS = (
    Scenario("baseline", "s0-0%"),
    Scenario("broker-partition", "s0-1%"),
    Scenario("gateway-sigkill", "s0-2%", (S.UNSETTLED_TIMEOUT,)),
    Scenario("gateway-sigterm-drain", "s0-3%", (S.GATEWAY_CRASH_PARTIAL, S.UNSETTLED_TIMEOUT)),
    Scenario("duplicate-delivery", "s1-0%", (S.RETRY_DOUBLE_COUNT,)),
    Scenario("client-disconnect", "s1-1%", (S.CLIENT_DISCONNECT_PARTIAL,)),
    Scenario("provider-usage-blackhole", "s1-2%", (S.UNSETTLED_TIMEOUT,)),
    Scenario("provider-usage-skew", "s1-3%", (S.TOKENIZER_MISMATCH, S.UNSETTLED_TIMEOUT)),
    Scenario("reconciler-rebalance", "s2-_"),
)


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def moment(text: str):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def feeds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(
        fx.view(spark, folder, name)
        for name in ("requests_started", "requests_metered", "provider_usage")
    )


def settled(spark: SparkSession, folder: str, **options) -> DataFrame:
    return rec.reconcile(*feeds(spark, folder), **options)


def reconciled(spark: SparkSession, folder: str, **options) -> rec.Reconciled:
    return rec.reconciliation(*feeds(spark, folder), **options)


# Sources and the ledger


@query
def scan_events(spark, folder):
    return events.ledger_scan(*feeds(spark, folder)).select(
        "topic", "request_id", "tenant_id", "model", "prompt_tokens", "completion_tokens",
        "terminal_state", "at",
    )


@query
def reconcile(spark, folder):
    return settled(spark, folder)


@query
def attribute(spark, folder):
    _, metered, usage = feeds(spark, folder)
    reused = duplicate_keys(spark, folder).select("request_id")
    return rec.attribute_pairs(metered, usage, tolerance=3, duplicate_key=reused)


@query
def sweep(spark, folder):
    return rec.sweep(*feeds(spark, folder), as_of=moment(AS_OF), tick_seconds=30)


@query
def settle_first_write(spark, folder):
    found = reconciled(spark, folder)
    rows = found.settlements.select(*rec.SETTLEMENT_COLUMNS)
    attempts = rows.unionByName(ledger.late_attempts(found.late_metered))
    stored = rows.where(F.col("settled_at") < moment(AS_OF))
    return ledger.first_writes(attempts, stored).select(
        "request_id", "status", "metered_total", "settled_at", "attempts"
    )


def _open_ledger(spark, folder):
    """The ledger as it stood at AS_OF with a settlement window of a day: some requests pend."""
    found = reconciled(spark, folder, window_seconds=DAY, as_of=moment(AS_OF), late=False)
    return found.started, found.settlements.select(*rec.SETTLEMENT_COLUMNS), found.waiting


@query
def pending(spark, folder):
    return _open_ledger(spark, folder)[2]


@query
def expired_pending(spark, folder):
    return ledger.expired_pending(_open_ledger(spark, folder)[2], moment(EXPIRY_CUTOFF))


@query
def unaccounted(spark, folder):
    found = reconciled(spark, folder, late=False)
    joined = found.settlements.where(F.col("status") != S.FORCE_SETTLED)
    return ledger.unaccounted(found.started, joined)


@query
def drift_events(spark, folder):
    return ledger.drift_events(settled(spark, folder)).select(
        "request_id", "tenant_id", "reason", "drift_tokens",
        F.col("detail")["status"].alias("detail_status"),
    )


@query
def idempotency_index(spark, folder):
    return ledger.idempotency_index(settled(spark, folder, detail=True))


@query
def duplicate_keys(spark, folder):
    return ledger.duplicate_keys(settled(spark, folder, detail=True))


@query
def drift_by_terminal_state(spark, folder):
    return ledger.drift_by_terminal_state(settled(spark, folder, detail=True))


@query
def duplicates_absorbed(spark, folder):
    late = reconciled(spark, folder).late_metered
    return late.groupBy("tenant_id").agg(F.count("*").alias("absorbed"))


@query
def late_usage(spark, folder):
    late = reconciled(spark, folder).late_usage.where("forced")
    return late.select(
        "request_id",
        F.lit(S.FORCE_SETTLED).alias("status"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("provider_total"),
        "reported_at",
        "settled_at",
    )


@query
def half_joined(spark, folder):
    return rec.half_joined(*feeds(spark, folder), as_of=moment(AS_OF), window_seconds=DAY)


@query
def orphan_usage(spark, folder):
    _, metered, usage = feeds(spark, folder)
    return rec.orphan_usage(metered, usage)


@query
def tail_replay(spark, folder):
    feed = fx.view(spark, folder, "feed")
    named = feed.withColumnsRenamed({"part": "partition", "pos": "offset"})
    replayed = events.tail_replay(named, limit=60)
    return replayed.withColumnsRenamed({"partition": "part", "offset": "pos"})


@query
def decode_quarantine(spark, folder):
    wire = fx.view(spark, folder, "wire").withColumn("topic", F.lit(S.METERED))
    return events.decode(wire, S.METERED).select(
        "key",
        "error",
        F.when(F.col("error").isNull(), F.col("prompt_tokens") + F.col("completion_tokens")).alias(
            "total"
        ),
        F.when(F.col("error").isNull(), F.unix_micros("ended_at")).alias("ended_us"),
    )


# Audits


@query
def tenant_scope(spark, folder):
    return audit.tenant_scope(settled(spark, folder), "s1-%").select(
        "request_id", "tenant_id", "status"
    )


@query
def scope_counts(spark, folder):
    _, rows, waiting = _open_ledger(spark, folder)
    return audit.scope_counts(rows, waiting, "s_-1")


def _unlabelled(rows: DataFrame) -> DataFrame:
    """A ledger some writer left without its tokenizer reasons."""
    mismatch = F.col("drift_reason") == S.TOKENIZER_MISMATCH
    return rows.withColumn("drift_reason", F.when(~mismatch, F.col("drift_reason")))


@query
def unattributed_drift(spark, folder):
    return audit.unattributed_drift(_unlabelled(settled(spark, folder)), "s1-%")


@query
def drift_by_reason(spark, folder):
    return audit.drift_by_reason(settled(spark, folder))


def _report(spark, folder):
    started, rows, waiting = _open_ledger(spark, folder)
    return audit.scenario_report(started, _unlabelled(rows), waiting, SCENARIOS)


def _flat(entries):
    return F.array_join(
        F.transform(F.map_entries(entries), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
    )


@query
def scenario_report(spark, folder):
    return _report(spark, folder).withColumns(
        {
            "reasons": _flat(F.col("reasons")),
            "drift_tokens_by_reason": _flat(F.col("drift_tokens_by_reason")),
        }
    )


@query
def scenario_check(spark, folder):
    return audit.scenario_check(_report(spark, folder), SCENARIOS).select(
        "scenario", F.array_join("failures", "; ").alias("failures"), "passed"
    )


@query
def drain_audit(spark, folder):
    _, rows, waiting = _open_ledger(spark, folder)
    return audit.drain_audit(rows, waiting, DRAIN_TENANT)


# Metrics


@query
def settlements_by_status(spark, folder):
    return metrics.settlements_by_status(settled(spark, folder))


@query
def drift_rate(spark, folder):
    return metrics.drift_rate(settled(spark, folder))


@query
def requests_by_state(spark, folder):
    return metrics.requests_by_state(fx.view(spark, folder, "requests_metered"))


@query
def tokens_by_tenant_model(spark, folder):
    return metrics.tokens_by_tenant_model(fx.view(spark, folder, "requests_metered"))


@query
def budget_rejections(spark, folder):
    return metrics.budget_rejections(stream_cuts(spark, folder))


@query
def idempotency_outcomes(spark, folder):
    return metrics.idempotency_outcomes(claim_outcomes(spark, folder))


def _first_tokens(spark, folder):
    return metering.first_tokens(
        fx.stream_lines(spark, folder), fx.view(spark, folder, "streams")
    )


@query
def ttft_buckets(spark, folder):
    return metrics.ttft_buckets(_first_tokens(spark, folder))


@query
def ttft_quantiles(spark, folder):
    return metrics.ttft_quantiles(_first_tokens(spark, folder))


@query
def in_flight(spark, folder):
    return metrics.in_flight(fx.view(spark, folder, "stream_spans"))


@query
def stream_counters(spark, folder):
    return metrics.stream_counters(
        terminal_states(spark, folder), billable_attempt(spark, folder)
    )


# Metering


def terminal_states(spark, folder):
    return fx.view(spark, folder, "stream_outcomes").select(
        "request_id",
        "tenant_id",
        terminal_state(
            F.col("http_status"), F.col("transport_failed"), F.col("draw_refused"),
            F.col("cancelled"), F.col("client_gone"),
        ).alias("terminal_state"),
    )


QUERIES["terminal_state"] = terminal_states


@query
def request_defaults(spark, folder):
    raw = fx.view(spark, folder, "raw_requests")
    names = ("request_id", "idempotency_key", "tenant_id", "model")
    return raw.withColumns(tokens.request_defaults(*[F.col(n) for n in names]))


@query
def token_estimate(spark, folder):
    return fx.table(spark, folder, "documents").select(
        "doc_id", tokens.token_estimate(F.col("text")).alias("tokens")
    )


@query
def prompt_tokens(spark, folder):
    """The prompt of an assistant turn is every earlier turn of its conversation."""
    counted = fx.chat_bodies(spark, folder).select(
        "conv_id", "turn", "role", tokens.prompt_tokens(F.col("body")).alias("_tokens")
    )
    return (
        running_sum(
            counted, ["conv_id"], "turn", {"prompt_tokens": F.col("_tokens")}, include_current=False
        )
        .where("role = 'assistant'")
        .select("conv_id", "turn", "prompt_tokens")
    )


@query
def admission_estimate(spark, folder):
    return fx.chat_bodies(spark, folder).select(
        "conv_id",
        "turn",
        tokens.admission_estimate(
            tokens.prompt_tokens(F.col("body")), F.col("max_tokens")
        ).alias("estimate"),
    )


@query
def meter_streams(spark, folder):
    return metering.meter_streams(fx.stream_lines(spark, folder))


def _words_and_signs():
    """A small exact tokenizer that SQL can express: words with the blank before them, and single other signs."""
    pattern = re.compile(WORDS_AND_SIGNS)
    return lambda text: len(pattern.findall(text))


@query
def exact_counts(spark, folder):
    lines = fx.stream_lines(spark, folder)
    found = metering.meter_streams(lines, tokenizer=_words_and_signs(), cuts=long_text.WORD_THEN_BLANK)
    return found.select("request_id", "completion_tokens", "exact")


@query
def running_tokens(spark, folder):
    return (
        metering.running_tokens(fx.stream_lines(spark, folder))
        .where("chars > 0")
        .select("request_id", "seq", "running_tokens")
    )


@query
def midstream_draws(spark, folder):
    return metering.midstream_draws(
        fx.stream_lines(spark, folder), fx.view(spark, folder, "streams")
    )


@query
def stream_cuts(spark, folder):
    """Admissions and mid-stream draws of one bucket per tenant."""
    admissions = metering.admission_draws(fx.view(spark, folder, "streams"))
    draws = admissions.unionByName(midstream_draws(spark, folder))
    return budget.cut_streams(draws, **STREAM_BUDGET)


@query
def billable_attempt(spark, folder):
    return metering.billable_attempt(fx.view(spark, folder, "attempts"))


# Decisions


@query
def budget_decisions(spark, folder):
    return budget.budget_decisions(fx.view(spark, folder, "budget_draws"), **BUDGET)


@query
def claim_outcomes(spark, folder):
    return claims.claim_outcomes(fx.view(spark, folder, "claim_log"), **CLAIMS)
