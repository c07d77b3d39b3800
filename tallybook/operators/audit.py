"""Audits of the ledger: scopes, drift totals, scenario reports and their verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallybook import schemas as S
from tallybook.operators.ledger import first_starts

# The wording of each failure.
NOTHING_STARTED = "no requests were recorded — the load generator did not run"
UNACCOUNTED = "unaccounted requests: %d started, %d settled (%d missing)"
STILL_PENDING = (
    "%d requests still pending past the settlement window — the sweeper did not force-settle them"
)
NO_REASON = "%d drift tokens carry no reason code"
BILLED_TWICE = "%d requests were billed twice (retry_double_count)"
UNEXPECTED = "unexpected drift reasons: %s (expected %s)"

DRAIN_MINIMUM = 55


@dataclass(frozen=True)
class Scenario:
    """A slice of the ledger, by tenant LIKE pattern, and what may go wrong in it."""

    name: str
    tenant_pattern: str
    expected_reasons: tuple[str, ...] = ()
    allow_double_counts: bool = False


def in_scope(tenant: Column, pattern: str) -> Column:
    """LIKE, as a plain prefix test where the pattern allows it, so that it is pushed down."""
    prefix = pattern[:-1]
    if pattern.endswith("%") and not set("%_\\") & set(prefix):
        return tenant.startswith(prefix)
    return tenant.like(pattern)


def tenant_scope(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.where(in_scope(F.col("tenant_id"), pattern))


def scope_counts(settlements: DataFrame, pending: DataFrame, pattern: str) -> DataFrame:
    """Settled and pending requests of a tenant scope, in one row."""
    rows = settlements.select("tenant_id", F.lit(1).alias("settled"), F.lit(0).alias("pending"))
    rows = rows.unionByName(
        pending.select("tenant_id", F.lit(0).alias("settled"), F.lit(1).alias("pending"))
    )
    return tenant_scope(rows, pattern).agg(
        F.coalesce(F.sum("settled"), F.lit(0)).alias("settled"),
        F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"),
    )


def unattributed_drift(settlements: DataFrame, pattern: str = "%") -> DataFrame:
    """Drift tokens without a reason."""
    return (
        tenant_scope(settlements, pattern)
        .where(F.col("drift_reason").isNull() & (F.col("drift_tokens") != 0))
        .agg(F.coalesce(F.sum(F.abs("drift_tokens")), F.lit(0)).alias("drift_tokens"))
    )


def drift_by_reason(settlements: DataFrame, pattern: str = "%") -> DataFrame:
    return (
        tenant_scope(settlements, pattern)
        .where(F.col("drift_reason").isNotNull())
        .groupBy("drift_reason")
        .agg(
            F.count("*").alias("requests"),
            F.coalesce(F.sum(F.abs("drift_tokens")), F.lit(0)).alias("drift_tokens"),
        )
    )


def scenario_report(
    started: DataFrame,
    settlements: DataFrame,
    pending: DataFrame,
    scenarios: Sequence[Scenario],
) -> DataFrame:
    """What became of each scenario's requests, all scenarios in one pass.

    A request that was started twice counts once. Rows are first counted per tenant and reason; only those counts are matched to scenarios.
    A scenario nothing belongs to is reported too, with zeros.
    """
    none = F.lit(None).cast("string")
    rows = settlements.select(
        "tenant_id", F.lit("settled").alias("kind"), "status", "drift_reason", "drift_tokens"
    )
    for kind, part in (("started", first_starts(started)), ("pending", pending)):
        rows = rows.unionByName(
            part.select(
                "tenant_id",
                F.lit(kind).alias("kind"),
                none.alias("status"),
                none.alias("drift_reason"),
                F.lit(0).cast("bigint").alias("drift_tokens"),
            )
        )
    counted = rows.groupBy("tenant_id", "kind", "drift_reason").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == S.FORCE_SETTLED).alias("forced"),
        F.sum(F.abs("drift_tokens")).alias("tokens"),
    )
    names = F.array_compact(
        F.array(*[F.when(in_scope(F.col("tenant_id"), s.tenant_pattern), s.name) for s in scenarios])
    )
    listed = (
        settlements.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(s.name) for s in scenarios])).alias("scenario"))
    )
    per_reason = (
        counted.withColumn("scenario", F.explode(names))
        .groupBy("scenario", "kind", "drift_reason")
        .agg(*[F.sum(c).alias(c) for c in ("n", "forced", "tokens")])
    )
    is_settled = F.col("kind") == "settled"
    named = is_settled & F.col("drift_reason").isNotNull()

    def total(value: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0))

    def by_reason(value: str) -> Column:
        entry = F.when(named, F.struct("drift_reason", value))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    report = listed.join(per_reason, "scenario", "left").groupBy("scenario").agg(
        total("n", F.col("kind") == "started").alias("started"),
        total("n", is_settled).alias("settled"),
        total("n", F.col("kind") == "pending").alias("still_pending"),
        total("tokens", is_settled & F.col("drift_reason").isNull()).alias(
            "unattributed_drift_tokens"
        ),
        total("n", F.col("drift_reason") == S.RETRY_DOUBLE_COUNT).alias("double_counts"),
        total("forced", is_settled).alias("force_settled"),
        by_reason("n").alias("reasons"),
        by_reason("tokens").alias("drift_tokens_by_reason"),
    )
    return report.withColumn(
        "accounted_pct",
        F.when(
            F.col("started") > 0, F.lit(100.0) * F.col("settled") / F.col("started")
        ).otherwise(F.lit(0.0)),
    )


def _names(values: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))


def scenario_check(report: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Adds ``failures`` and ``passed`` to a report. No expected reason means none is allowed."""
    expected, doubles = F.array().cast("array<string>"), F.lit(False)
    for s in scenarios:
        here = F.col("scenario") == s.name
        reasons = F.array(*[F.lit(r) for r in sorted(s.expected_reasons)]).cast("array<string>")
        expected = F.when(here, reasons).otherwise(expected)
        doubles = F.when(here, F.lit(s.allow_double_counts)).otherwise(doubles)
    surprise = F.array_except(F.array_sort(F.map_keys("reasons")), F.col("_expected"))
    allowed = F.when(F.size("_expected") > 0, _names(F.col("_expected"))).otherwise("none")
    missing = F.col("started") - F.col("settled")
    found = F.array_compact(
        F.array(
            F.when(missing != 0, F.format_string(UNACCOUNTED, "started", "settled", missing)),
            F.when(F.col("still_pending") > 0, F.format_string(STILL_PENDING, "still_pending")),
            F.when(
                F.col("unattributed_drift_tokens") > 0,
                F.format_string(NO_REASON, "unattributed_drift_tokens"),
            ),
            F.when(
                (F.col("double_counts") > 0) & ~F.col("_doubles"),
                F.format_string(BILLED_TWICE, "double_counts"),
            ),
            F.when(F.size(surprise) > 0, F.format_string(UNEXPECTED, _names(surprise), allowed)),
        )
    )
    return (
        report.withColumn("_expected", expected)
        .withColumn("_doubles", doubles)
        .withColumn(
            "failures",
            F.when(F.col("started") == 0, F.array(F.lit(NOTHING_STARTED))).otherwise(found),
        )
        .withColumn("passed", F.size("failures") == 0)
        .drop("_expected", "_doubles")
    )


def drain_audit(
    settlements: DataFrame, pending: DataFrame, tenant: str, minimum: int = DRAIN_MINIMUM
) -> DataFrame:
    """Whether a drained tenant lost nothing: none pending, none doubled, enough settled."""
    mine = F.col("tenant_id") == tenant
    rows = settlements.where(mine).select(
        F.lit(1).alias("settled"),
        F.lit(0).alias("pending"),
        (F.coalesce(F.col("drift_reason") == S.RETRY_DOUBLE_COUNT, F.lit(False)))
        .cast("int")
        .alias("double_counts"),
    )
    rows = rows.unionByName(
        pending.where(mine).select(
            F.lit(0).alias("settled"), F.lit(1).alias("pending"), F.lit(0).alias("double_counts")
        )
    )
    names = ("settled", "pending", "double_counts")
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).withColumn(
        "passed",
        (F.col("pending") == 0) & (F.col("double_counts") == 0) & (F.col("settled") >= minimum),
    )
