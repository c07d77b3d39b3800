"""First writes, keys, drift events, scopes and scenario verdicts."""

import pytest
from helpers import at, by_request, metered, settlements, started
from pyspark.sql import functions as F

from tallybook.operators import audit, ledger
from tallybook.operators.audit import Scenario


def test_first_write_wins_and_repeats_are_counted(spark):
    rows = settlements(spark, ("r", "t", "settled", 0, None), ("q", "t", "settled", 0, None))
    later = rows.withColumn("settled_at", F.lit(at(9))).withColumn("status", F.lit("force_settled"))
    found = by_request(ledger.first_writes(later.unionByName(rows).unionByName(later)))
    assert {k: (r.status, r.attempts) for k, r in found.items()} == {
        "r": ("settled", 3),
        "q": ("settled", 3),
    }
    assert list(by_request(ledger.first_writes(rows, rows.where("request_id = 'r'")))) == ["q"]


def test_pending_keeps_the_first_start_and_drops_settled(spark):
    s = started(spark, ("r", 5), ("r", 1), ("q", 2))
    done = settlements(spark, ("q", "acme", "settled", 0, None))
    rows = by_request(ledger.pending(s, done))
    assert list(rows) == ["r"] and rows["r"].started_at == at(1)
    assert list(by_request(ledger.unaccounted(s, done))) == ["r"]


def test_expired_pending_is_oldest_first_and_inclusive(spark):
    rows = started(spark, ("a", 3), ("b", 1), ("c", 2), ("d", 9)).select(
        "request_id", "tenant_id", "started_at"
    )
    found = ledger.expired_pending(rows, F.lit(at(3)), limit=2).collect()
    assert [r.request_id for r in found] == ["b", "c"]
    assert ledger.expired_pending(rows, F.lit(at(3))).count() == 3


def test_drift_events_leave_out_swept_unless_asked(spark):
    rows = settlements(
        spark,
        ("a", "t", "settled", 0, None),
        ("b", "t", "settled_with_drift", 4, "tokenizer_mismatch"),
        ("c", "t", "force_settled", 0, "unsettled_timeout"),
    )
    found = by_request(ledger.drift_events(rows))
    assert list(found) == ["b"] and found["b"].detail == {"status": "settled_with_drift"}
    assert ledger.drift_events(rows, include_swept=True).count() == 2


def test_keys_are_scoped_by_tenant(spark):
    rows = spark.createDataFrame(
        [("r1", "t", "k", at(2)), ("r2", "t", "k", at(1)), ("r3", "u", "k", at(0))],
        "request_id string, tenant_id string, idempotency_key string, settled_at timestamp",
    )
    index = {(r.tenant_id, r.request_id) for r in ledger.idempotency_index(rows).collect()}
    assert index == {("t", "r2"), ("u", "r3")}
    reuse = ledger.duplicate_keys(rows).collect()
    assert [(r.request_id, r.original_request_id) for r in reuse] == [("r1", "r2")]


def test_billing_facts_come_from_the_copy_settled_on(spark):
    rows = settlements(spark, ("r", "t", "settled", 0, None), ("q", "t", "settled", 0, None))
    rows = rows.withColumn("settled_at", F.lit(at(6)))
    copies = metered(spark, ("r", 5, 1, "completed"), ("r", 9, 1, "gateway_shutdown"))
    found = by_request(ledger.billing_facts(rows, copies))
    assert found["r"].terminal_state == "completed" and found["q"].terminal_state is None


@pytest.mark.parametrize(
    ("pattern", "names"),
    [("s1-%", {"a", "b"}), ("s1_a", {"a"}), ("s1-a", {"a"}), ("%", {"a", "b", "c"}), ("s2%", {"c"})],
)
def test_scope_is_like(spark, pattern, names):
    rows = settlements(
        spark,
        ("a", "s1-a", "settled", 0, None),
        ("b", "s1-b", "settled", 0, None),
        ("c", "s2-a", "settled", 0, None),
    )
    assert set(by_request(audit.tenant_scope(rows, pattern))) == names


def test_literal_prefix_is_pushed_down(spark, folder, tmp_path):
    rows = settlements(spark, ("a", "s1-a", "settled", 0, None))
    rows.write.parquet(str(tmp_path / "t"))
    plan = audit.tenant_scope(spark.read.parquet(str(tmp_path / "t")), "s1-%")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(tenant_id,s1-)" in text


def report(spark, scenario, **values):
    base = dict(
        scenario=scenario.name, started=100, settled=100, still_pending=0,
        unattributed_drift_tokens=0, double_counts=0, reasons={},
    )
    base.update(values)
    frame = spark.createDataFrame(
        [tuple(base.values())],
        "scenario string, started bigint, settled bigint, still_pending bigint, "
        "unattributed_drift_tokens bigint, double_counts bigint, reasons map<string,bigint>",
    )
    return audit.scenario_check(frame, [scenario]).first()


STRICT = Scenario("x", "x-%")
CUTS = Scenario("x", "x-%", ("budget_truncated", "gateway_crash_partial"))
TWICE = Scenario("x", "x-%", ("retry_double_count",), allow_double_counts=True)


@pytest.mark.parametrize(
    ("scenario", "values", "failure"),
    [
        (CUTS, {"reasons": {"gateway_crash_partial": 1}}, None),
        (CUTS, {"reasons": {"budget_truncated": 8, "gateway_crash_partial": 30}}, None),
        (
            CUTS,
            {"reasons": {"budget_truncated": 8, "tokenizer_mismatch": 1}},
            "['tokenizer_mismatch'] (expected ['budget_truncated', 'gateway_crash_partial'])",
        ),
        (STRICT, {"reasons": {"budget_truncated": 6}}, "['budget_truncated'] (expected none)"),
        (STRICT, {"started": 41, "settled": 28}, "unaccounted requests: 41 started, 28 settled (13 missing)"),
        (STRICT, {"started": 5, "settled": 6}, "unaccounted requests: 5 started, 6 settled (-1 missing)"),
        (STRICT, {"still_pending": 1}, "1 requests still pending"),
        (STRICT, {"unattributed_drift_tokens": 7}, "7 drift tokens carry no reason code"),
        (CUTS, {"double_counts": 11}, "11 requests were billed twice"),
        (TWICE, {"double_counts": 11, "reasons": {"retry_double_count": 11}}, None),
        (STRICT, {"started": 0, "settled": 0, "still_pending": 4}, "load generator did not run"),
        (STRICT, {"started": 650, "settled": 650}, None),
    ],
)
def test_verdicts(spark, scenario, values, failure):
    row = report(spark, scenario, **values)
    if failure is None:
        assert row.passed and row.failures == []
    else:
        assert not row.passed and any(failure in f for f in row.failures)


def test_nothing_started_stops_there(spark):
    assert len(report(spark, STRICT, started=0, settled=5).failures) == 1


def test_report_covers_overlapping_and_empty_scenarios(spark):
    s = started(spark, ("a", 0), ("b", 0))
    rows = settlements(spark, ("a", "acme", "force_settled", 0, "unsettled_timeout"))
    waiting = ledger.pending(s, rows)
    scenarios = [Scenario("one", "ac%"), Scenario("all", "%"), Scenario("none", "zz%")]
    found = {r.scenario: r for r in audit.scenario_report(s, rows, waiting, scenarios).collect()}
    for name in ("one", "all"):
        r = found[name]
        assert (r.started, r.settled, r.still_pending, r.force_settled) == (2, 1, 1, 1)
        assert r.reasons == {"unsettled_timeout": 1} and r.accounted_pct == 50.0
    assert (found["none"].started, found["none"].accounted_pct) == (0, 0.0)


def test_drain_audit_needs_enough_settled(spark):
    rows = settlements(spark, *[(f"r{i}", "d", "settled", 0, None) for i in range(55)])
    none = started(spark).select("request_id", "tenant_id", "started_at")
    assert audit.drain_audit(rows, none, "d").first().passed
    assert not audit.drain_audit(rows, none, "d", minimum=56).first().passed
    doubled = rows.withColumn("drift_reason", F.lit("retry_double_count"))
    assert not audit.drain_audit(doubled, none, "d").first().passed
