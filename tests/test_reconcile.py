"""Joining the two ledgers: order of arrival, copies, deadlines and reasons."""

import random

import pytest
from helpers import at, by_request, lit_at, metered, started, usage
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallybook.operators import reconcile as rec

DONE = "completed"


def settle(spark, s, a, b, **options):
    frame = rec.reconcile(started(spark, *s), metered(spark, *a), usage(spark, *b), **options)
    return by_request(frame)


@pytest.mark.parametrize(("a", "b"), [(5, 6), (6, 5), (5, 5)])
def test_pair_settles_when_complete_in_either_order(spark, a, b):
    row = settle(spark, [("r", 0)], [("r", a, 100, DONE)], [("r", b, 100)])["r"]
    assert (row.status, row.drift_reason, row.drift_tokens) == ("settled", None, 0)
    assert row.settled_at == at(max(a, b))


@pytest.mark.parametrize(
    ("state", "seen", "billed", "reason", "drift"),
    [
        ("client_disconnect", 60, 100, "client_disconnect_partial", 40),
        ("budget_exceeded", 60, 100, "budget_truncated", 40),
        ("gateway_shutdown", 60, 100, "gateway_crash_partial", 40),
        ("completed", 98, 100, "tokenizer_mismatch", 2),
        ("provider_error", 98, 100, "tokenizer_mismatch", 2),
        ("completed", 100, 90, "provider_underreport", -10),
        ("client_disconnect", 100, 90, "provider_underreport", -10),
    ],
)
def test_disagreement_is_attributed(spark, state, seen, billed, reason, drift):
    row = settle(spark, [("r", 0)], [("r", 5, seen, state)], [("r", 6, billed)])["r"]
    assert (row.status, row.drift_reason, row.drift_tokens) == ("settled_with_drift", reason, drift)


def test_tolerance_absorbs_small_disagreement(spark):
    row = settle(spark, [], [("r", 5, 98, DONE)], [("r", 6, 100)], tolerance=2)["r"]
    assert (row.status, row.drift_tokens) == ("settled", 0)


def test_missing_report_is_forced_on_the_metered_count(spark):
    row = settle(spark, [("r", 0)], [("r", 5, 80, DONE)], [])["r"]
    assert (row.status, row.metered_total, row.provider_total) == ("force_settled", 130, None)
    assert row.drift_reason == "unsettled_timeout"
    assert row.settled_at == at(300)


def test_request_without_either_ledger_leaves_pending_at_zero(spark):
    row = settle(spark, [("r", 0)], [], [])["r"]
    assert (row.metered_total, row.model, row.tenant_id) == (0, "unknown", "acme")
    assert settle(spark, [("r", 0)], [], [], floor="prompt")["r"].metered_total == 50


def test_latest_copy_before_the_pair_completes_is_used(spark):
    a = [("r", 2, 10, DONE), ("r", 4, 20, DONE), ("r", 9, 30, DONE)]
    row = settle(spark, [("r", 0)], a, [("r", 6, 20), ("r", 7, 99)])["r"]
    assert (row.metered_total, row.provider_total, row.settled_at) == (70, 70, at(6))


def test_late_pair_is_forced_with_what_came_in_time(spark):
    a = [("r", 5, 10, DONE), ("r", 301, 99, DONE)]
    row = settle(spark, [("r", 0)], a, [("r", 400, 10)])["r"]
    assert (row.status, row.metered_total) == ("force_settled", 60)


def test_pair_completing_exactly_at_the_deadline_is_forced(spark):
    row = settle(spark, [("r", 0)], [("r", 5, 10, DONE)], [("r", 300, 10)])["r"]
    assert row.status == "force_settled"


def test_unstarted_half_waits_for_ever(spark):
    assert settle(spark, [], [("r", 5, 10, DONE)], [("x", 5, 10)]) == {}


def test_as_of_shows_the_ledger_at_that_time(spark):
    s, a, b = [("r", 0), ("q", 0)], [("r", 5, 10, DONE)], [("r", 6, 10)]
    assert settle(spark, s, a, b, as_of=lit_at(5)) == {}
    assert set(settle(spark, s, a, b, as_of=lit_at(6))) == {"r"}
    assert set(settle(spark, s, a, b, as_of=lit_at(299))) == {"r"}
    assert set(settle(spark, s, a, b, as_of=lit_at(300))) == {"r", "q"}


def test_tick_rounds_the_deadline_up(spark):
    assert settle(spark, [("r", 1)], [], [], tick_seconds=30)["r"].settled_at == at(330)
    assert settle(spark, [("r", 0)], [], [], tick_seconds=30)["r"].settled_at == at(300)


def test_duplicate_key_outranks_everything(spark):
    a, b = metered(spark, ("r", 5, 98, DONE)), usage(spark, ("r", 6, 100))
    flags = spark.createDataFrame([("r",)], "request_id string")
    row = by_request(rec.attribute_pairs(a, b, duplicate_key=flags))["r"]
    assert (row.status, row.drift_reason) == ("settled_with_drift", "retry_double_count")
    assert row.drift_tokens == 148


def test_half_joined_and_orphans(spark):
    s = started(spark, ("r", 0), ("q", 0), ("late", 0))
    a = metered(spark, ("r", 5, 1, DONE), ("q", 5, 1, DONE), ("late", 5, 1, DONE))
    b = usage(spark, ("r", 6, 1), ("ghost", 6, 1), ("late", 6, 1), ("late", 8, 2))
    counts = dict(rec.half_joined(s, a, b, as_of=lit_at(10)).collect())
    assert counts == {"metered": 1, "usage": 2}
    assert list(by_request(rec.orphan_usage(a, b))) == ["ghost"]


def test_copies_after_settlement_are_counted_not_joined(spark):
    s = started(spark, ("r", 0), ("q", 0))
    a = metered(spark, ("r", 5, 1, DONE), ("r", 9, 2, DONE), ("r", 9, 2, DONE), ("q", 400, 1, DONE))
    b = usage(spark, ("r", 6, 1), ("r", 7, 5), ("q", 500, 1))
    rows = rec.reconcile(s, a, b)
    assert dict(rec.duplicates_absorbed(a, rows).collect()) == {"acme": 3}
    assert list(by_request(rec.late_usage(b, rows))) == ["q"]
    assert rec.late_usage(b, rows, include_joined=True).count() == 2


def test_a_request_with_a_third_of_all_copies(spark):
    """Copies of one request on both sides of its settlement, enough of them to be spread."""
    t = F.lit(at(0)) + F.make_dt_interval(secs=F.col("id") / 100)
    hot = spark.range(6_000).select(
        F.lit("hot").alias("request_id"), F.lit("k").alias("idempotency_key"),
        F.lit("acme").alias("tenant_id"), F.lit("m").alias("model"), F.lit(50).alias("prompt_tokens"),
        F.col("id").alias("completion_tokens"), F.lit(DONE).alias("terminal_state"), t.alias("ended_at"),
    )
    cool = hot.withColumns({
        "request_id": F.concat(F.lit("r"), F.col("completion_tokens")), "ended_at": F.lit(at(1)),
    })
    reports = cool.select(
        "request_id", "prompt_tokens", "completion_tokens", F.lit(at(2)).alias("reported_at")
    ).unionByName(usage(spark, ("hot", 20, 2_000), ("hot", 30, 1)))
    copies = hot.unionByName(cool)
    found = by_request(rec.reconcile(started(spark, ("hot", 0)), copies, reports))
    assert len(found) == 6_001
    assert (found["hot"].settled_at, found["hot"].metered_total) == (at(20), 2_050)
    assert found["hot"].status == "settled"
    assert all(r.status == "settled" for r in found.values())
    settled = rec.reconcile(started(spark, ("hot", 0)), copies, reports)
    assert dict(rec.duplicates_absorbed(copies, settled).collect()) == {"acme": 3_999}


def model(s, a, b, window=300):
    """The rules, one event at a time, for a single request."""
    log = sorted(
        [(t, 0, "S", None) for t in s[:1]]
        + [(t, 1, "A", n) for t, n in a]
        + [(t, 1, "B", n) for t, n in b],
        key=lambda e: (e[0], e[1], e[3] or 0),
    )
    start, metered_, usage_ = None, None, None
    for time, _, side, n in log:
        if start is not None and time >= start + window:
            break
        if side == "S":
            start = time
        elif side == "A":
            metered_ = n
        else:
            usage_ = n
        if metered_ is not None and usage_ is not None:
            # Copies of the same instant count as having been there.
            metered_ = max([n for t, n in a if t == time] or [metered_])
            usage_ = max([n for t, n in b if t == time] or [usage_])
            return (time, metered_ + 50, usage_ + 50)
    if start is None:
        return None
    return (start + window, 0 if metered_ is None else metered_ + 50, None)


def test_the_sweep_comes_first_at_the_deadline(spark):
    """A copy and a report exactly at the deadline: neither is billed, both are left over."""
    s, a, b = started(spark, ("r", 100)), metered(spark, ("r", 400, 1, DONE)), usage(spark, ("r", 400, 2))
    rows = rec.reconcile(s, a, b)
    row = rows.first()
    assert (row.status, row.metered_total, row.settled_at) == ("force_settled", 0, at(400))
    assert [r.request_id for r in rec.late_usage(b, rows).collect()] == ["r"]
    assert dict(rec.duplicates_absorbed(a, rows).collect()) == {"acme": 1}


times = st.integers(0, 12).map(lambda t: t * 50)
copies = st.lists(st.tuples(times, st.integers(1, 9)), max_size=4)
requests = st.lists(st.tuples(st.lists(times, max_size=1), copies, copies), min_size=1, max_size=30)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(requests)
def test_batch_equals_the_event_by_event_model(spark, drawn):
    s, a, b, want = [], [], [], {}
    for i, (starts, ma, mb) in enumerate(drawn):
        name = f"r{i}"
        s += [(name, t) for t in starts]
        a += [(name, t, n, DONE) for t, n in ma]
        b += [(name, t, n) for t, n in mb]
        expected = model(starts, ma, mb)
        if expected is not None:
            want[name] = expected
    found = settle(spark, s, a, b)
    got = {k: (r.settled_at, r.metered_total, r.provider_total) for k, r in found.items()}
    assert got == {k: (at(t), x, y) for k, (t, x, y) in want.items()}


@pytest.mark.parametrize("as_of", [None, 25])
def test_outputs_of_one_pass_agree_with_separate_ones(spark, as_of):
    """Late copies of either ledger, starts and waiting requests of many random requests."""
    rng = random.Random(3)
    s, a, b = [], [], []
    for n in range(150):
        t = [rng.randint(0, 40) for _ in range(12)]
        s += [(f"r{n}", x) for x in t[: rng.choice((0, 1, 1, 2))]]
        a += [(f"r{n}", x, rng.randint(1, 3), DONE) for x in t[2 : 2 + rng.randint(0, 6)]]
        b += [(f"r{n}", x, rng.randint(1, 3)) for x in t[8 : 8 + rng.randint(0, 4)]]
    a += [("r0", 39, 1, DONE), ("r0", 39, 1, DONE)]  # equal copies of one instant
    s, a, b = started(spark, *s), metered(spark, *a), usage(spark, *b)
    options = {"window_seconds": 20} | ({"as_of": lit_at(as_of)} if as_of else {})
    found = rec.reconciliation(s, a, b, **options)
    rows = rec.reconcile(s, a, b, **options)

    def there(frame, column):
        return frame if as_of is None else frame.where(F.col(column) <= lit_at(as_of))

    def same(left, right):
        assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)

    same(found.settlements.select(*rec.SETTLEMENT_COLUMNS), rows)
    late_a = rec.after_settlement(there(a, "ended_at"), rows, "ended_at")
    late_b = rec.late_usage(there(b, "reported_at"), rows, include_joined=True)
    assert late_a.count() > 20 and late_b.count() > 10
    copy = ["request_id", "tenant_id", "prompt_tokens", "completion_tokens", "idempotency_key", "ended_at"]
    same(found.late_metered.select(*copy, "settled_at"), late_a.select(*copy, "settled_at"))
    total = (F.col("prompt_tokens") + F.col("completion_tokens")).alias("t")
    same(
        found.late_usage.select("request_id", total, "reported_at", "settled_at", "forced"),
        late_b.select("request_id", F.col("provider_total").alias("t"), "reported_at", "settled_at",
                      (F.col("status") == "force_settled").alias("forced")),
    )
    first = there(s, "started_at").groupBy("request_id").agg(F.min("started_at"))
    same(found.started.select("request_id", "started_at"), first)
    same(found.waiting.select("request_id"), first.join(rows, "request_id", "left_anti").select("request_id"))
