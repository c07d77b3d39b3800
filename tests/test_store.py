"""Feeds stored by bucket: the same ledger, without moving what is stored."""

import pytest
from helpers import at, lit_at, metered, started, usage

from tallybook.operators import reconcile as rec
from tallybook.operators.store import FeedStore
from tallybook.plans.catalog import feeds

OUTPUTS = ["settlements", "late_metered", "late_usage", "started", "waiting"]


def rows(frame):
    return sorted(map(str, (r.asDict(recursive=True) for r in frame.select(*sorted(frame.columns)).collect())))


def same(found, wanted):
    for name in OUTPUTS:
        assert rows(getattr(found, name)) == rows(getattr(wanted, name)), name


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def drop_tables(spark, *names):
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")


@pytest.mark.parametrize("heavy_copies", [100_000, 3])
def test_deliveries_give_the_ledger_of_their_union(spark, tmp_path, heavy_copies):
    """Heavy requests of one delivery may be light in another; their rows still meet."""
    store = FeedStore(spark, str(tmp_path), f"store_{heavy_copies}", 4, heavy_copies)
    first = (
        started(spark, ("a", 0), ("b", 0), ("c", 0), ("open", 900)),
        metered(spark, *[("a", 1 + n, 10 + n, "completed") for n in range(6)], ("b", 9, 20, "completed")),
        usage(spark, ("b", 4, 20), ("c", 5, 7)),
    )
    second = (
        started(spark, ("b", 3), ("d", 50)),
        metered(spark, ("a", 40, 90, "completed"), *[("b", 2 + n, 30, "completed") for n in range(5)]),
        usage(spark, ("a", 12, 15), ("a", 700, 16), ("c", 400, 8)),
    )
    for delivery in (first, second):
        store.append(*delivery)
    both = [x.unionByName(y) for x, y in zip(first, second, strict=True)]
    same(store.reconciliation(), rec.reconciliation(*both))
    options = {"as_of": lit_at(30), "window_seconds": 20, "late": False}
    same(store.reconciliation(**options), rec.reconciliation(*both, **options))
    kept = spark.read.parquet(f"{tmp_path}/heavy")
    assert {r["request_id"] for r in kept.collect()} == ({"a", "b"} if heavy_copies == 3 else set())
    drop_tables(spark, store.name)


def test_all_tables_equal_the_plain_reconciliation(spark, folder, tmp_path):
    store = FeedStore(spark, str(tmp_path), "store_whole", 4)
    store.append(*feeds(spark, folder))
    same(store.reconciliation(), rec.reconciliation(*feeds(spark, folder)))
    drop_tables(spark, store.name)


def test_state_of_stored_requests_has_no_exchange(spark, tmp_path):
    store = FeedStore(spark, str(tmp_path), "store_plan", 4, 3)
    store.append(started(spark, ("a", 0)), metered(spark, ("a", 1, 1, "completed")), usage(spark, ("a", 2, 1)))
    plan = plan_of(rec.request_state(store._parts()[0]))
    assert "Bucketed: true" in plan and "Exchange" not in plan
    plain = plan_of(rec.request_state(rec.tagged(started(spark, ("a", 0)), metered(spark), usage(spark, ("a", 2, 1)))))
    assert "Exchange hashpartitioning" in plain
    heavy = [("b", n, 1) for n in range(9)]
    store.append(started(spark), metered(spark), usage(spark, *heavy))
    light, busy = store._parts()
    apart = light.join(busy.select("request_id").distinct(), "request_id", "left_anti")
    plan = plan_of(rec.request_state(apart))
    assert "Bucketed: true" in plan
    # the buckets are aggregated above the join without being moved
    above = plan.split("Join")[0]
    assert "Exchange" not in above
    drop_tables(spark, store.name)


def test_a_second_session_finds_what_was_stored(spark, tmp_path):
    first = FeedStore(spark, str(tmp_path), "store_first", 4)
    first.append(started(spark, ("a", 0)), metered(spark, ("a", 1, 1, "completed")), usage(spark, ("a", 2, 1)))
    other = FeedStore(spark.newSession(), str(tmp_path), "store_again", 4)
    (row,) = other.reconciliation().settlements.collect()
    assert (row["request_id"], row["settled_at"]) == ("a", at(2))
    drop_tables(spark, first.name, other.name)
