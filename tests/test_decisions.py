"""Budget and claim replays against plain loops over the same log."""

import random

import pytest

from tallybook.operators import budget, claims

NOW = 1_700_000_000_000
DRAWS = "tenant_id string, event_id bigint, now_ms bigint, tokens bigint"
CLAIMS = (
    "event_id bigint, tenant_id string, idempotency_key string, request_id string, t_ms bigint, "
    "dur_ms bigint, released boolean"
)


def decide(spark, rows, capacity=1_000, refill=10.0, **options):
    frame = spark.createDataFrame(
        [(t, i, NOW + ms, n) for i, (t, ms, n) in enumerate(rows)], DRAWS
    )
    found = budget.budget_decisions(
        frame, capacity=capacity, refill_per_second=refill, **options
    ).collect()
    return [(r.granted, r.remaining) for r in sorted(found, key=lambda r: r.event_id)]


def bucket(rows, capacity, refill):
    """The rule itself, exactly, in thousandths of a thousandth of a token."""
    state, out = {}, []
    for tenant, ms, tokens in rows:
        if tokens <= 0:
            out.append((True, capacity))
            continue
        level, since = state.get(tenant, (capacity * 10**6, ms))
        level = min(capacity * 10**6, level + (ms - since) * round(refill * 1000))
        granted = level >= tokens * 10**6
        level -= tokens * 10**6 if granted else 0
        state[tenant] = (level, ms)
        out.append((granted, level // 10**6))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_logs_of_all_shapes_follow_the_rule(spark, seed):
    """Bursts, pauses, empty and oversize draws of several tenants, with fractional refills."""
    rng = random.Random(seed)
    capacity, refill = rng.randint(40, 90), rng.choice([0.5, 3.25, 17.0])
    rows, now = [], 0
    for _ in range(400):
        now += rng.choice([0, 0, 1, 35, 700, 26_000])
        rows.append((rng.choice("pqr"), now, rng.choice([0, 1, 4, 13, 39, capacity, capacity + 7])))
    assert decide(spark, rows, capacity, refill) == bucket(rows, capacity, refill)


def test_one_tenant_by_hand(spark):
    # 60 held, 12 back per second: 45 leaves 15, half a second makes 21, 22 is refused whole
    rows = [("z", 0, 45), ("z", 500, 22), ("z", 500, 21), ("z", 86_400_500, 60), ("z", 86_400_500, 1)]
    want = [(True, 15), (False, 21), (True, 0), (True, 0), (False, 0)]
    assert decide(spark, rows, 60, 12.0) == want


@pytest.mark.parametrize("slice_ms", [50, 1_000, 10_000_000])
@pytest.mark.parametrize("refill", [10.0, 0.125, 333.0])
def test_slices_do_not_change_decisions(spark, slice_ms, refill):
    draw = random.Random(slice_ms + int(refill * 8))
    rows, clock = [], 0
    for _ in range(1_200):
        clock += draw.choice([0, 1, 7, 40, 400, 9_000])
        tenant = "hot" if draw.random() < 0.7 else draw.choice("abc")
        rows.append((tenant, clock, draw.choice([0, 1, 3, 40, 90, 150, 290, 301])))
    want = bucket(rows, 300, refill)
    assert decide(spark, rows, capacity=300, refill=refill, slice_ms=slice_ms) == want


def rounds(monkeypatch):
    """Counts how often slices are replayed."""
    seen, write = [], budget.staged

    def counted(rows, label):
        seen.extend([label] if label == "slice-runs" else [])
        return write(rows, label)

    monkeypatch.setattr(budget, "staged", counted)
    return seen


@pytest.mark.parametrize("refill", [55.5, 333.25])
def test_a_saturated_tenant_settles_in_few_rounds(spark, monkeypatch, refill):
    """A tenant that is refused in each of some twenty slices; its bucket is never full again."""
    seen, draw = rounds(monkeypatch), random.Random(int(refill))
    rows = [(draw.choice("ab"), 7 * i, draw.randint(1, 90)) for i in range(12_000)]
    want = bucket(rows, 300, refill)
    refused = {7 * i // 4_000 for i, (granted, _) in enumerate(want) if not granted}
    assert len(refused) == 21
    assert decide(spark, rows, capacity=300, refill=refill, slice_ms=4_000) == want
    assert len(seen) <= 10


def test_cut_stream_draws_no_more(spark):
    rows = [
        ("t", "x", 0, 0, 60), ("t", "x", 1, 10, 60), ("t", "x", 2, 20, 10), ("t", "y", 0, 30, 30),
        ("u", "z", 0, 0, 100),
    ]
    frame = spark.createDataFrame(
        rows, "tenant_id string, request_id string, seq bigint, arrived_ms bigint, tokens bigint"
    )
    found = budget.cut_streams(frame, capacity=100, refill_per_second=0.0).collect()
    got = {(r.request_id, r.seq): (r.granted, r.remaining) for r in found}
    assert got == {
        ("x", 0): (True, 40), ("x", 1): (False, 40), ("y", 0): (True, 10), ("z", 0): (True, 0),
    }


@pytest.mark.parametrize("slice_ms", [50, 2_000, 10_000_000])
def test_slices_do_not_change_cuts(spark, slice_ms):
    """One tenant is often refused, one rarely, one never."""
    draw = random.Random(slice_ms)
    rows, clock = [], 0
    for i in range(1_500):
        clock += draw.choice([1, 7, 40, 400])
        tenant, most = draw.choice([("over", 400), ("near", 60), ("fine", 5)])
        rows.append((tenant, f"r{i // 60}-{draw.randrange(6)}", i, clock, draw.randint(1, most)))
    want, levels, cut = [], {}, set()
    for tenant, request, seq, now, tokens in rows:
        if (tenant, request) in cut:
            continue
        level, since = levels.get(tenant, (400_000, now))
        level = min(400_000, level + (now - since) * 30)
        granted = level >= tokens * 1_000
        level -= tokens * 1_000 if granted else 0
        if not granted:
            cut.add((tenant, request))
        levels[tenant] = (level, now)
        want.append((seq, granted, level // 1_000))
    frame = spark.createDataFrame(
        rows, "tenant_id string, request_id string, seq bigint, arrived_ms bigint, tokens bigint"
    )
    found = budget.cut_streams(frame, capacity=400, refill_per_second=30.0, slice_ms=slice_ms)
    assert sorted((r.seq, r.granted, r.remaining) for r in found.collect()) == want
    assert any(not granted for _, granted, _ in want)


def test_refused_admission_and_shared_level(spark):
    """Admissions (seq -1) and draws share the level; a stream that was not let in draws nothing."""
    rows = [
        ("t", "x", -1, 0, 70), ("t", "y", -1, 5, 40), ("t", "y", 3, 8, 1), ("t", "x", 2, 9, 25),
        ("t", "z", -1, 9, 10),
    ]
    frame = spark.createDataFrame(
        rows, "tenant_id string, request_id string, seq bigint, arrived_ms bigint, tokens bigint"
    )
    found = budget.cut_streams(frame, capacity=100, refill_per_second=0.0).collect()
    assert {(r.request_id, r.seq): (r.granted, r.remaining) for r in found} == {
        ("x", -1): (True, 30), ("y", -1): (False, 30), ("x", 2): (True, 5), ("z", -1): (False, 5),
    }


def test_cuts_of_a_saturated_tenant_settle_in_few_rounds(spark, monkeypatch):
    """Refused in each slice; streams outlast their slice, so later slices do without what earlier ones cut."""
    seen, draw = rounds(monkeypatch), random.Random(8)
    rows, want, level, since, cut = [], [], 300_000, 0, set()
    for i in range(8_000):
        rows.append(("t", f"r{(i - draw.randrange(60)) // 20}", i, 10 * i, draw.choice([3, 20, 45])))
    for _, request, seq, now, tokens in rows:
        if request in cut:
            continue
        level, since = min(300_000, level + (now - since) * 300), now
        granted = level >= tokens * 1_000
        level -= tokens * 1_000 if granted else 0
        cut |= set() if granted else {request}
        want.append((seq, granted, level // 1_000))
    refused = {seq // 400 for seq, granted, _ in want if not granted}
    assert len(refused) == 20
    frame = spark.createDataFrame(
        rows, "tenant_id string, request_id string, seq bigint, arrived_ms bigint, tokens bigint"
    )
    found = budget.cut_streams(frame, capacity=300, refill_per_second=300.0, slice_ms=4_000)
    assert sorted((r.seq, r.granted, r.remaining) for r in found.collect()) == want
    assert len(seen) <= 10


@pytest.mark.parametrize("slice_ms", [40, 500, 9_000])
def test_runs_do_not_change_decisions(spark, slice_ms):
    """Bursts that are refused between long quiet times, and streams that outlast them."""
    draw = random.Random(slice_ms)
    rows, clock = [], 0
    for i in range(1_200):
        clock += draw.choice([1, 3, 9, 30]) if i % 40 else 4_000
        request = f"r{i // 25}" if draw.random() < 0.8 else f"long{draw.randrange(9)}-{i // 300}"
        rows.append(("t", request, i, clock, draw.choice([1, 4, 9, 70])))
    want, level, since, cut = [], 200_000, rows[0][3], set()
    for _, request, seq, now, tokens in rows:
        if request in cut:
            continue
        level, since = min(200_000, level + (now - since) * 100), now
        granted = level >= tokens * 1_000
        level -= tokens * 1_000 if granted else 0
        cut |= set() if granted else {request}
        want.append((seq, granted, level // 1_000))
    frame = spark.createDataFrame(
        rows, "tenant_id string, request_id string, seq bigint, arrived_ms bigint, tokens bigint"
    )
    found = budget.cut_streams(frame, capacity=200, refill_per_second=100.0, slice_ms=slice_ms)
    assert sorted((r.seq, r.granted, r.remaining) for r in found.collect()) == want
    assert {granted for _, granted, _ in want} == {True, False}


def claim(spark, rows, **options):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], CLAIMS)
    found = claims.claim_outcomes(frame, **options).collect()
    return [(r.outcome, r.holder) for r in sorted(found, key=lambda r: r.event_id)]


def keys(rows, lease, ttl):
    """The store itself: one record per key, completions applied when their time comes."""
    record, coming, out = {}, [], []
    for tenant, key, request, now, lasts, released in rows:
        name = (tenant, key)
        for done in sorted(c for c in coming if c[0] <= now):
            record[done[1]] = (done[2], True, done[0] + ttl)
            coming.remove(done)
        held = record.get(name)
        if held and now < held[2]:
            out.append(("replay" if held[1] else "in_flight", held[0]))
            continue
        out.append(("claimed", request))
        if released:
            record.pop(name, None)
            continue
        record[name] = (request, False, now + lease)
        if lasts is not None:
            coming.append((now + lasts, name, request))
    return out


def test_claim_life_cycle(spark):
    rows = [
        ("t", "k", "r1", 0, 50, False),
        ("t", "k", "r2", 10, 50, False),
        ("t", "k", "r3", 60, 50, False),
        ("u", "k", "r4", 60, 50, False),
        ("t", "k", "r5", 1_050, 50, False),
    ]
    assert claim(spark, rows, lease_ms=100, completed_ttl_ms=1_000) == [
        ("claimed", "r1"), ("in_flight", "r1"), ("replay", "r1"), ("claimed", "r4"), ("claimed", "r5"),
    ]


def test_crash_frees_the_key_after_the_lease_and_release_at_once(spark):
    rows = [
        ("t", "k", "r1", 0, None, False), ("t", "k", "r2", 99, 5, False),
        ("t", "k", "r3", 100, 5, True), ("t", "k", "r4", 100, 5, False),
    ]
    assert [o for o, _ in claim(spark, rows, lease_ms=100)] == [
        "claimed", "in_flight", "claimed", "claimed",
    ]


def test_completion_overwrites_a_newer_holder(spark):
    rows = [
        ("t", "k", "slow", 0, 150, False), ("t", "k", "next", 110, 500, False),
        ("t", "k", "late", 160, 5, False),
    ]
    assert claim(spark, rows, lease_ms=100)[-1] == ("replay", "slow")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("heavy_rows", [None, 20])
def test_claims_equal_the_store(spark, seed, heavy_rows):
    draw = random.Random(seed)
    rows, clock = [], 0
    for i in range(1_500 if heavy_rows is None else 300):
        clock += draw.choice([0, 1, 5, 30, 120])
        key = "hot" if draw.random() < 0.4 else f"k{draw.randrange(150)}"
        lasts = draw.choice([None, 5, 60, 99, 150, 400])
        rows.append(("t", key, f"r{i}", clock, lasts, draw.random() < 0.2))
    options = {"lease_ms": 100, "completed_ttl_ms": draw.choice([50, 300, 2_000])}
    want = keys(rows, options["lease_ms"], options["completed_ttl_ms"])
    if heavy_rows:
        options["heavy_rows"] = heavy_rows
    assert claim(spark, rows, **options) == want


def test_one_key_with_a_third_of_all_attempts(spark):
    """Most of its leases run out under requests that go on, and completions overtake later holders."""
    draw = random.Random(9)
    rows, clock = [], 0
    for i in range(240):
        clock += draw.choice([0, 3, 20])
        key = "hot" if i % 3 == 0 else f"k{draw.randrange(80)}"
        rows.append(("t", key, f"r{i}", clock, draw.choice([None, 10, 45, 130, 170]), draw.random() < 0.1))
    want = keys(rows, 50, 25)
    assert claim(spark, rows, lease_ms=50, completed_ttl_ms=25, heavy_rows=40, slice_ms=500) == want
