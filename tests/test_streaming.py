"""Streams against their batch twins, restarts, replays and the wire."""

import json
import random
import time
from datetime import UTC, datetime

import pytest
from helpers import at, metered, started, usage
from pyspark.sql import functions as F

from tallybook import schemas as S
from tallybook.operators import budget
from tallybook.operators.reconcile import SETTLEMENT_COLUMNS, after_settlement, late_usage, reconcile
from tallybook.plans.fixtures import view
from tallybook.sources import events
from tallybook.streaming import decisions, gate, reconcile_stream as rs, writer

ONCE = {"availableNow": True}
DONE = "completed"


def records(spark, s, a, b):
    """Feed records of the three event tables, with the arrival time as record time."""
    parts = []
    for topic, rows in ((S.STARTED, s), (S.METERED, a), (S.USAGE, b)):
        time = F.get_json_object("value", f"$.{S.ARRIVAL[topic]}").cast("double")
        parts.append(events.encode(rows, topic).withColumn("timestamp", F.timestamp_seconds(time)))
    feed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return feed.withColumns({"partition": F.lit(0), "offset": F.lit(0).cast("bigint")})


def far_future(spark):
    """A start long after everything else, so that the clock passes every deadline."""
    return started(spark, ("beat", 90 * 86_400))


def drop_in(feed, folder, files=1):
    """Write the feed as files in time order."""
    low, high = feed.agg(F.min("timestamp"), F.max("timestamp")).first()
    width = (high - low) / files
    for i in range(files):
        start, end = low + i * width, high if i == files - 1 else low + (i + 1) * width
        last = F.col("timestamp") <= end if i == files - 1 else F.col("timestamp") < end
        part = feed.where((F.col("timestamp") >= start) & last)
        part.coalesce(1).write.mode("append").json(folder)


def run(spark, root, watermark=None, stream=None, **options):
    feed = events.file_feed(spark, f"{root}/feed", max_files=1)
    outcomes = rs.settle_stream(rs.arrivals(feed), watermark=watermark, **(stream or {}))
    outcomes = outcomes.unionByName(rs.quarantined(feed), allowMissingColumns=True)
    query = writer.write_ledger(outcomes, f"{root}/ledger", f"{root}/check", trigger=ONCE, **options)
    query.awaitTermination()
    return writer.stored(spark, f"{root}/ledger/settlements").select(*SETTLEMENT_COLUMNS)


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def utc(rows):
    return rows.withColumn("settled_at", F.col("settled_at").cast("timestamp"))


def test_stream_equals_batch_over_restarts(spark, folder, tmp_path):
    tables = [view(spark, folder, n) for n in ("requests_started", "requests_metered", "provider_usage")]
    feed = records(spark, *tables)
    cut = "2024-01-12"
    drop_in(feed.where(F.col("timestamp") < cut), f"{tmp_path}/feed", 2)
    first = run(spark, tmp_path).count()
    drop_in(feed.where(F.col("timestamp") >= cut), f"{tmp_path}/feed", 2)
    empty = [t.limit(0) for t in tables[1:]]
    drop_in(records(spark, far_future(spark), *empty), f"{tmp_path}/feed")
    events_seen = []
    got = run(spark, tmp_path, on_drift=lambda rows, batch: events_seen.append(rows.count()))
    assert 0 < first < got.count()
    assert same(got, utc(reconcile(*tables)))
    drift = spark.read.parquet(f"{tmp_path}/ledger/drift")
    assert drift.count() == got.where("status = 'settled_with_drift'").count()
    kinds = spark.read.parquet(f"{tmp_path}/ledger/leftovers").groupBy("kind").count()
    assert dict(kinds.collect())[rs.ABSORBED] > 0
    waiting = {r.request_id for r in writer.pending_now(spark, f"{tmp_path}/ledger").collect()}
    assert waiting == {"beat"}


def test_order_copies_and_deadlines(spark, tmp_path):
    s = started(spark, ("r", 0), ("forced", 0), ("empty", 0), ("late", 0))
    a = metered(
        spark, ("r", 5, 10, DONE), ("r", 7, 20, DONE), ("r", 50, 30, DONE), ("unstarted", 5, 1, DONE),
        ("forced", 5, 8, DONE), ("late", 301, 9, DONE),
    )
    b = usage(spark, ("r", 9, 25), ("unstarted", 6, 1), ("late", 302, 9), ("ghost", 5, 5))
    drop_in(records(spark, s, a, b), f"{tmp_path}/feed", 3)
    drop_in(records(spark, far_future(spark), a.limit(0), b.limit(0)), f"{tmp_path}/feed")
    got = run(spark, tmp_path)
    assert same(got, reconcile(s, a, b))
    found = {r.request_id: r for r in got.collect()}
    assert (found["r"].metered_total, found["r"].provider_total) == (70, 75)
    assert found["late"].status == "force_settled" and found["empty"].model == "unknown"
    left = spark.read.parquet(f"{tmp_path}/ledger/leftovers").select("kind", "request_id")
    assert sorted(map(tuple, left.collect())) == [
        (rs.ABSORBED, "late"), (rs.ABSORBED, "r"), (rs.LATE_USAGE, "late"), (rs.ORPHAN, "ghost"),
    ]


def leftovers(spark, root):
    rows = spark.read.parquet(f"{root}/ledger/leftovers").collect()
    return sorted(
        (r.kind, r.request_id, r.metered_total, r.provider_total, r["at"].replace(tzinfo=None))
        for r in rows if r.kind != rs.ORPHAN
    )


def batch_leftovers(settlements, a, b):
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    absorbed = after_settlement(a, settlements, "ended_at").select(
        "request_id", total.alias("t"), F.col("ended_at").alias("at")
    )
    late = late_usage(b, settlements, include_joined=True)
    rows = [(rs.ABSORBED, r.request_id, r.t, None, r["at"]) for r in absorbed.collect()]
    rows += [
        (rs.LATE_USAGE, r.request_id, None, r.provider_total, r.reported_at) for r in late.collect()
    ]
    return sorted(rows)


def test_report_after_later_copies_settles_on_the_copy_of_its_time(spark, tmp_path):
    s, a = started(spark, ("r", 0)), metered(
        spark, ("r", 1, 10, DONE), ("r", 5, 20, DONE), ("r", 9, 30, DONE), ("r", 9, 31, DONE)
    )
    b = usage(spark, ("r", 7, 20))
    none = [x.limit(0) for x in (s, a, b)]
    for part in ((s, none[1], none[2]), (none[0], a, none[2]), (none[0], none[1], b)):
        drop_in(records(spark, *part), f"{tmp_path}/feed")
    row = run(spark, tmp_path).first()
    assert (row.metered_total, row.provider_total, row.status) == (70, 70, "settled")
    assert leftovers(spark, tmp_path) == [
        (rs.ABSORBED, "r", 80, None, at(9)), (rs.ABSORBED, "r", 81, None, at(9)),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_equals_batch(spark, tmp_path, seed):
    """Rows of many requests, dealt to triggers at random: settlements and leftovers are those of a batch."""
    rng = random.Random(seed)
    s, a, b = [], [], []
    for n in range(120):
        times = [rng.randint(0, 40) for _ in range(9)]
        s += [(f"r{n}", t) for t in times[: rng.choice((0, 1, 1, 2))]]
        a += [(f"r{n}", t, rng.randint(1, 3), rng.choice((DONE, "client_disconnect")))
              for t in times[2 : 2 + rng.randint(0, 5)]]
        b += [(f"r{n}", t, rng.randint(1, 3)) for t in times[6 : 6 + rng.randint(0, 3)]]
    s, a, b = started(spark, *s), metered(spark, *a), usage(spark, *b)
    dealt = records(spark, s, a, b).withColumn("f", F.floor(F.rand(seed) * 4)).cache()
    for n in range(4):
        dealt.where(f"f = {n}").drop("f").coalesce(1).write.mode("append").json(f"{tmp_path}/feed")
    drop_in(records(spark, far_future(spark), a.limit(0), b.limit(0)), f"{tmp_path}/feed")
    stream = {"settle": "watermark", "window_seconds": 20, "retain_seconds": 86_400}
    got = run(spark, tmp_path, watermark="1 day", stream=stream)
    want = reconcile(s, a, b, window_seconds=20)
    assert want.count() > 80
    assert same(got, want)
    assert leftovers(spark, tmp_path) == batch_leftovers(want, a, b)


def test_stream_from_a_stored_ledger_and_settled_elsewhere(spark, tmp_path):
    s = started(spark, ("old", 0), ("new", 0), ("other", 0))
    a = metered(spark, ("old", 5, 10, DONE), ("new", 5, 10, DONE), ("other", 5, 10, DONE), ("other", 9, 11, DONE))
    b = usage(spark, ("old", 6, 10), ("new", 6, 10), ("other", 12, 10))
    none = [x.limit(0) for x in (s, a, b)]
    ledger = reconcile(s, a, b).where("request_id = 'old'")
    elsewhere = reconcile(s, a, b).where("request_id = 'other'").withColumn("settled_at", F.lit(at(7)))
    drop_in(records(spark, s, a, none[2]), f"{tmp_path}/feed")
    drop_in(records(spark, none[0], none[1], b), f"{tmp_path}/feed")
    moved = rs.settled_elsewhere(elsewhere).withColumn("at", F.col("at").cast("timestamp"))
    moved.coalesce(1).write.parquet(f"{tmp_path}/elsewhere")

    def go():
        feed = rs.arrivals(events.file_feed(spark, f"{tmp_path}/feed", max_files=1))
        more = spark.readStream.schema(moved.schema).parquet(f"{tmp_path}/elsewhere")
        outcomes = rs.settle_stream(feed.unionByName(more), ledger=ledger)
        query = writer.write_ledger(outcomes, f"{tmp_path}/ledger", f"{tmp_path}/check", trigger=ONCE)
        query.awaitTermination()

    go()
    settled = writer.stored(spark, f"{tmp_path}/ledger/settlements").collect()
    assert [r.request_id for r in settled] == ["new"]
    assert [r[:2] for r in leftovers(spark, tmp_path)] == [
        (rs.ABSORBED, "old"), (rs.ABSORBED, "other"), (rs.LATE_USAGE, "old"), (rs.LATE_USAGE, "other"),
    ]
    held = spark.read.format("statestore").option("path", f"{tmp_path}/check")
    copies = held.option("stateVarName", "copies").load()
    assert copies.count() == 0  # nothing of a settled request but that it is settled
    drop_in(records(spark, started(spark, ("beat", 2_000)), *none[1:]), f"{tmp_path}/feed")
    drop_in(records(spark, started(spark, ("beat2", 2_001)), *none[1:]), f"{tmp_path}/feed")
    go()
    record = spark.read.format("statestore").option("path", f"{tmp_path}/check")
    names = record.option("stateVarName", "record").load().select("key.request_id").collect()
    assert {r.request_id for r in names} == {"beat", "beat2"}  # forgotten after the retention


def test_lag_of_sources():
    def kafka(start, end, latest):
        return {"description": "KafkaV2", "startOffset": start, "endOffset": end, "latestOffset": latest}

    def lag(*sources):
        return gate.source_lag({"sources": sources}, but="/ticks")

    assert lag(kafka({"t": {"0": 1}}, {"t": {"0": 5, "1": 2}}, {"t": {"0": 9, "1": 2}})) == 4
    assert lag(kafka(None, {"t": {"0": 9}}, {"t": {"0": 9}})) == 0
    assert lag(kafka(None, '{"t": {"0": 9}}', '{"t": {"0": 10}}')) == 1
    assert lag(kafka(None, {"t": {"0": 9}}, {"t": {"0": 9, "1": 5}})) is None  # a partition not read yet
    assert lag(kafka(None, {"t": {"0": -1}}, {"t": {"0": 9}})) is None
    assert lag(kafka(None, None, {"t": {"0": 9}})) is None
    files = {"description": "FileStreamSource[/in]", "startOffset": {"logOffset": 3}, "latestOffset": None}
    assert lag(files | {"endOffset": {"logOffset": 3}}) == 0
    assert lag(files | {"endOffset": {"logOffset": 4}}) is None
    own = {"description": "FileStreamSource[/ticks]", "startOffset": None, "endOffset": {"logOffset": 1}}
    assert lag(own) is None and lag(own, files | {"endOffset": {"logOffset": 3}}) == 0
    assert gate.source_lag({"sources": []}) is None
    assert (gate.sweep_every(), gate.sweep_every(20)) == (30, 5)


def test_gate_opens_only_when_all_was_read(spark, tmp_path):
    door = gate.SweepGate(spark, f"{tmp_path}/ticks", every=0)
    now = datetime(2024, 5, 2, tzinfo=UTC)
    busy = {"isTriggerActive": True, "isDataAvailable": True, "message": "Processing new data"}
    idle = {"isTriggerActive": False, "isDataAvailable": False, "message": gate.IDLE}
    first = idle | {"message": "Initializing sources"}
    behind = {"timestamp": "2024-05-01T23:00:00Z", "sources": [
        {"description": "F", "startOffset": 1, "endOffset": 2, "latestOffset": 5}]}
    level = behind | {"sources": [{"description": "F", "startOffset": 1, "endOffset": 5, "latestOffset": 5}]}
    assert door.open_to(None, idle, now) is None
    assert door.open_to(behind, busy, now) is None and door.open_to(behind, first, now) is None
    assert door.open_to(behind, idle, now) == now
    assert door.open_to(level, busy, now) == datetime(2024, 5, 1, 23, tzinfo=UTC)


def test_backlog_is_read_before_anything_is_forced(spark, tmp_path):
    """Starts of long ago, their reports five files later: by the wall clock all are overdue at once."""
    s, a = started(spark, ("r", 0), ("alone", 0)), metered(spark, ("r", 5, 1, DONE))
    b = usage(spark, ("r", 6, 1))
    none = [x.limit(0) for x in (s, a, b)]
    drop_in(records(spark, s, *none[1:]), f"{tmp_path}/feed")
    for n in range(4):
        drop_in(records(spark, none[0], metered(spark, (f"x{n}", 50 * n, 1, DONE)), none[2]), f"{tmp_path}/feed")
    drop_in(records(spark, none[0], a, none[2]), f"{tmp_path}/feed")
    drop_in(records(spark, none[0], none[1], b), f"{tmp_path}/feed")
    door = gate.SweepGate(spark, f"{tmp_path}/ticks", every=0.2)
    (tmp_path / "ticks").mkdir()
    feed = rs.arrivals(events.file_feed(spark, f"{tmp_path}/feed", max_files=1))
    arrived = feed.unionByName(gate.ticks(spark, f"{tmp_path}/ticks"))
    outcomes = rs.settle_stream(arrived, clock="processing", watermark="1 second")
    query = writer.write_ledger(
        outcomes, f"{tmp_path}/ledger", f"{tmp_path}/check", trigger={"processingTime": "0 seconds"}
    )
    found, until = {}, time.monotonic() + 180
    try:
        while len(found) < 2 and time.monotonic() < until:
            door.poll(query)
            time.sleep(0.2)
            rows = writer.stored(spark, f"{tmp_path}/ledger/settlements").collect()
            found = {r.request_id: r.status for r in rows}
    finally:
        query.stop()
    assert found == {"r": "settled", "alone": "force_settled"}
    assert door.deferred > 0 and door.ticked > 0


def test_replayed_tail_adds_no_settlement(spark, tmp_path):
    s, a, b = started(spark, ("r", 0)), metered(spark, ("r", 5, 1, DONE)), usage(spark, ("r", 6, 1))
    feed = records(spark, s, a, b)
    drop_in(feed, f"{tmp_path}/feed")
    events.tail_replay(feed, 10).coalesce(1).write.mode("append").json(f"{tmp_path}/feed")
    assert run(spark, tmp_path).count() == 1


def test_batch_written_twice_changes_nothing(spark, tmp_path):
    rows = reconcile(started(spark), metered(spark, ("r", 5, 1, DONE)), usage(spark, ("r", 6, 1)))
    table = str(tmp_path / "t")
    for _ in range(2):
        assert writer.settle_batch(rows, 7, table).count() == 1
    assert writer.settle_batch(rows, 8, table).count() == 0
    assert writer.stored(spark, table).count() == 1
    assert writer.settle_batch(rows.limit(0), 9, table).count() == 0
    writer.compact(spark, table, str(rows.first().settled_at.date()))
    assert writer.settle_batch(rows, 10, table).count() == 0
    assert [r.batch_id for r in writer.stored(spark, table).collect()] == [-1]


def test_only_a_missing_table_reads_as_empty(spark, tmp_path):
    (tmp_path / "t" / "day=2024-05-01" / "batch_id=1").mkdir(parents=True)
    (tmp_path / "t" / "day=2024-05-01" / "batch_id=1" / "part-0.parquet").write_text("broken")
    assert writer.stored(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)parquet"):
        writer.stored(spark, str(tmp_path / "t")).collect()


def test_late_rows_reach_their_request(spark, tmp_path):
    """A partition that lags 200 s behind, with a watermark of 10 s: nothing is lost."""
    none = [metered(spark).limit(0), usage(spark).limit(0)]
    drop_in(records(spark, started(spark, ("r", 0), ("q", 0)), *none), f"{tmp_path}/feed")
    drop_in(records(spark, started(spark, ("beat", 200)), *none), f"{tmp_path}/feed")
    drop_in(records(spark, started(spark, ("beat2", 210)), *none), f"{tmp_path}/feed")
    late = metered(spark, ("r", 5, 10, DONE)), usage(spark, ("r", 6, 10))
    drop_in(records(spark, started(spark), *late), f"{tmp_path}/feed")
    drop_in(records(spark, far_future(spark), *none), f"{tmp_path}/feed")
    run(spark, tmp_path, watermark="10 seconds")
    after = metered(spark, ("q", 7, 3, DONE)), usage(spark, ("q", 8, 3))
    drop_in(records(spark, started(spark), *after), f"{tmp_path}/feed")
    got = {r.request_id: r for r in run(spark, tmp_path, watermark="10 seconds").collect()}
    assert (got["r"].status, got["r"].metered_total) == ("settled", 60)
    assert got["q"].status == "force_settled"
    left = spark.read.parquet(f"{tmp_path}/ledger/leftovers").collect()
    assert {(r.kind, r.request_id) for r in left} == {(rs.ABSORBED, "q"), (rs.LATE_USAGE, "q")}


def test_files_out_of_order_give_the_batch_result(spark, tmp_path):
    s = started(spark, *[(f"r{i}", 10 * i) for i in range(8)], ("r1", 60))
    a = metered(spark, *[(f"r{i}", 10 * i + 5, i, DONE) for i in range(7)], ("r2", 320, 9, DONE))
    b = usage(spark, *[(f"r{i}", 10 * i + 7 + 60 * i, i + 1) for i in range(6)])
    for part in ((s, a.limit(0), b.limit(0)), (s.limit(0), a.limit(0), b), (s.limit(0), a, b.limit(0))):
        drop_in(records(spark, *part), f"{tmp_path}/feed")
    drop_in(records(spark, far_future(spark), a.limit(0), b.limit(0)), f"{tmp_path}/feed")
    assert same(run(spark, tmp_path), reconcile(s, a, b))


def test_broken_records_of_the_stream_are_kept(spark, tmp_path):
    feed = records(spark, started(spark, ("r", 0)), metered(spark, ("r", 5, 1, DONE)), usage(spark))
    broken = feed.withColumn("value", F.regexp_replace("value", '"tenant_id"', '"tenant"'))
    drop_in(broken, f"{tmp_path}/feed")
    assert run(spark, tmp_path).count() == 0
    kept = spark.read.parquet(f"{tmp_path}/ledger/quarantine").collect()
    assert sorted((r.topic, r.error) for r in kept) == [
        (S.METERED, "tenant_id"), (S.STARTED, "tenant_id"),
    ]
    assert all('"tenant"' in r.value for r in kept)


def test_broken_records_are_set_aside(spark):
    good = {
        "request_id": "r", "idempotency_key": "k", "tenant_id": "t", "model": "m",
        "prompt_tokens": "5", "completion_tokens": 6.0, "terminal_state": DONE, "ended_at": 1.25,
        "later_field": {"x": 1},
    }
    broken = {
        "text": "{", "array": "[]", "state": json.dumps(good | {"terminal_state": "gone"}),
        "half": json.dumps(good | {"prompt_tokens": 1.5}),
        "word": json.dumps(good | {"completion_tokens": "six"}),
        "gap": json.dumps({k: v for k, v in good.items() if k != "tenant_id"}),
        "null": json.dumps(good | {"model": None}), "number": json.dumps(good | {"model": 5}),
    }
    rows = [("ok", json.dumps(good), S.METERED)] + [(k, v, S.METERED) for k, v in broken.items()]
    feed = spark.createDataFrame(rows, "key string, value string, topic string")
    for decoded in (events.decode(feed, S.METERED), events.decode_all(feed)):
        errors = {r.key: r.error for r in events.quarantine(decoded).collect()}
        assert errors == {
            "text": "not json", "array": "request_id", "state": "terminal_state",
            "half": "prompt_tokens", "word": "completion_tokens", "gap": "tenant_id", "null": "model",
            "number": "model",
        }
    row = events.good(events.decode(feed, S.METERED), S.METERED).first()
    assert (row.prompt_tokens, row.completion_tokens) == (5, 6)
    assert row.ended_at.microsecond == 250_000


def test_wire_round_trip_and_routing(spark):
    s, a, b = started(spark, ("r", 0)), metered(spark, ("r", 5.123456, 1, DONE)), usage(spark, ("r", 6, 1))
    parts = events.route(records(spark, s, a, b))
    for topic, rows in ((S.STARTED, s), (S.METERED, a), (S.USAGE, b)):
        assert same(parts[topic], rows)


def test_interval_join_settles_pairs_and_singles(spark, tmp_path):
    a = metered(spark, ("pair", 0, 1, DONE), ("alone", 1, 1, DONE), ("beat", 9_000, 1, DONE))
    b = usage(spark, ("pair", 2, 3), ("beat", 9_000, 1))
    a.coalesce(1).write.parquet(f"{tmp_path}/a")
    b.coalesce(1).write.parquet(f"{tmp_path}/b")
    joined = rs.interval_join(
        spark.readStream.schema(S.METERED_SCHEMA).parquet(f"{tmp_path}/a"),
        spark.readStream.schema(S.USAGE_SCHEMA).parquet(f"{tmp_path}/b"),
    )
    query = (
        joined.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
        .trigger(**ONCE).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    found = {r.request_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found["pair"].drift_tokens == 2 and found["pair"].settled_at == at(2)
    assert found["alone"].status == "force_settled" and found["alone"].settled_at == at(301)


def test_redelivery_is_dropped_and_a_late_record_is_not(spark, tmp_path):
    """The second file comes a day later and holds a record of an hour ago, which is new, and two that are not."""
    a = metered(spark, ("r", 5, 1, DONE), ("r", 5, 1, DONE), ("r", 8, 1, DONE))
    none = started(spark), usage(spark)
    drop_in(records(spark, none[0], a, none[1]), f"{tmp_path}/feed")
    later = metered(spark, ("r", 8, 1, DONE), ("r", 5, 1, DONE), ("q", 3, 1, DONE), ("z", 86_400, 1, DONE))
    # the clock has not moved between the two files; after the second it is a day later
    drop_in(records(spark, none[0], later, none[1]), f"{tmp_path}/feed")
    arrived = rs.with_redelivery(rs.arrivals(events.file_feed(spark, f"{tmp_path}/feed", max_files=1)), 3_600)
    query = (
        arrived.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
        .trigger(**ONCE).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.request_id, r["at"].second, r.redelivered) for r in rows) == [
        ("q", 3, False), ("r", 5, False), ("r", 5, True), ("r", 5, True), ("r", 8, False), ("r", 8, True),
        ("z", 0, False),
    ]


def test_redelivery_is_dropped_inside_the_watermark(spark, tmp_path):
    a = metered(spark, ("r", 5, 1, DONE), ("r", 5, 1, DONE), ("r", 8, 1, DONE))
    feed = records(spark, started(spark), a, usage(spark))
    drop_in(feed, f"{tmp_path}/feed")
    arrived = rs.without_redelivery(rs.arrivals(events.file_feed(spark, f"{tmp_path}/feed")))
    query = (
        arrived.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
        .trigger(**ONCE).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def collect_stream(frame, tmp_path, mode="append"):
    query = (
        frame.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{tmp_path}/c").trigger(**ONCE).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    return frame.sparkSession.read.parquet(f"{tmp_path}/out")


def test_budget_stream_equals_replay(spark, folder, tmp_path):
    draws = view(spark, folder, "budget_draws")
    for i in range(3):
        draws.where(f"floor(event_id / 334) = {i}").coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in"
        )
    feed = spark.readStream.schema(draws.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    options = {"capacity": 500, "refill_per_second": 50.0}
    got = collect_stream(decisions.budget_stream(feed, **options), tmp_path)
    want = budget.budget_decisions(draws, **options)
    assert same(got.select(*sorted(got.columns)), want.select(*sorted(want.columns)))


def test_claim_stream(spark, tmp_path):
    log = [
        ("t", "k", "r1", 0, "claim"), ("t", "k", "r2", 10, "claim"), ("t", "k", "r1", 50, "complete"),
        ("t", "k", "r3", 50, "claim"), ("t", "j", "r4", 0, "claim"), ("t", "j", "r4", 5, "release"),
        ("t", "j", "r5", 6, "claim"), ("t", "k", "r6", 1_050, "claim"),
        ("t", "m", "r7", 0, "release"), ("t", "m", "r7", 0, "claim"), ("t", "m", "r8", 5, "claim"),
    ]
    rows = spark.createDataFrame(
        log, "tenant_id string, idempotency_key string, request_id string, t_ms bigint, event string"
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = collect_stream(decisions.claim_stream(feed, lease_ms=100, completed_ttl_ms=1_000, expire=False), tmp_path)
    assert {r.request_id: (r.outcome, r.holder) for r in got.collect()} == {
        "r1": ("claimed", "r1"), "r2": ("in_flight", "r1"), "r3": ("replay", "r1"),
        "r4": ("claimed", "r4"), "r5": ("claimed", "r5"), "r6": ("claimed", "r6"),
        "r7": ("claimed", "r7"), "r8": ("claimed", "r8"),
    }


@pytest.mark.parametrize("topics", [(S.METERED,), (S.METERED, S.USAGE)])
def test_kafka_options_need_only_the_connector(spark, topics):
    """Without the connector jar the reader fails by name, not for a wrong option."""
    with pytest.raises(Exception, match="kafka"):
        events.kafka_feed(spark, "nowhere:9092", topics, max_per_trigger=5)
