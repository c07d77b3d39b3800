"""Streaming reconciliation: hold one ledger until its partner arrives or the deadline passes.

The three feeds become one stream with one watermark, so a silent side never stops the clock of the
other. State in RocksDB is one small record per request and, until it settles, its copies by arrival time; an
event-time timer settles a request at its deadline, and fires only once all input up to that time has been read.

No row is dropped. The watermark only moves the timers: rows behind it still reach the state, where
they join a request that has not settled and are listed as absorbed or late otherwise. Records that
cannot be decoded go to the quarantine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tallybook import schemas as S
from tallybook.functions.attribution import attribution
from tallybook.operators.reconcile import SETTLEMENT_COLUMNS, WINDOW_SECONDS
from tallybook.sources.events import decode_all

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTLEMENT = "settlement"
STARTED = "started"
ABSORBED = "absorbed"
LATE_USAGE = "late_usage"
ORPHAN = "orphan"
QUARANTINE = "quarantine"
TICK = "T"

ORPHAN_SECONDS = 7 * 86_400

_OUTCOME = (
    "kind string, request_id string, tenant_id string, model string, terminal_state string, "
    "idempotency_key string, metered_total bigint, provider_total bigint, at_us bigint"
)

_TYPES = {"string": T.StringType(), "bigint": T.LongType()}
OUTCOME_SCHEMA = T.StructType(
    [T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in _OUTCOME.split(", ")[:-1])]
    + [T.StructField("at", T.TimestampType())]
)


def arrivals(feed: DataFrame) -> DataFrame:
    """The good records of a raw feed as ledger arrivals, from one read of it."""
    side = F.when(F.col("topic") == S.STARTED, "S").when(F.col("topic") == S.METERED, "A").otherwise("B")
    return (
        decode_all(feed)
        .where(F.col("error").isNull())
        .select(
            side.alias("side"), "request_id", "at", "tenant_id", "model", "idempotency_key",
            "prompt_tokens", "completion_tokens", "terminal_state",
        )
    )


_RECORD = (
    "start_at bigint, start_tenant string, start_key string, first_a bigint, first_b bigint, "
    "copies bigint, last bigint, settled_at bigint, forced boolean"
)
_PLACE = "side string, at bigint, number bigint"
_COPY = "total bigint, prompt bigint, state string, model string, tenant string, key string"


def quarantined(feed: DataFrame) -> DataFrame:
    """The records of a raw feed that cannot be decoded, as outcomes with their value and error."""
    return (
        decode_all(feed)
        .where(F.col("error").isNotNull())
        .select(F.lit(QUARANTINE).alias("kind"), "request_id", "topic", "value", "error")
    )


def _processor(window_us: int, retain_us: int, orphan_us: int, at_once: bool):
    """The per-request state machine. Built inside a function so that it travels by value.

    Every call to the state store leaves the Python process, so a request's record is read once and written
    once per trigger, and copies are written only if their request goes on waiting.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    unknown_model, force_settled, tick = S.UNKNOWN_MODEL, S.FORCE_SETTLED, TICK
    fields = [field.split()[0] for field in _RECORD.split(", ")]
    hold = 4_096  # copies of one trigger that are held before they go to the state

    class Settler(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.record = handle.getValueState("record", _RECORD)
            self.copies = handle.getMapState("copies", _PLACE, _COPY)

        def handleInitialState(self, key, initialState, timerValues):
            """A request that a stored ledger has settled: nothing of it is held but that."""
            record = dict.fromkeys(fields)
            record.update(
                settled_at=initialState.at_us, forced=initialState.forced, copies=0, last=initialState.at_us
            )
            self._save(record)

        def handleInputRows(self, key, rows, timerValues):
            record, request, fresh, elsewhere = self._load(), key[0], [], None
            for row in rows:
                if row.side == tick:
                    continue
                record["last"] = max(record["last"] or row.at_us, row.at_us)
                if row.side == "S":
                    yield from _start(request, record, row)
                elif row.side == "X":
                    if elsewhere is None or row.at_us < elsewhere.at_us:
                        elsewhere = row
                else:
                    side = row.side.lower()
                    copy = (
                        row.total, row.prompt, row.terminal_state, row.model, row.tenant_id,
                        row.idempotency_key,
                    )
                    if record["settled_at"] is not None:
                        yield _left_over(request, side, row.at_us, copy)
                        continue
                    first = record[f"first_{side}"]
                    record[f"first_{side}"] = row.at_us if first is None else min(first, row.at_us)
                    fresh.append((side, row.at_us, copy))
                    if len(fresh) >= hold:
                        yield from self._keep(request, record, fresh)
                        fresh = []
            if record["last"] is None:
                return  # nothing but ticks
            if record["settled_at"] is None and elsewhere is not None:
                yield from self._elsewhere(request, record, elsewhere, fresh)
            elif record["settled_at"] is None and at_once and _joined(record) is not None:
                yield from self._settle(request, record, fresh)
            elif record["settled_at"] is None:
                yield from self._keep(request, record, fresh)
            self._save(record)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            record, request = self._load(), key[0]
            now = expiredTimerInfo.getExpiryTimeInMs()
            if record["last"] is None or _due(record) > now:
                return  # another timer is set
            if record["settled_at"] is not None:
                self.record.clear()
                return
            if record["start_at"] is None and _joined(record) is None:
                # nobody started it and its pair never came
                yield _orphan(request, self._stored(record))
                self.copies.clear()
                self.record.clear()
                return
            yield from self._settle(request, record, [])
            self._save(record)

        def close(self):
            pass

        def _load(self):
            stored = self.record.get()
            record = dict(zip(fields, stored or (None,) * len(fields), strict=True))
            record["copies"] = record["copies"] or 0
            return record

        def _save(self, record):
            self.record.update(tuple(record[f] for f in fields))
            self.handle.registerTimer(_due(record))

        def _keep(self, request, record, fresh):
            """Copies go to the state, unless it is known that they are too late."""
            deadline = _deadline(record)
            for side, at_us, copy in fresh:
                if deadline is not None and at_us >= deadline:
                    yield _left_over(request, side, at_us, copy)
                else:
                    self.copies.updateValue((side, at_us, record["copies"]), copy)
                    record["copies"] += 1

        def _stored(self, record):
            if record["copies"]:
                for place, copy in self.copies.iterator():
                    yield place[0], place[1], tuple(copy)

        def _settle(self, request, record, fresh):
            """The settlement on the latest copies there in time; all others are left over."""
            joined = _joined(record)
            settled = _deadline(record) if joined is None else joined
            last = settled if joined is not None else settled - 1
            best = {}
            for copies in (self._stored(record), fresh):
                for side, at_us, copy in copies:
                    if at_us > last:
                        yield _left_over(request, side, at_us, copy)
                    elif side not in best or _order(at_us, copy) > best[side][0]:
                        best[side] = (_order(at_us, copy), copy)
            a = best["a"][1] if "a" in best else (0, None, None, unknown_model, None, None)
            if joined is None:
                a = (*a[:4], record["start_tenant"], a[5] if "a" in best else record["start_key"])
            total = best["b"][1][0] if joined is not None else None
            yield _outcome(SETTLEMENT, request, settled, a, total)
            self._forget(record, settled, joined is None)

        def _elsewhere(self, request, record, row, fresh):
            """Settled by another writer: copies of it that came after are left over, the others its own."""
            forced = row.terminal_state == force_settled
            for copies in (self._stored(record), fresh):
                for side, at_us, copy in copies:
                    if at_us > row.at_us or (forced and at_us == row.at_us):
                        yield _left_over(request, side, at_us, copy)
            self._forget(record, row.at_us, forced)

        def _forget(self, record, settled, forced):
            if record["copies"]:
                self.copies.clear()
            last = record["last"]
            record.update(dict.fromkeys(fields), copies=0, last=last, settled_at=settled, forced=forced)

    def _start(request, record, row):
        """The earliest start of a request counts."""
        if record["settled_at"] is not None:
            return
        if record["start_at"] is None:
            blank = (None, None, None, row.model, row.tenant_id, row.idempotency_key)
            yield _outcome(STARTED, request, row.at_us, blank, None)
        mine = (row.at_us, row.tenant_id, row.idempotency_key)
        if record["start_at"] is None or row.at_us < record["start_at"]:
            record.update(zip(("start_at", "start_tenant", "start_key"), mine, strict=True))

    def _deadline(record):
        return None if record["start_at"] is None else record["start_at"] + window_us

    def _joined(record):
        """The instant at which both ledgers are there, if that is before the deadline."""
        if record["first_a"] is None or record["first_b"] is None:
            return None
        pair, deadline = max(record["first_a"], record["first_b"]), _deadline(record)
        return pair if deadline is None or pair < deadline else None

    def _due(record):
        """When the clock has to look at a request again, in milliseconds."""
        if record["settled_at"] is not None:
            return _ms(max(record["settled_at"], record["last"]) + retain_us)
        joined = _joined(record)
        if joined is not None:
            return _ms(joined + 1)
        if record["start_at"] is not None:
            return _ms(_deadline(record))
        return _ms(record["last"] + orphan_us)

    def _order(at_us, copy):
        """Of copies of one instant the larger total is the later one, as in batch."""
        total, prompt, *named = copy[:5]
        least = -(1 << 63)
        return (at_us, total if total is not None else least, prompt if prompt is not None else least,
                *((n is not None, n or "") for n in named))

    def _left_over(request, side, at_us, copy):
        if side == "a":
            return _outcome(ABSORBED, request, at_us, copy, None)
        return _outcome(LATE_USAGE, request, at_us, (None,) * 6, copy[0])

    def _orphan(request, copies):
        latest = {}
        for side, at_us, copy in copies:
            if side not in latest or _order(at_us, copy) > latest[side][0]:
                latest[side] = (_order(at_us, copy), at_us, copy)
        _, at_us, copy = latest.get("a") or latest["b"]
        a = copy if "a" in latest else (None,) * 6
        return _outcome(ORPHAN, request, at_us, a, latest["b"][2][0] if "b" in latest else None)

    def _ms(at_us):
        return -(-at_us // 1000)

    def _outcome(kind, request, at_us, copy, provider_total):
        total, _, state, model, tenant, key = copy
        return Row(
            kind=kind, request_id=request, tenant_id=tenant, model=model, terminal_state=state,
            idempotency_key=key, metered_total=total, provider_total=provider_total, at_us=at_us,
        )

    return Settler()


def settled_elsewhere(settlements: DataFrame) -> DataFrame:
    """Settlements another writer made, as arrivals: what is held of their requests is evicted."""
    blank = [F.lit(None).cast("string").alias(n) for n in ("tenant_id", "model", "idempotency_key")]
    counts = [F.lit(None).cast("bigint").alias(n) for n in ("prompt_tokens", "completion_tokens")]
    return settlements.select(
        F.lit("X").alias("side"),
        "request_id",
        F.col("settled_at").cast("timestamp").alias("at"),
        *blank,
        *counts,
        F.col("status").alias("terminal_state"),
    )


def settle_stream(
    arrived: DataFrame,
    *,
    window_seconds: float = WINDOW_SECONDS,
    watermark: str | None = None,
    clock: str = "event",
    settle: str = "pair",
    retain_seconds: float | None = None,
    orphan_seconds: float = ORPHAN_SECONDS,
    ledger: DataFrame | None = None,
) -> DataFrame:
    """Outcomes of a stream of ledger arrivals.

    These are starts, settlements, absorbed copies, late reports and orphans. ``watermark`` is the
    disorder that deadlines wait for, one window unless given.

    ``settle='pair'`` settles as soon as both ledgers are there, on the copies that had arrived by the later of
    the two. ``settle='watermark'`` settles once all input up to that instant has been read; then the
    order in which rows come inside the watermark changes nothing, and the result is that of a batch.

    ``clock='processing'`` moves the clock by ticks alone (``gate.SweepGate``): wall-clock time that passes
    only while no input is left unread.

    A settled request is remembered for ``retain_seconds`` after its last row (one window unless given) and
    then forgotten. A record nobody started is kept for ``orphan_seconds`` and then listed as an orphan.
    ``ledger`` holds settlements (request_id, settled_at, status) the stream starts from, usually those of the
    last retention: their requests are settled, and copies of them are absorbed.
    """
    if settle not in ("pair", "watermark") or clock not in ("event", "processing"):
        raise ValueError("settle is 'pair' or 'watermark', clock is 'event' or 'processing'")
    spark = arrived.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.col("at").cast("timestamp")
    rows = arrived.select(
        "request_id",
        "side",
        (at if clock == "event" else F.when(F.col("side") == TICK, at).otherwise(F.timestamp_seconds(F.lit(0)))).alias("at"),
        F.unix_micros(at).alias("at_us"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total"),
        F.col("prompt_tokens").alias("prompt"),
        "terminal_state",
        "model",
        "tenant_id",
        "idempotency_key",
    )
    rows = rows.withWatermark("at", watermark or f"{int(window_seconds)} seconds")
    # without the watermark's column Spark has nothing to call late, so every row reaches the state; ticks
    # do too, as a filter on them would be moved to before the watermark
    rows = rows.drop("at")
    window_us = int(window_seconds * 1_000_000)
    retain_us = int((retain_seconds or window_seconds) * 1_000_000)
    known = None
    if ledger is not None:
        known = ledger.select(
            "request_id",
            F.unix_micros(F.col("settled_at").cast("timestamp")).alias("at_us"),
            (F.col("status") == S.FORCE_SETTLED).alias("forced"),
        ).groupBy("request_id")
    outcomes = rows.groupBy("request_id").transformWithState(
        statefulProcessor=_processor(
            window_us, retain_us, int(orphan_seconds * 1_000_000), settle == "pair"
        ),
        outputStructType=_OUTCOME,
        outputMode="append",
        timeMode="EventTime",
        initialState=known,
    )
    return outcomes.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")


def settlements_of(outcomes: DataFrame, *, tolerance: int = 0) -> DataFrame:
    """Settlement rows of a stream's outcomes, attributed by the same rule as in batch."""
    return (
        outcomes.where(F.col("kind") == SETTLEMENT)
        .withColumns(
            attribution(
                F.col("metered_total"),
                F.col("provider_total"),
                F.col("terminal_state"),
                tolerance=tolerance,
            )
        )
        .withColumnRenamed("at", "settled_at")
        .select(*SETTLEMENT_COLUMNS)
    )


def with_redelivery(arrived: DataFrame, remember_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Arrivals with ``redelivered``: whether the same record came before, within ``remember_seconds``.

    What was seen is state that a timer clears once the clock is ``remember_seconds`` past the record and its
    arrival. The watermark moves the timers only: a record that comes late is kept like any other, and
    repeats are marked and not lost.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    arrived.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names, keep_ms = [c for c in arrived.columns if c != "at"], int(remember_seconds * 1000)
    fields = [f for f in arrived.schema.fields if f.name != "at"]

    class Seen(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.seen = handle.getValueState("seen", "until bigint")

        def handleInputRows(self, key, rows, timerValues):
            before = self.seen.exists()
            for row in rows:
                yield Row(**{n: row[n] for n in names}, at_us=row.at_us, redelivered=before)
                before = True
            now = max(key[2] // 1000, timerValues.getCurrentWatermarkInMs())
            self.seen.update((now + keep_ms,))
            self.handle.registerTimer(now + keep_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            until = self.seen.get()
            if until is not None and until[0] <= expiredTimerInfo.getExpiryTimeInMs():
                self.seen.clear()
            yield from ()

        def close(self):
            pass

    rows = arrived.withColumn("at_us", F.unix_micros("at")).withWatermark("at", "0 seconds").drop("at")
    marked = rows.groupBy("request_id", "side", "at_us").transformWithState(
        statefulProcessor=Seen(),
        outputStructType=T.StructType(
            [*fields, T.StructField("at_us", T.LongType()), T.StructField("redelivered", T.BooleanType())]
        ),
        outputMode="append",
        timeMode="EventTime",
    )
    at = F.timestamp_micros("at_us").alias("at")
    return marked.select(*[at if c == "at" else c for c in arrived.columns], "redelivered")


def without_redelivery(arrived: DataFrame, remember_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Drop second deliveries, where they need not be counted."""
    rows = with_redelivery(arrived, remember_seconds)
    return rows.where(~F.col("redelivered")).drop("redelivered")


def interval_join(
    metered: DataFrame,
    usage: DataFrame,
    *,
    window_seconds: int = WINDOW_SECONDS,
    watermark: str = "10 seconds",
    tolerance: int = 0,
) -> DataFrame:
    """The join as a stream-stream outer join, for feeds with one copy of each record.

    A metered record pairs with a report within ``window_seconds`` of it, and is settled alone when
    none can come any more. With the default watermark policy a silent report feed holds those
    back; set ``spark.sql.streaming.multipleWatermarkPolicy`` to ``max`` to let time move on.
    """
    a = metered.withColumn("a_at", F.col("ended_at").cast("timestamp")).withWatermark(
        "a_at", watermark
    ).alias("a")
    b = usage.withColumn("b_at", F.col("reported_at").cast("timestamp")).withWatermark(
        "b_at", watermark
    ).alias("b")
    near = F.expr(
        f"a.request_id = b.request_id AND b_at <= a_at + INTERVAL {window_seconds} SECOND "
        f"AND b_at >= a_at - INTERVAL {window_seconds} SECOND"
    )
    rows = a.join(b, near, "leftOuter").select(
        F.col("a.request_id").alias("request_id"),
        F.col("a.tenant_id").alias("tenant_id"),
        F.col("a.model").alias("model"),
        (F.col("a.prompt_tokens") + F.col("a.completion_tokens")).alias("metered_total"),
        (F.col("b.prompt_tokens") + F.col("b.completion_tokens")).alias("provider_total"),
        F.col("a.terminal_state").alias("terminal_state"),
        F.when(F.col("b_at").isNotNull(), F.greatest("a_at", "b_at"))
        .otherwise(F.expr(f"a_at + INTERVAL {window_seconds} SECOND"))
        .alias("settled_at"),
    )
    return rows.withColumns(
        attribution(
            F.col("metered_total"),
            F.col("provider_total"),
            F.col("terminal_state"),
            tolerance=tolerance,
        )
    ).select(*SETTLEMENT_COLUMNS)
