"""Settle each request from what the gateway metered and what the provider reported.

A request settles when both ledgers have arrived, in either order, or at its deadline when it
was started and the pair is still incomplete. The copy used on each side is the latest that had
arrived by then. At the deadline the sweep comes first: what arrives at that very instant is too
late, as part of a pair and as a copy. Of copies of one instant the larger total counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallybook import schemas as S
from tallybook.functions.attribution import attribution
from tallybook.operators.skew import HEAVY_KEYS, key_hash, salted_join
from tallybook.session import staged

WINDOW_SECONDS = 300
HEAVY_COPIES = 1_000

SETTLEMENT_COLUMNS = [f.name for f in S.SETTLEMENT_SCHEMA.fields]
_COUNTS = ["prompt_tokens", "completion_tokens"]
_COPY_FIELDS = [*_COUNTS, "terminal_state", "model", "tenant_id"]
_START_FIELDS = ["tenant_id", "prompt_tokens"]
_KEY = ["idempotency_key"]


def tagged(
    started: DataFrame | None, metered: DataFrame, usage: DataFrame, *, keyed: bool = False
) -> DataFrame:
    """The three feeds as one, with ``side`` S, A or B and the arrival time in ``at``.

    Idempotency keys are read only when ``keyed``.
    """
    key = _KEY if keyed else []
    sides = [
        metered.select(
            F.lit("A").alias("side"), "request_id", F.col("ended_at").alias("at"), *_COPY_FIELDS, *key
        ),
        usage.select(
            F.lit("B").alias("side"),
            "request_id",
            F.col("reported_at").alias("at"),
            *_COUNTS,
        ),
    ]
    if started is not None:
        sides.append(
            started.select(
                F.lit("S").alias("side"),
                "request_id",
                F.col("started_at").alias("at"),
                *_START_FIELDS,
                *key,
            )
        )
    feed = sides[0]
    for other in sides[1:]:
        feed = feed.unionByName(other, allowMissingColumns=True)
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return feed.where(F.col("request_id").isNotNull()).withColumns(
        {"total": total, "us": micros(F.col("at"))}
    )


def micros(at: Column) -> Column:
    """Instants as whole numbers: what is compared most stays cheap to compare."""
    return F.unix_micros(at.cast("timestamp"))


def instant(us: Column, like: DataFrame, column: str) -> Column:
    """Back to an instant of the type that ``column`` has in ``like``."""
    return F.timestamp_micros(us).cast(like.schema[column].dataType)


def _copy(side: str, *fields: str) -> Column:
    """A copy in the order of arrival; of one instant the larger total is the later one."""
    return F.when(F.col("side") == side, F.struct("us", "total", *fields))


def _first_copy(side: str, *fields: str) -> Column:
    """The copy of the first arrival, the larger total of one instant."""
    early = (-F.col("us")).alias("early")
    return F.max(F.when(F.col("side") == side, F.struct(early, "total", *fields, "us")))


def request_state(feed: DataFrame) -> DataFrame:
    """One row per request: first start, first and latest copy of each ledger and their number.

    Everything here merges, so copies of a request are combined before the one shuffle.
    """
    key = [c for c in _KEY if c in feed.columns]
    return feed.groupBy("request_id").agg(
        F.min(_copy("S", *_START_FIELDS, *key)).alias("start"),
        _first_copy("A", *_COPY_FIELDS, *key).alias("early_a"),
        F.max(_copy("A", *_COPY_FIELDS, *key)).alias("last_a"),
        F.count_if(F.col("side") == "A").alias("copies_a"),
        _first_copy("B", *_COUNTS).alias("early_b"),
        F.max(_copy("B", *_COUNTS)).alias("last_b"),
        F.count_if(F.col("side") == "B").alias("copies_b"),
    ).withColumns({"first_a": F.col("early_a.us"), "first_b": F.col("early_b.us")})


def settle_times(
    state: DataFrame, window_seconds: float = WINDOW_SECONDS, tick_seconds: float | None = None
) -> DataFrame:
    """Adds ``deadline``, ``joined`` and ``settled`` in microseconds (NULL: waits for ever).

    With ``tick_seconds`` a deadline is the next sweep tick at or after it.
    """
    deadline = F.col("start.us") + round(window_seconds * 1_000_000)
    if tick_seconds:
        deadline = deadline + F.pmod(-deadline, F.lit(round(tick_seconds * 1_000_000)))
    pair = F.when(
        F.col("first_a").isNotNull() & F.col("first_b").isNotNull(),
        F.greatest("first_a", "first_b"),
    )
    return (
        state.withColumn("deadline", deadline)
        .withColumn(
            "joined",
            F.when(F.col("deadline").isNull() | (pair < F.col("deadline")), pair),
        )
        .withColumn("settled", F.coalesce("joined", "deadline"))
    )


def in_time(us: Column) -> Column:
    """Whether a copy was there when its request settled, by ``joined`` and ``deadline``."""
    return us <= F.coalesce(F.col("joined"), F.col("deadline") - 1)


def after(at: Column, settled_at: Column, status: Column) -> Column:
    """Whether a copy came after settlement; at the deadline itself the sweep was first."""
    return F.when(status == S.FORCE_SETTLED, at >= settled_at).otherwise(at > settled_at)


@dataclass
class Reconciled:
    """What became of the requests of three feeds, all from one read of each and one shuffle.

    ``settlements`` has a row per settled request, with the billing facts a settlement drops: terminal_state,
    idempotency_key, started_at, joined_at. ``late_metered`` and ``late_usage`` are the copies of either
    ledger that came after their request had settled, with ``settled_at`` and whether it was ``forced``.
    ``started`` has the first start of each request, ``waiting`` those of them that have not settled.
    """

    settlements: DataFrame
    late_metered: DataFrame
    late_usage: DataFrame
    started: DataFrame
    waiting: DataFrame


def _copies_by_fate(
    feed: DataFrame,
    states: Callable[[DataFrame], DataFrame],
    window_seconds: float,
    as_of: Column | None,
    tick_seconds: float | None,
    late: bool,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows per request with its times, per settled request with its chosen copies ``a`` and ``b``, and per late
    copy of either side.

    The first and the latest copy of a side and their number decide nearly every request. Others are few:
    their copies alone are read again, by a filter on those requests before anything is moved, and
    where there are none the feeds are not touched a second time. Without ``late`` no late copies are
    looked for, and fewer requests are read again.
    """
    if as_of is not None:
        feed = feed.where(F.col("at") <= as_of)
    state = settle_times(states(feed), window_seconds, tick_seconds)
    if as_of is not None:
        due = F.when(F.col("deadline") <= micros(as_of), F.col("deadline"))
        state = state.withColumn("settled", F.coalesce("joined", due))
    state = staged(state, "request-state")
    joined = F.col("joined").isNotNull()
    fields = {"a": [*_COPY_FIELDS, *_KEY], "b": _COUNTS}

    def fate(side: str) -> tuple[Column, Column, Column]:
        """The chosen copy, the late ones, and whether first and latest copy leave either open."""
        early, last, count = F.col(f"early_{side}"), F.col(f"last_{side}"), F.col(f"copies_{side}")
        first = F.struct(*[early[n].alias(n) for n in ("us", "total", *fields[side])])
        begins, ends = in_time(early["us"]), in_time(last["us"])
        known = early["us"].eqNullSafe(F.col("joined")) | (count == 2)
        open_ = begins & ~ends & ~known
        after = F.array(
            F.when(~begins, first), F.when((count == 2) & ~ends & (early["us"] < last["us"]), last)
        )
        if late:
            several = (count > 2) | ((count == 2) & (early["us"] == last["us"]))
            open_ = open_ | (several & ~ends)
        return (
            F.when(ends, last).when(begins & known, first),
            F.filter(after, lambda c: c.isNotNull()),
            F.coalesce(open_, F.lit(False)),
        )

    a, late_a, open_a = fate("a")
    b, late_b, open_b = fate("b")
    open_ = open_a | (open_b if late else joined & open_b)
    times = ["start", "deadline", "joined", "settled"]
    # A generator's output is computed once. As plain columns, the choices would be spelled out again in
    # every filter that is pushed down and for every field, beyond what Spark compiles.
    decided = F.struct(
        *times,
        a.alias("a"),
        F.when(joined, b).alias("b"),
        late_a.alias("late_a"),
        late_b.alias("late_b"),
        open_.alias("_open"),
        (F.col("copies_a") + F.col("copies_b")).alias("_copies"),
    )
    settled = state.where("settled is not null").select("request_id", F.inline(F.array(decided)))
    chosen = ["request_id", *times, "a", "b"]
    clear = settled.where(~F.col("_open"))
    rows = clear.select(*chosen)
    after = [
        clear.where(F.size(f"late_{side}") > 0).select(
            "request_id", "joined", "settled", F.inline(f"late_{side}")
        )
        for side in "ab"
    ]
    unsure = staged(
        settled.where("_open").select("request_id", F.struct(*times).alias("state"), "_copies"), "unsure"
    )
    if unsure.isEmpty():
        return state, rows, *after
    heavy = (
        unsure.where(F.col("_copies") >= HEAVY_COPIES)
        .orderBy(F.col("_copies").desc(), "request_id")
        .limit(HEAVY_KEYS)
        .select(key_hash(["request_id"]).alias("_heavy"))
    )
    copies = feed.where(F.col("side") != "S")
    seen = salted_join(copies, unsure.drop("_copies"), ["request_id"], heavy=heavy)
    there = F.col("us") <= F.coalesce(F.col("state.joined"), F.col("state.deadline") - 1)
    if late:
        seen = staged(seen, "unsure-copies")
        after = [
            known.unionByName(
                seen.where((F.col("side") == side.upper()) & ~there).select(
                    "request_id", "state.joined", "state.settled", "us", "total", *fields[side]
                )
            )
            for side, known in zip("ab", after, strict=True)
        ]
    picked = (
        seen.where(there)
        .groupBy("request_id")
        .agg(
            F.max("state").alias("state"),
            F.max(_copy("A", *fields["a"])).alias("a"),
            F.max(_copy("B", *fields["b"])).alias("b"),
        )
        .select("request_id", "state.*", "a", "b")
        .withColumn("b", F.when(joined, F.col("b")))
    )
    rows = rows.unionByName(picked)
    if late:  # an open request may have nothing but late copies
        none = unsure.join(picked.select("request_id"), "request_id", "left_anti")
        rows = rows.unionByName(none.select("request_id", "state.*"), allowMissingColumns=True)
    return state, rows, *after


def reconciliation(
    started: DataFrame,
    metered: DataFrame,
    usage: DataFrame,
    *,
    window_seconds: float = WINDOW_SECONDS,
    tolerance: int = 0,
    as_of: Column | None = None,
    tick_seconds: float | None = None,
    floor: str = "zero",
    late: bool = True,
) -> Reconciled:
    """All that comes of a reconciliation; see ``reconcile`` for the options.

    Without ``late`` the copies after settlement are left out, and fewer requests are read again.
    """
    return reconcile_feed(
        tagged(started, metered, usage, keyed=True),
        window_seconds=window_seconds,
        tolerance=tolerance,
        as_of=as_of,
        tick_seconds=tick_seconds,
        floor=floor,
        late=late,
    )


def reconcile_feed(
    feed: DataFrame,
    *,
    states: Callable[[DataFrame], DataFrame] = request_state,
    window_seconds: float = WINDOW_SECONDS,
    tolerance: int = 0,
    as_of: Column | None = None,
    tick_seconds: float | None = None,
    floor: str = "zero",
    late: bool = True,
) -> Reconciled:
    """The same for feeds that are one already (``tagged`` with keys).

    ``states`` gives the state of each request of the feed; a stored feed has a way without a shuffle.
    """
    state, rows, late_a, late_b = _copies_by_fate(
        feed, states, window_seconds, as_of, tick_seconds, late
    )
    joined = F.col("joined").isNotNull()
    unseen = F.lit(0).cast("bigint") if floor == "zero" else F.col("start.prompt_tokens")
    settled_at = instant(F.col("settled"), feed, "at").alias("settled_at")
    started_at = instant(F.col("start.us"), feed, "at").alias("started_at")
    settlements = rows.select(
        "request_id",
        F.when(joined, F.col("a.tenant_id")).otherwise(F.col("start.tenant_id")).alias("tenant_id"),
        F.coalesce("a.model", F.lit(S.UNKNOWN_MODEL)).alias("model"),
        F.coalesce(F.col("a.prompt_tokens") + F.col("a.completion_tokens"), unseen).alias("metered_total"),
        (F.col("b.prompt_tokens") + F.col("b.completion_tokens")).alias("provider_total"),
        settled_at,
        F.col("a.terminal_state").alias("terminal_state"),
        F.coalesce("a.idempotency_key", "start.idempotency_key").alias("idempotency_key"),
        started_at,
        instant(F.col("joined"), feed, "at").alias("joined_at"),
    ).withColumns(
        attribution(
            F.col("metered_total"),
            F.col("provider_total"),
            F.col("terminal_state"),
            tolerance=tolerance,
        )
    )
    facts = ["terminal_state", "idempotency_key", "started_at", "joined_at"]

    def records(copies: DataFrame, at: str, columns: list[str]) -> DataFrame:
        """Late copies as records of their ledger."""
        arrived = instant(F.col("us"), feed, "at").alias(at)
        return copies.select("request_id", *columns, arrived, (~joined).alias("forced"), settled_at)

    begun = state.where("start is not null").select("request_id", "start.tenant_id", started_at, "settled")
    return Reconciled(
        settlements.select(*SETTLEMENT_COLUMNS, *facts),
        records(late_a, "ended_at", [*_COPY_FIELDS, *_KEY]),
        records(late_b, "reported_at", _COUNTS),
        begun.drop("settled"),
        begun.where("settled is null").drop("settled"),
    )


def reconcile(
    started: DataFrame,
    metered: DataFrame,
    usage: DataFrame,
    *,
    window_seconds: float = WINDOW_SECONDS,
    tolerance: int = 0,
    as_of: Column | None = None,
    tick_seconds: float | None = None,
    floor: str = "zero",
    detail: bool = False,
) -> DataFrame:
    """One settlement per request.

    ``as_of`` gives the ledger as it stood at that time. ``floor='prompt'`` bills the prompt of a
    request whose metered record never came; the default bills nothing. ``detail`` adds the
    billing facts the settlement drops: terminal_state, idempotency_key, started_at, joined_at.
    """
    rows = reconciliation(
        started,
        metered,
        usage,
        window_seconds=window_seconds,
        tolerance=tolerance,
        as_of=as_of,
        tick_seconds=tick_seconds,
        floor=floor,
        late=False,
    ).settlements
    return rows if detail else rows.select(*SETTLEMENT_COLUMNS)


def attribute_pairs(
    metered: DataFrame,
    usage: DataFrame,
    *,
    tolerance: int = 0,
    duplicate_key: DataFrame | None = None,
) -> DataFrame:
    """Attribution of complete data: the latest copy of each side, whatever its time.

    ``duplicate_key`` names the requests (``request_id``) that reuse a settled key.
    """
    feed = tagged(None, metered, usage)
    if duplicate_key is not None:
        flags = duplicate_key.select(F.lit("D").alias("side"), "request_id")
        feed = feed.unionByName(flags, allowMissingColumns=True)
    state = feed.groupBy("request_id").agg(
        F.max(_copy("A", *_COPY_FIELDS)).alias("a"),
        F.max(_copy("B", *_COUNTS)).alias("b"),
        F.bool_or(F.col("side") == "D").alias("duplicate"),
    )
    rows = state.where("a is not null").select(
        "request_id",
        F.col("a.tenant_id").alias("tenant_id"),
        F.col("a.terminal_state").alias("terminal_state"),
        (F.col("a.prompt_tokens") + F.col("a.completion_tokens")).alias("metered_total"),
        (F.col("b.prompt_tokens") + F.col("b.completion_tokens")).alias("provider_total"),
        "duplicate",
    )
    return rows.withColumns(
        attribution(
            F.col("metered_total"),
            F.col("provider_total"),
            F.col("terminal_state"),
            tolerance=tolerance,
            duplicate_key=F.col("duplicate"),
        )
    ).drop("duplicate")


def buffered(state: DataFrame, settled: Column) -> DataFrame:
    """Half-joined requests: ``buffered_metered`` and ``buffered_usage`` flags.

    A metered record waits until its request settles. A report waits until then too, and one that
    comes later waits for ever.
    """
    unsettled = settled.isNull()
    return state.withColumns(
        {
            "buffered_metered": unsettled & F.col("first_a").isNotNull(),
            "buffered_usage": F.coalesce(
                F.when(unsettled, F.col("first_b").isNotNull())
                .when(F.col("joined").isNull(), F.col("last_b.us") >= settled)
                .otherwise(F.col("last_b.us") > settled),
                F.lit(False),
            ),
        }
    )


def half_joined(
    started: DataFrame,
    metered: DataFrame,
    usage: DataFrame,
    *,
    as_of: Column,
    window_seconds: float = WINDOW_SECONDS,
) -> DataFrame:
    """How many requests wait with only one ledger at ``as_of``, by side."""
    feed = tagged(started, metered, usage).where(F.col("at") <= as_of)
    state = settle_times(request_state(feed), window_seconds)
    by_now = F.when(F.col("settled") <= micros(as_of), F.col("settled"))
    flags = buffered(state, by_now)
    counts = flags.agg(
        F.count_if("buffered_metered").alias("metered"), F.count_if("buffered_usage").alias("usage")
    )
    return counts.select(
        F.explode(F.create_map(F.lit("metered"), "metered", F.lit("usage"), "usage")).alias(
            "side", "buffered"
        )
    )


def orphan_usage(metered: DataFrame, usage: DataFrame) -> DataFrame:
    """Reports of requests the gateway has no record of."""
    state = request_state(tagged(None, metered, usage))
    return state.where("first_a is null").select(
        "request_id",
        (F.col("last_b.prompt_tokens") + F.col("last_b.completion_tokens")).alias("provider_total"),
        instant(F.col("first_b"), usage, "reported_at").alias("first_reported_at"),
    )


def sweep(
    started: DataFrame,
    metered: DataFrame,
    usage: DataFrame,
    *,
    as_of: Column,
    window_seconds: float = WINDOW_SECONDS,
    **options,
) -> DataFrame:
    """The settlements forced by ``as_of``."""
    return reconcile(
        started, metered, usage, as_of=as_of, window_seconds=window_seconds, **options
    ).where(F.col("status") == S.FORCE_SETTLED)


def after_settlement(
    rows: DataFrame, settlements: DataFrame, at: str, *, status: str | None = None
) -> DataFrame:
    """Copies of either ledger that came after their request had settled."""
    settled = settlements.select("request_id", "status", "settled_at")
    if status is not None:
        settled = settled.where(F.col("status") == status)
    return salted_join(rows, settled, ["request_id"]).where(
        after(F.col(at), F.col("settled_at"), F.col("status"))
    )


def late_usage(
    usage: DataFrame, settlements: DataFrame, *, include_joined: bool = False
) -> DataFrame:
    """Reports that came after the sweep had settled their request."""
    late = after_settlement(
        usage, settlements, "reported_at", status=None if include_joined else S.FORCE_SETTLED
    )
    return late.select(
        "request_id",
        "status",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("provider_total"),
        "reported_at",
        "settled_at",
    )


def duplicates_absorbed(metered: DataFrame, settlements: DataFrame) -> DataFrame:
    """Metered copies absorbed because their request had settled, by tenant."""
    return (
        after_settlement(metered, settlements, "ended_at")
        .groupBy("tenant_id")
        .agg(F.count("*").alias("absorbed"))
    )
