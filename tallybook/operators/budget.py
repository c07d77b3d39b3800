"""Replay token-bucket decisions over a log of draws.

A bucket refills lazily up to its capacity, grants a draw whole or not at all, and remembers the
time of the draw even when it refuses. Each decision depends on every earlier draw of the tenant, yet no
task reads a whole log: time is cut into slices that are replayed side by side to a fixed point.

Every slice is first replayed from a full bucket. Then one row per slice carries levels from slice to slice; a
slice whose level at its first draw is not the one it was replayed from runs again, until none has to.
The first slice starts right, so each round makes at least one more slice right; in fact two or three rounds
do. A bucket that has been full once forgets where it began. One that never is full keeps of its
beginning only the fraction of a token: draws are whole tokens, so two replays that differ by whole tokens
meet after some disagreements and stay together. The carried level is therefore a slice's last end
moved to the fraction that refills since its true beginning give, and saturated tenants settle as fast as others.
Where slices hold too few draws for that, the tenants that have not settled after ``ROUNDS`` rounds begin
again with slices ``WIDER`` times as wide, so the number of rounds grows with the logarithm of the log's length.

``cut_streams`` does the same where a refusal cuts its stream: what a slice starts from is a level and the
streams cut before it, which are rows that its draws are joined with.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, functions as F

from tallybook.operators.skew import by_key
from tallybook.session import staged

SLICE_DRAWS = 262_144
CAPACITY = 200_000
REFILL_PER_SECOND = 50.0
ROUNDS = 3
WIDER = 64

KEY = ["tenant_id", "slice"]
RUN = (
    "tenant_id string, slice bigint, first_ms bigint, last_ms bigint, start bigint, stop bigint, "
    "clamped boolean, request_id string"
)


def _units(capacity: int, refill_per_second: float) -> tuple[int, int, int]:
    """Units per token, capacity and refill per millisecond in units, all whole numbers."""
    rate = Fraction(refill_per_second).limit_denominator(1_000_000) / 1000
    unit = lcm(1000, rate.denominator)
    return unit, capacity * unit, int(rate * unit)


def budget_decisions(
    draws: DataFrame,
    *,
    capacity: int = CAPACITY,
    refill_per_second: float = REFILL_PER_SECOND,
    order: str = "event_id",
    slice_ms: int | None = None,
) -> DataFrame:
    """``granted`` and ``remaining`` whole tokens for each draw.

    Draws are rows (tenant_id, now_ms, tokens, ``order``); ``order`` breaks ties of now_ms. A draw of
    nothing is granted without touching the bucket. A slice is ``slice_ms`` long, or as long as
    ``SLICE_DRAWS`` draws of the densest tenant take. Where no tenant has more, one pass decides all.
    """
    bucket = _units(capacity, refill_per_second)
    fields = dict(draws.dtypes)
    log = draws.select(
        "tenant_id",
        F.col("now_ms").alias("at_ms"),
        F.col(order).alias("tie"),
        "tokens",
        F.lit(None).cast("string").alias("request_id"),
        F.lit(False).alias("gone"),
    )
    log, slice_ms = _sliced(log, slice_ms)
    if slice_ms is None:
        return _decisions(log, None, bucket, capacity, fields, order)
    touching = log.where("tokens > 0")
    runs, rounds, wider = staged(_runs(touching, None, bucket), "slice-runs"), 0, None
    while True:
        starts = staged(_starts(runs, bucket), "slice-starts")
        again = starts.where("changed")
        if again.isEmpty():
            break
        if rounds == ROUNDS:
            unsettled = staged(again.select("tenant_id").distinct(), "unsettled")
            wider = budget_decisions(
                draws.join(unsettled, "tenant_id", "left_semi"),
                capacity=capacity, refill_per_second=refill_per_second, order=order, slice_ms=slice_ms * WIDER,
            )
            log, starts = (x.join(unsettled, "tenant_id", "left_anti") for x in (log, starts))
            break
        rounds += 1
        redone = _runs(touching.join(again.select(*KEY), KEY, "left_semi"), again, bucket)
        runs = staged(
            runs.join(again.select(*KEY), KEY, "left_anti").unionByName(redone), "slice-runs"
        )
    decided = _decisions(log, starts, bucket, capacity, fields, order)
    return decided if wider is None else decided.unionByName(wider)


def _decisions(log, starts, bucket, capacity, fields, order) -> DataFrame:
    decided = _by_slice(log, starts).mapInPandas(
        _replay(*bucket, capacity, cuts=False),
        f"tenant_id string, tie {fields[order]}, at_ms bigint, tokens {fields['tokens']}, request_id string, "
        "granted boolean, remaining bigint",
    )
    return decided.select(
        "tenant_id", F.col("tie").alias(order), F.col("at_ms").alias("now_ms"), "tokens", "granted",
        "remaining",
    )


def _sliced(log: DataFrame, slice_ms: int | None) -> tuple[DataFrame, int | None]:
    """The log with its slices and their length; None if every tenant is one slice."""
    if slice_ms is None:
        tenants = log.groupBy("tenant_id").agg(
            F.count(F.lit(1)).alias("n"), (F.max("at_ms") - F.min("at_ms") + 1).alias("ms")
        )
        most = tenants.agg(F.max("n").alias("n"), F.max(F.col("n") / F.col("ms")).alias("density")).first()
        if most.n is None or most.n <= SLICE_DRAWS:
            return log.withColumn("slice", F.lit(0).cast("bigint")), None
        slice_ms = max(1, int(SLICE_DRAWS / most.density))
    return log.withColumn("slice", F.floor(F.col("at_ms") / slice_ms)), slice_ms


def cut_streams(
    draws: DataFrame,
    *,
    capacity: int = CAPACITY,
    refill_per_second: float = REFILL_PER_SECOND,
    slice_ms: int | None = None,
) -> DataFrame:
    """Decide the draws of streams; a refusal cuts its stream, so later draws of it never happen.

    Draws are rows (tenant_id, request_id, seq, arrived_ms, tokens). Admissions are draws of the same
    bucket: give them with a seq below 0 (``metering.admission_draws``), and a refused one means that
    the stream never runs. A task keeps the streams cut in its own slice; those cut before are rows.
    """
    bucket = _units(capacity, refill_per_second)
    fields = dict(draws.dtypes)
    log = staged(
        draws.select(
            "tenant_id",
            F.col("arrived_ms").alias("at_ms"),
            F.col("seq").alias("tie"),
            "tokens",
            "request_id",
        ),
        "stream-draws",
    )
    log, slice_ms = _sliced(log, slice_ms)
    if slice_ms is None:
        return _cuts(log.withColumn("gone", F.lit(False)), None, bucket, capacity, fields)
    there = log.groupBy(*KEY, "request_id").agg(F.count(F.lit(1)).alias("n"))
    # only a stream with draws in several slices can have been cut before one of them
    long = there.groupBy("tenant_id", "request_id").agg(F.collect_list("slice").alias("slices"))
    long = staged(long.where(F.size("slices") > 1), "long-streams")
    every = _runs(log.withColumn("gone", F.lit(False)), None, bucket)
    runs = staged(every.withColumn("before", F.lit(0).cast("bigint")), "slice-runs")
    rounds, wider = 0, None
    while True:
        cut = (
            runs.where("request_id is not null")
            .groupBy("tenant_id", "request_id")
            .agg(F.min("slice").alias("cut_in"))
            .join(long.select("tenant_id", "request_id"), ["tenant_id", "request_id"], "left_semi")
        )
        cut = staged(cut, "cut-streams")
        # what each slice has to do without, as one number
        before = (
            long.join(cut, ["tenant_id", "request_id"])
            .select("tenant_id", "request_id", "cut_in", F.explode("slices").alias("slice"))
            .where("slice > cut_in")
            .groupBy(*KEY)
            .agg(F.bit_xor(F.xxhash64("request_id")).alias("now_before"))
        )
        held = runs.where("request_id is null").select(*KEY, "before")
        starts = (
            _starts(runs.where("request_id is null"), bucket)
            .join(held, KEY)
            .join(before, KEY, "left")
            .withColumn("before_", F.coalesce("now_before", F.lit(0).cast("bigint")))
            .withColumn("changed", F.col("changed") | (F.col("before_") != F.col("before")))
            .select(*KEY, "first_ms", "entry", "changed", F.col("before_").alias("before"))
        )
        starts = staged(starts, "slice-starts")
        again = starts.where("changed")
        if again.isEmpty():
            break
        if rounds == ROUNDS:
            unsettled = staged(again.select("tenant_id").distinct(), "unsettled")
            wider = cut_streams(
                draws.join(unsettled, "tenant_id", "left_semi"),
                capacity=capacity, refill_per_second=refill_per_second, slice_ms=slice_ms * WIDER,
            )
            log, starts = (x.join(unsettled, "tenant_id", "left_anti") for x in (log, starts))
            break
        rounds += 1
        some = _without_cut(log.join(again.select(*KEY), KEY, "left_semi"), cut)
        redone = _runs(some, again, bucket).join(again.select(*KEY, "before"), KEY)
        runs = staged(
            runs.join(again.select(*KEY), KEY, "left_anti").unionByName(redone), "slice-runs"
        )
    decided = _cuts(_without_cut(log, cut), starts, bucket, capacity, fields)
    return decided if wider is None else decided.unionByName(wider)


def _cuts(log, starts, bucket, capacity, fields) -> DataFrame:
    decided = _by_slice(log, starts).mapInPandas(
        _replay(*bucket, capacity, cuts=True),
        f"tenant_id string, tie {fields['seq']}, at_ms bigint, tokens {fields['tokens']}, "
        "request_id string, granted boolean, remaining bigint",
    )
    return decided.select(
        "tenant_id", "request_id", F.col("tie").alias("seq"), F.col("at_ms").alias("arrived_ms"), "tokens",
        "granted", "remaining",
    )


def _without_cut(log: DataFrame, cut: DataFrame) -> DataFrame:
    """The draws with ``gone`` set where their stream was cut in an earlier slice."""
    met = log.join(cut, ["tenant_id", "request_id"], "left")
    gone = F.coalesce(F.col("slice") > F.col("cut_in"), F.lit(False))
    return met.select(*log.columns, gone.alias("gone"))


def _by_slice(log: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Draws in order by slice; a slice is led by a row with the level it starts from."""
    rows = log.select("*", F.lit(1).alias("row"), F.lit(-1).cast("bigint").alias("entry"))
    if starts is not None:
        heads = starts.select(
            *KEY, F.col("first_ms").alias("at_ms"), "entry", F.lit(0).alias("row"),
            F.lit(0).cast(dict(log.dtypes)["tokens"]).alias("tokens"), F.lit(False).alias("gone"),
        )
        rows = rows.unionByName(heads, allowMissingColumns=True)
    return by_key(rows, *KEY).sortWithinPartitions(*KEY, "row", "at_ms", "request_id", "tie")


def _runs(log: DataFrame, starts: DataFrame | None, bucket: tuple[int, int, int]) -> DataFrame:
    """One row per slice with the levels it starts and stops at, and one for each stream it cuts.

    Without ``starts`` every slice starts full; with them, draws of a slice that is not named are left out.
    """
    rows = _by_slice(log, starts).drop("tie")
    return rows.mapInPandas(_summary(*bucket), RUN)


def _starts(runs: DataFrame, bucket: tuple[int, int, int]) -> DataFrame:
    """The level each slice has to start from, as far as it is known, and whether it did not."""
    one = runs.where("request_id is null")
    return (
        by_key(one, "tenant_id")
        .sortWithinPartitions(*KEY)
        .mapInPandas(
            _carry(*bucket),
            "tenant_id string, slice bigint, first_ms bigint, entry bigint, changed boolean",
        )
    )


def _summary(unit: int, full: int, refill: int):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        columns = [f.split()[0] for f in RUN.split(", ")]
        key, first, last, begun, level, since, clamped, cut = None, 0, 0, full, full, 0, False, set()

        def closed():
            stop = min(full, level + (last - since) * refill)
            held = clamped or stop < level + (last - since) * refill
            rows = [(*key, first, last, begun, stop, held, None)]
            return rows + [(*key, first, last, begun, stop, held, name) for name in cut]

        for batch in batches:
            done = []
            for tenant, piece, row, now, tokens, name, gone, entry in zip(
                batch["tenant_id"], batch["slice"].tolist(), batch["row"].tolist(), batch["at_ms"].tolist(),
                batch["tokens"].tolist(), batch["request_id"], batch["gone"].tolist(),
                batch["entry"].tolist(), strict=True,
            ):
                if (tenant, piece) != key:
                    if key is not None:
                        done += closed()
                    key, first, since, clamped, cut = (tenant, piece), now, now, False, set()
                    level = begun = entry if row == 0 else full
                last = now
                if row == 0 or gone or name in cut:
                    continue
                level += (now - since) * refill
                since = now
                if level > full:
                    level, clamped = full, True
                if level >= tokens * unit:
                    level -= tokens * unit
                elif name is not None:
                    cut.add(name)
            yield pd.DataFrame(done, columns=columns)
        if key is not None:
            yield pd.DataFrame(closed(), columns=columns)

    return run


def _carry(unit: int, full: int, refill: int):
    """Levels from slice to slice: exact behind slices that ran from the right level, else the best guess."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        who, level, since = None, full, 0
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if row.tenant_id != who:
                    who, level, since = row.tenant_id, full, row.first_ms
                entry = min(full, level + (row.first_ms - since) * refill)
                changed = entry != row.start
                found.append((who, row.slice, row.first_ms, entry, changed))
                level, since = row.stop, row.last_ms
                if changed and not row.clamped:
                    # the same whole tokens, with the fraction this start leads to
                    shift = (entry - row.start) % unit
                    level += shift if 2 * shift <= unit else shift - unit
                    level = level + unit if level < 0 else min(level, full)
            yield pd.DataFrame(found, columns=["tenant_id", "slice", "first_ms", "entry", "changed"])

    return run


def _replay(unit: int, full: int, refill: int, capacity: int, cuts: bool):
    """Decide the draws of each slice from its start."""

    def run(batches: Iterator) -> Iterator:
        key, level, since, cut = None, full, 0, set()
        for batch in batches:
            keep, granted, remaining = [], [], []
            for tenant, piece, row, now, tokens, name, gone, entry in zip(
                batch["tenant_id"], batch["slice"].tolist(), batch["row"].tolist(), batch["at_ms"].tolist(),
                batch["tokens"].tolist(), batch["request_id"], batch["gone"].tolist(),
                batch["entry"].tolist(), strict=True,
            ):
                if (tenant, piece) != key:
                    key, level, since, cut = (tenant, piece), entry if row == 0 else full, now, set()
                keep.append(row == 1 and not gone and not (cuts and name in cut))
                if not keep[-1]:
                    continue
                if tokens <= 0 and not cuts:
                    granted.append(True)
                    remaining.append(capacity)
                    continue
                level = min(full, level + (now - since) * refill)
                since = now
                enough = level >= tokens * unit
                if enough:
                    level -= tokens * unit
                elif cuts:
                    cut.add(name)
                granted.append(enough)
                remaining.append(level // unit)
            yield batch.loc[keep, ["tenant_id", "tie", "at_ms", "tokens", "request_id"]].assign(
                granted=granted, remaining=remaining
            )

    return run
