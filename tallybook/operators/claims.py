"""Replay idempotency claims over a log of attempts.

Attempts are rows (tenant_id, idempotency_key, request_id, t_ms, dur_ms, released, event_id). An
attempt claims a free key; one that never completes (NULL dur_ms) holds it for the lease; one that
completes keeps it for the completed TTL from then on; a released one gives it straight back. Attempts of
a key are told apart by event_id.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from tallybook.operators.skew import by_key, heavy_keys, key_hash
from tallybook.session import staged

LEASE_MS = 180_000
COMPLETED_TTL_MS = 86_400_000

CLAIMED = "claimed"
IN_FLIGHT = "in_flight"
REPLAY = "replay"

KEY = ["tenant_id", "idempotency_key"]
FIELDS = [*KEY, "event_id", "request_id", "t_ms", "dur_ms", "released"]
IN_ORDER = 1_000_000
SLICE_MS = 60_000
BEFORE_ALL, FOREVER = -(2**63), 2**63 - 1

OUTPUT = (
    "tenant_id string, idempotency_key string, event_id bigint, request_id string, "
    "outcome string, holder string"
)


def claim_outcomes(
    attempts: DataFrame,
    *,
    lease_ms: int = LEASE_MS,
    completed_ttl_ms: int = COMPLETED_TTL_MS,
    heavy_rows: int = IN_ORDER,
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """The outcome of each attempt and the request that holds the key after it.

    Keys are independent. Most are read in time order, one record in memory at a time. A key with
    more than about ``heavy_rows`` attempts is instead spread over all tasks, see ``_composed``.
    Finding those keys runs one small job; if there are any, a few more follow.
    """
    if lease_ms < 1 or completed_ttl_ms < 1:
        raise ValueError("a claim has to hold its key for a while")
    rows = attempts.select(*FIELDS)
    listed = F.broadcast(staged(heavy_keys(rows, KEY, at_least=heavy_rows), "heavy-keys"))
    if listed.isEmpty():
        return _fold_keys(rows, lease_ms, completed_ttl_ms)
    packed = rows.withColumn("_heavy", key_hash(KEY))
    light = packed.join(listed, "_heavy", "left_anti").drop("_heavy")
    heavy = staged(packed.join(listed, "_heavy", "left_semi").drop("_heavy"), "attempts")
    claims = _composed(heavy, lease_ms, completed_ttl_ms, slice_ms)
    return _fold_keys(light, lease_ms, completed_ttl_ms).unionByName(
        _outcomes(heavy, claims, lease_ms, completed_ttl_ms, slice_ms)
    )


def _fold_keys(attempts: DataFrame, lease_ms: int, completed_ttl_ms: int) -> DataFrame:
    """Each task reads its keys in time order, keeping the record of the current key."""

    def run(batches: Iterator) -> Iterator:
        import heapq

        key, holder, done, expiry, coming = None, None, False, 0, []
        for batch in batches:
            outcomes, holders = [], []
            for tenant, name, request, now, lasts, released in zip(
                batch["tenant_id"], batch["idempotency_key"], batch["request_id"],
                batch["t_ms"].tolist(), batch["dur_ms"].tolist(), batch["released"].tolist(),
                strict=True,
            ):
                if (tenant, name) != key:
                    key, holder, done, expiry, coming = (tenant, name), None, False, 0, []
                while coming and coming[0][0] <= now:
                    ended, holder = heapq.heappop(coming)
                    done, expiry = True, ended + completed_ttl_ms
                if holder is not None and now < expiry:
                    outcomes.append(REPLAY if done else IN_FLIGHT)
                    holders.append(holder)
                    continue
                outcomes.append(CLAIMED)
                holders.append(request)
                if released:
                    holder = None
                    continue
                holder, done, expiry = request, False, now + lease_ms
                if lasts == lasts and lasts is not None:
                    heapq.heappush(coming, (now + int(lasts), request))
            yield batch[["tenant_id", "idempotency_key", "event_id", "request_id"]].assign(
                outcome=outcomes, holder=holders
            )

    return (
        by_key(attempts, *KEY)
        .sortWithinPartitions(*KEY, "t_ms", "event_id")
        .mapInPandas(run, OUTPUT)
    )


def _composed(attempts: DataFrame, lease_ms: int, completed_ttl_ms: int, slice_ms: int) -> DataFrame:
    """The attempts that claim and run, of keys with very many attempts, as rows of FIELDS.

    A claim that runs decides which attempt claims next: the first one after it at which the key is free. So each
    running attempt, claim or not, points to the one that would follow it, and these steps are composed
    by doubling: from the first attempt of each key all that can be reached are its claims, after as many rounds
    as the number of claims has binary digits. No round needs the rows of a key together.

    A step is not known beforehand where a lease ran out under a request that goes on, and another
    attempt claimed meanwhile: what follows depends on all completions that are still to come. Such an
    episode is followed claim by claim from the state it begins with, for all keys at once, until
    none but the last claim's own completion is left.
    """
    running = staged(attempts.where(~F.col("released")), "running")
    ended, lapsed = F.col("t_ms") + F.col("dur_ms"), F.col("t_ms") + lease_ms
    free = F.when(ended.isNull(), lapsed).otherwise(ended + completed_ttl_ms)
    longer = F.coalesce(ended > lapsed, F.lit(False))
    after = _first_from(running, running.withColumn("from_ms", free), slice_ms)
    inside = _first_from(running, running.where(longer).withColumn("from_ms", lapsed), slice_ms)
    # a lease that ran out counts only if an attempt came before the completion
    overtaken = inside.where(F.col("next.t_ms") < ended).select(*KEY, "event_id", F.lit(True).alias("open"))
    steps = after.join(overtaken, [*KEY, "event_id"], "left").select(
        *FIELDS, F.col("next.event_id").alias("to"), F.coalesce("open", F.lit(False)).alias("open")
    )
    steps = staged(steps, "steps")
    links = steps.where("not open and to is not null").select(*KEY, "event_id", "to")

    seeds = running.groupBy(*KEY).agg(F.min(F.struct("t_ms", "event_id")).alias("f"))
    seeds = seeds.select(*KEY, "f.event_id")
    claims = None
    while True:
        reached = _reached(seeds, links)
        found = steps.join(reached, [*KEY, "event_id"]).select(*FIELDS, "open")
        claims = staged(found if claims is None else claims.unionByName(found), "claims")
        opened = found.where("open")
        if opened.isEmpty():
            return claims.drop("open")
        more, seeds = _episodes(running, opened, lease_ms, completed_ttl_ms, slice_ms)
        claims = claims.unionByName(more.withColumn("open", F.lit(False)))


def _reached(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """All event_ids that links lead to from the seeds, the seeds included; links double each round."""
    reached, jumps = staged(seeds, "reached"), links
    count = reached.count()
    while True:
        step = reached.join(jumps, [*KEY, "event_id"]).select(*KEY, F.col("to").alias("event_id"))
        grown = staged(reached.unionByName(step).distinct(), "reached")
        before, count = count, grown.count()
        if count == before:
            return reached
        reached = grown
        further = jumps.select(*KEY, F.col("event_id").alias("to"), F.col("to").alias("_beyond"))
        jumps = staged(
            jumps.join(further, [*KEY, "to"]).select(*KEY, "event_id", F.col("_beyond").alias("to")), "jumps"
        )


def _episodes(
    running: DataFrame, opened: DataFrame, lease_ms: int, completed_ttl_ms: int, slice_ms: int
) -> tuple[DataFrame, DataFrame]:
    """The claims after those in ``opened`` while completions of others are to come, and the next seeds."""
    coming = F.array(F.struct((F.col("t_ms") + F.col("dur_ms")).alias("end"), "request_id"))
    state = opened.select(*FIELDS, coming.alias("coming"))
    claims, seeds = opened.select(*FIELDS).limit(0), opened.select(*KEY, "event_id").limit(0)
    while True:
        ends = F.transform("coming", lambda c: c["end"])
        lows = F.concat(
            F.array(F.col("t_ms") + lease_ms), F.transform(ends, lambda e: e + completed_ttl_ms)
        )
        highs = F.concat(ends, F.array(F.lit(FOREVER)))
        gaps = state.select(
            *KEY, "coming", F.inline(F.arrays_zip(lows.alias("from_ms"), highs.alias("to_ms")))
        ).where("from_ms < to_ms")
        next_ = (
            _first_from(running, gaps, slice_ms)
            .where("next.t_ms < to_ms")
            .groupBy(*KEY)
            .agg(F.min("next").alias("next"), F.first("coming").alias("coming"))
        )
        now = F.col("next.t_ms")
        own = F.array(F.struct((now + F.col("next.dur_ms")).alias("end"), F.col("next.request_id")))
        others = F.filter("coming", lambda c: c["end"] > now)
        state = staged(
            next_.select(
                *KEY,
                *[F.col(f"next.{n}").alias(n) for n in FIELDS if n not in KEY],
                F.when(F.col("next.dur_ms").isNull(), others)
                .otherwise(F.array_sort(F.concat(others, own)))
                .alias("coming"),
                (F.size(others) == 0).alias("alone"),
            ),
            "episodes",
        )
        seeds = seeds.unionByName(state.where("alone").select(*KEY, "event_id"))
        state = state.where("not alone")
        if state.isEmpty():
            return claims, staged(seeds, "seeds")
        claims = staged(claims.unionByName(state.select(*FIELDS)), "episode-claims")


def _first_from(attempts: DataFrame, probes: DataFrame, slice_ms: int) -> DataFrame:
    """Each probe with ``next``, the first attempt at or after its ``from_ms``; NULL if none follows.

    Time is cut into slices: a probe meets the attempts of its own slice, and the first attempt of a
    later one is found among slices alone.
    """
    here = ["t_ms", "event_id", "request_id", "dur_ms", "released"]
    at = attempts.select(
        *KEY, F.floor(F.col("t_ms") / slice_ms).alias("_slice"), F.struct(*here).alias("_attempt")
    )
    asked = probes.select(
        *KEY, F.floor(F.col("from_ms") / slice_ms).alias("_slice"), F.struct(*probes.columns).alias("_probe")
    )
    time = F.coalesce("_probe.from_ms", "_attempt.t_ms")
    order = Window.partitionBy(*KEY, "_slice").orderBy(time, F.col("_probe").isNull(), "_attempt.event_id")
    following = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = (
        at.unionByName(asked, allowMissingColumns=True)
        .withColumn("_own", F.first("_attempt", ignorenulls=True).over(following))
        .where("_probe is not null")
    )
    firsts = at.groupBy(*KEY, "_slice").agg(F.min("_attempt").alias("_first"))
    slices = firsts.unionByName(asked.select(*KEY, "_slice").distinct(), allowMissingColumns=True)
    later = Window.partitionBy(*KEY).orderBy("_slice").rangeBetween(1, Window.unboundedFollowing)
    beyond = (
        slices.groupBy(*KEY, "_slice")
        .agg(F.max("_first").alias("_first"))
        .select(*KEY, "_slice", F.min("_first").over(later).alias("_later"))
    )
    return met.join(beyond, [*KEY, "_slice"]).select(
        *[f"_probe.{c}" for c in probes.columns], F.coalesce("_own", "_later").alias("next")
    )


def _outcomes(
    attempts: DataFrame, claims: DataFrame, lease_ms: int, completed_ttl_ms: int, slice_ms: int
) -> DataFrame:
    """Every attempt against the last claim or completion before it."""
    ended = F.col("t_ms") + F.col("dur_ms")
    claimed = claims.select(
        *KEY, F.col("t_ms").alias("from_ms"), F.col("event_id").alias("from_id"),
        F.col("request_id").alias("holding"), F.lit(False).alias("done"),
        (F.col("t_ms") + lease_ms).alias("expiry"),
    )
    # a completion comes before the attempts of its instant; of several, the last by request counts
    completed = (
        claims.where(ended.isNotNull())
        .groupBy(*KEY, ended.alias("from_ms"))
        .agg(F.max("request_id").alias("holding"))
        .select(
            *KEY, "from_ms", F.lit(BEFORE_ALL).alias("from_id"), "holding", F.lit(True).alias("done"),
            (F.col("from_ms") + completed_ttl_ms).alias("expiry"),
        )
    )
    matched = _held_at(attempts, claimed.unionByName(completed), slice_ms)
    # the claim that an attempt makes is written at its own place and is not yet there for it
    busy = F.coalesce(F.col("t_ms") < F.col("expiry"), F.lit(False))
    return matched.select(
        *KEY,
        "event_id",
        "request_id",
        F.when(~busy, CLAIMED).when(F.col("done"), REPLAY).otherwise(IN_FLIGHT).alias("outcome"),
        F.when(busy, F.col("holding")).otherwise(F.col("request_id")).alias("holder"),
    )


def _held_at(attempts: DataFrame, held: DataFrame, slice_ms: int) -> DataFrame:
    """Each attempt with the record that was written last before it.

    Time is cut into slices. The record a slice starts from is found among records and slices alone;
    attempts meet only the records of their own slice and that one, in order.
    """
    at = Window.partitionBy(*KEY, "_slice").orderBy("t_ms", "event_id", "_write")
    before = Window.partitionBy(*KEY).orderBy("_slice", "_first", "t_ms", "event_id")
    piece = F.floor(F.col("t_ms") / slice_ms).alias("_slice")
    rows = attempts.select(*FIELDS, piece)
    writes = held.select(
        *KEY, F.col("from_ms").alias("t_ms"), F.col("from_id").alias("event_id"),
        F.struct("holding", "done", "expiry").alias("_record"),
    ).select("*", piece)
    # at equal slices a slice comes before the records written in it
    starts = (
        rows.select(*KEY, "_slice").distinct().withColumn("_first", F.lit(0))
        .unionByName(writes.withColumn("_first", F.lit(1)), allowMissingColumns=True)
        .withColumn("_record", F.last("_record", ignorenulls=True).over(before))
        .where("_first = 0")
        .select(*KEY, "_slice", F.lit(BEFORE_ALL).alias("t_ms"), F.lit(BEFORE_ALL).alias("event_id"), "_record")
    )
    known = writes.unionByName(starts).withColumn("_write", F.lit(1))
    return (
        rows.withColumn("_write", F.lit(0))
        .unionByName(known, allowMissingColumns=True)
        .withColumn("_record", F.last("_record", ignorenulls=True).over(at))
        .where("_write = 0")
        .select(*FIELDS, "_record.*")
    )
