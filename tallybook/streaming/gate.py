"""The sweep's clock: wall time that passes only while nothing is left unread.

A deadline by the wall clock is sound only for a reader that has caught up: on a backlog, a request whose report
was not read yet looks like one whose report never came. So the clock is a feed of ticks beside
the input (``ticks``, for ``settle_stream(clock='processing')``), and a tick is written only when the last
trigger left nothing behind in any source. A lag that cannot be told counts as being behind.
"""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybook.operators.reconcile import WINDOW_SECONDS
from tallybook.streaming.reconcile_stream import TICK

LEAST_SECONDS = 5.0
IDLE = "Waiting for data to arrive"


def sweep_every(window_seconds: float = WINDOW_SECONDS) -> float:
    """Seconds between sweeps: a tenth of the window, five at least."""
    return max(LEAST_SECONDS, window_seconds / 10)


def _offset(value):
    """An offset as plain data, None where there is none."""
    if isinstance(value, str):
        try:
            return _offset(json.loads(value))
        except ValueError:
            return None
    return value


def _behind(end, latest) -> int | None:
    """Offsets between two positions of a source; None if they cannot be compared."""
    if isinstance(end, dict) and isinstance(latest, dict):
        if end.keys() != latest.keys():
            return None
        parts = [_behind(end[k], latest[k]) for k in end]
        return None if None in parts else sum(parts)
    if isinstance(end, int) and isinstance(latest, int):
        return None if min(end, latest) < 0 else max(0, latest - end)
    return None


def source_lag(progress: dict, but: str | None = None) -> int | None:
    """What a trigger left unread in its sources, in their offsets. None: unknown.

    A source that does not tell its end has none left if the trigger found nothing new in it. ``but`` leaves out
    sources whose description holds it.
    """
    sources = [s for s in progress.get("sources", []) if not but or but not in s.get("description", "")]
    total = 0 if sources else None
    for source in sources:
        start, end, latest = (_offset(source.get(n)) for n in ("startOffset", "endOffset", "latestOffset"))
        if end is None:
            return None
        if latest is not None:
            lag = _behind(end, latest)
        else:
            lag = 0 if start == end else None
        if lag is None:
            return None
        total += lag
    return total


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The ticks in ``folder`` as arrivals; union them with those of the feed."""
    feed = spark.readStream.schema("at timestamp").json(folder)
    return feed.select(
        F.lit(TICK).alias("side"),
        F.lit("tick").alias("request_id"),
        "at",
        *[F.lit(None).cast("string").alias(n) for n in ("tenant_id", "model", "idempotency_key")],
        *[F.lit(None).cast("bigint").alias(n) for n in ("prompt_tokens", "completion_tokens")],
        F.lit(None).cast("string").alias("terminal_state"),
    )


class SweepGate:
    """Writes a tick to ``folder`` at most every ``every`` seconds, and only when all input was read.

    ``poll`` is called by whoever watches the query; ``keep_sweeping`` does so until it ends.
    ``ticked`` and ``deferred`` count the sweeps let through and put off.
    """

    def __init__(self, spark: SparkSession, folder: str, every: float | None = None):
        self.spark, self.folder = spark, folder
        self.every = sweep_every() if every is None else every
        self.ticked = self.deferred = 0
        self._last = float("-inf")

    def open_to(self, progress: dict | None, status: dict, now: datetime) -> datetime | None:
        """The time up to which all input was read; None if some is left or that is unknown."""
        if progress is None:
            return None
        if not status["isTriggerActive"] and not status["isDataAvailable"] and status["message"] == IDLE:
            return now
        if source_lag(progress, self.folder) == 0:
            return datetime.fromisoformat(progress["timestamp"])
        return None

    def poll(self, query: StreamingQuery) -> bool:
        """Let one sweep through if it is time for one and nothing is left unread."""
        if time.monotonic() - self._last < self.every:
            return False
        now = datetime.now(UTC)
        last = query.lastProgress
        upto = self.open_to(json.loads(last.json) if last else None, query.status, now)
        if upto is None:
            self.deferred += 1
            return False
        self._last = time.monotonic()
        self.ticked += 1
        at = F.timestamp_micros(F.lit(int(upto.timestamp() * 1_000_000)))
        self.spark.range(1).coalesce(1).select(at.alias("at")).write.mode("append").json(self.folder)
        return True

    def keep_sweeping(self, query: StreamingQuery, pause: float = 1.0) -> None:
        while query.isActive:
            self.poll(query)
            time.sleep(pause)
