"""Tiny ledgers from plain tuples. Times are seconds after an arbitrary start."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallybook import schemas as S

START = datetime(2024, 5, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def lit_at(seconds):
    return F.lit(at(seconds))


def started(spark, *rows):
    """(request, seconds) with tenant acme, prompt 50."""
    return spark.createDataFrame(
        [(r, f"key-{r}", "acme", "m", 50, at(t)) for r, t in rows], S.STARTED_SCHEMA
    )


def metered(spark, *rows):
    """(request, seconds, completion, state) with prompt 50."""
    return spark.createDataFrame(
        [(r, f"key-{r}", "acme", "m", 50, n, state, at(t)) for r, t, n, state in rows],
        S.METERED_SCHEMA,
    )


def usage(spark, *rows):
    """(request, seconds, completion) with prompt 50."""
    return spark.createDataFrame([(r, 50, n, at(t)) for r, t, n in rows], S.USAGE_SCHEMA)


def settlements(spark, *rows):
    """(request, tenant, status, drift, reason)"""
    return spark.createDataFrame(
        [(r, t, "m", status, 100, 100, drift, reason, at(0)) for r, t, status, drift, reason in rows],
        S.SETTLEMENT_SCHEMA,
    )


def by_request(frame):
    return {row["request_id"]: row for row in frame.collect()}
