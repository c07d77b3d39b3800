"""Joins and running sums that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

HEAVY_KEYS = 1_000
TRACKED_KEYS = 20_000
FANOUT = 64
BLOCK = 65_536


def by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition for per-key Python work.

    The number of partitions is given, so that small rows with costly work are not merged into one.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys)


def key_hash(keys: Sequence[str]) -> Column:
    """One number per key. Two keys that share it are merely steered alike."""
    return F.xxhash64(*keys)


def heavy_keys(
    rows: DataFrame, keys: Sequence[str], limit: int = HEAVY_KEYS, at_least: int = 1_000
) -> DataFrame:
    """At most ``limit`` key hashes, those of the most frequent keys.

    A mergeable sketch finds them without shuffling the rows. It only steers where rows go, so
    its error changes speed, never results. A key with more than about 1/15000 of all rows is
    always tracked.
    """
    return (
        rows.select(key_hash(keys).alias("_k"))
        .agg(F.expr(f"approx_top_k(_k, {limit}, {TRACKED_KEYS})").alias("_top"))
        .select(F.explode("_top").alias("_top"))
        .where(F.col("_top.count") >= at_least)
        .select(F.col("_top.item").alias("_heavy"))
    )


def row_share(rows: DataFrame, fanout: int) -> Column:
    """A share from all columns of a row that can be hashed; equal rows may share it."""
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(F.lit(17), *[F.col(f"`{c}`") for c in plain]), F.lit(fanout))


def salted_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    heavy: DataFrame | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """Join many ``rows`` to few ``per_key`` rows with the heavy keys spread over ``fanout`` tasks.

    The salt is a hash of the row's other columns, so a task that runs again deals its rows alike.

    Rows of a heavy key get one of ``fanout`` salts, its ``per_key`` rows are repeated for every
    salt; all other keys keep salt 0 and are moved once. The heavy list holds at most
    ``HEAVY_KEYS`` entries, so it is always small enough to broadcast. ``how`` may be any
    join that keeps or drops rows of the left side only.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    heavy = F.broadcast(heavy if heavy is not None else heavy_keys(rows, keys))
    packed = key_hash(keys)

    spread = (
        rows.withColumn("_heavy", packed)
        .join(heavy.withColumn("_hot", F.lit(True)), "_heavy", "left")
        .withColumn(
            "_salt",
            F.when(F.col("_hot"), row_share(rows, fanout)).otherwise(0).cast("int"),
        )
        .drop("_heavy", "_hot")
    )
    copies = (
        per_key.withColumn("_heavy", packed)
        .join(heavy.withColumn("_hot", F.lit(True)), "_heavy", "left")
        .withColumn(
            "_salt",
            F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), fanout - 1).otherwise(0))),
        )
        .drop("_heavy", "_hot")
    )
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def running_sum(
    rows: DataFrame,
    keys: Sequence[str],
    position: str,
    amounts: dict[str, Column],
    *,
    block: int = BLOCK,
    include_current: bool = True,
) -> DataFrame:
    """Running totals along a whole-number ``position`` inside each key.

    Positions are cut into blocks. Sums per block are combined before they are shuffled and
    only those few rows are summed key by key; the rows themselves meet one block at a time, so a
    key holding a third of the data is worked on by as many tasks as it has blocks.
    ``amounts`` maps each new column to the expression it totals.
    """
    cut = rows.withColumn("_block", F.floor(F.col(position) / block))
    for name, amount in amounts.items():
        cut = cut.withColumn(f"_amount_{name}", F.coalesce(amount, F.lit(0)).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_block")
        .agg(*[F.sum(f"_amount_{n}").alias(f"_part_{n}") for n in amounts])
        .select(
            *keys,
            "_block",
            *[
                F.coalesce(F.sum(f"_part_{n}").over(before), F.lit(0)).alias(f"_before_{n}")
                for n in amounts
            ],
        )
    )
    last = Window.currentRow if include_current else -1
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    joined = cut.join(offsets, [*keys, "_block"])
    totals = {
        n: F.coalesce(F.sum(f"_amount_{n}").over(inside), F.lit(0)) + F.col(f"_before_{n}")
        for n in amounts
    }
    return joined.withColumns(totals).drop(
        "_block", *[f"_amount_{n}" for n in amounts], *[f"_before_{n}" for n in amounts]
    )
