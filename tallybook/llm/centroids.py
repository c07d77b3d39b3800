"""Cluster integer vectors around centroids with column expressions only.

A vector's squared distance to a centroid is ``aggregate`` over ``zip_with`` against the centroid as a
literal array of products, its cluster the ``array_min`` of the structs (distance, number), and a round of updates is
one aggregation with a sum per component. Rows never leave the JVM and nothing but
sums is shuffled: one row per task and cluster. What reaches the driver is ``k`` centroids of
``width`` whole numbers a round, however many rows there are.

All arithmetic is on whole numbers, so the order in which rows are added up changes nothing. Components
beyond ``LIMIT`` after scaling raise an error: squared distances would not fit a bigint. So
does a sum that does not fit.

Defined cases: vectors that are null, of another length than ``width``, or hold null or non-finite
components take no part. Rows without an id are clustered like others and start a centroid
only after all that have one. Rows that repeat an id or a vector are each a row; among equal ids the smaller
vector starts first. With fewer rows than ``k`` there are as many centroids as rows. A centroid that no
vector is nearest to keeps its place. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallybook.llm.common import staged

CENTROIDS = 16
ROUNDS = 3
SCALE = 64
WIDTH = 64
LIMIT = 1 << 27


@dataclass
class Clustering:
    """``rows``: vec_id, cluster, distance. ``centres``: cluster, centroid, size, inertia; k rows."""

    rows: DataFrame
    centres: DataFrame


def scaled(rows: DataFrame, id_: str, vector: str, width: int, scale: int) -> DataFrame:
    """vec_id, v, vv: the whole numbers of each vector that takes part and their sum of squares."""
    x = F.col(f"`{vector}`").cast("array<double>")
    unfit = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    large = F.exists("x", lambda c: F.abs(c * scale) >= LIMIT)
    whole = F.transform("x", lambda c: F.floor(c * scale))
    return (
        rows.select(F.col(f"`{id_}`").alias("vec_id"), x.alias("x"))
        .where((F.size("x") == width) & ~unfit)
        .select(
            "vec_id",
            F.when(large, F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling")))
            .otherwise(whole)
            .cast("array<bigint>")
            .alias("v"),
        )
        .withColumn("vv", F.expr("aggregate(v, 0L, (s, x) -> s + x * x)"))
    )


def first_centroids(vectors: DataFrame, k: int, tag: str) -> list[list[int]]:
    """The vectors whose tagged ids come first by hash."""
    order = F.sha2(F.concat(F.lit(f"{tag}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "v").limit(k)
    return [r.v for r in first.select("v").collect()]


def nearest(vector: str, size: str, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid, the smaller number of equals.

    ``size`` is the vector's own sum of squares, so that a component costs a product and a sum.

    A centroid is text that is folded into one literal array: as a literal per component the plan would
    grow by k * width nodes.
    """

    def away(centroid: list[int]) -> str:
        place = f"CAST(split('{','.join(map(str, centroid))}', ',') AS ARRAY<BIGINT>)"
        products = f"zip_with({vector}, {place}, (a, b) -> a * b)"
        dot = f"aggregate({products}, 0L, (s, x) -> s + x)"
        return f"{size} + {sum(c * c for c in centroid)}L - 2L * {dot}"

    each = [
        f"named_struct('distance', {away(c)}, 'cluster', {n})" for n, c in enumerate(centroids)
    ]
    return F.expr(f"array_min(array({', '.join(each)}))")


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    return vectors.select("vec_id", "v", nearest("v", "vv", centroids).alias("_near")).select(
        "vec_id", "v", "_near.cluster", "_near.distance"
    )


def moved(vectors: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """Each centroid at the floored mean of its vectors, in place where it has none."""
    sums = [F.expr(f"try_sum(v[{n}]) AS s{n}") for n in range(width)]
    rows = assigned(vectors, centroids).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums)
    out = list(centroids)
    for row in rows.collect():
        if None in row:
            raise OverflowError("the sum of a component does not fit a bigint")
        out[row.cluster] = [row[f"s{n}"] // row.n for n in range(width)]
    return out


def cluster(
    rows: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    tag: str = "1",
    id_: str = "vec_id",
    vector: str = "embedding",
) -> Clustering:
    """The clusters after ``rounds`` updates and one more assignment."""
    spark = rows.sparkSession
    vectors = staged(scaled(rows, id_, vector, width, scale), "whole-vectors")
    centroids = first_centroids(vectors, k, tag)
    shape = T.StructType(
        [
            T.StructField("cluster", T.IntegerType()),
            T.StructField("centroid", T.ArrayType(T.LongType())),
            T.StructField("size", T.LongType()),
            T.StructField("inertia", T.LongType()),
        ]
    )
    if not centroids:
        empty = vectors.select(
            "vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")
        )
        return Clustering(empty, spark.createDataFrame([], shape))
    for _ in range(rounds):
        centroids = moved(vectors, centroids, width)
    found = staged(assigned(vectors, centroids).drop("v"), "clusters")
    sizes = found.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.try_sum("distance").alias("inertia")
    )
    sums = {r.cluster: r for r in sizes.collect()}
    if any(r.inertia is None for r in sums.values()):
        raise OverflowError("the inertia of a cluster does not fit a bigint")
    centres = [
        (n, c, sums[n].size if n in sums else 0, sums[n].inertia if n in sums else 0)
        for n, c in enumerate(centroids)
    ]
    return Clustering(found, spark.createDataFrame(centres, shape))
