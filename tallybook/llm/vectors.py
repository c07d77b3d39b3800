"""What both vector searches share: valid rows, dealing to shards, the best of all shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F


def valid(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """vec_id, vector (array of doubles) of rows with an id and finite components only."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.select(F.col(id_).cast("bigint").alias("vec_id"), x.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad
    )


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles, zero beyond a vector's own length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = flat
    return out


def width_of(*columns: pa.ChunkedArray) -> int:
    return max((pc.max(pc.list_value_length(c)).as_py() or 0) for c in columns)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what the shards found for each query."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort([ids, -scores])[:k]
