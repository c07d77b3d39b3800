"""Exact highest inner products through an impact-ordered index.

Rows are dealt to shards, queries to blocks, and each shard meets each block, so neither side is held
whole anywhere. A shard's index has a posting for each row and component. Postings of a component
are ordered by value and cut in segments of ``LEVEL`` values. A query's segments are taken
by falling impact, the most that one of the segment's postings can add to a score. After each
portion, a row's score is at most what its postings so far could add plus the next impact for each
posting still to come. These bounds are doubles, widened by what rounding can take from them, and
postings are counted in whole numbers of their own, so they hold for components of any size. The exact
scores of the leading rows give the score to beat. Once only few
rows can still reach it, they are rescored exactly: the search stops on this proof alone, and
where it never comes all postings are taken and all remaining rows rescored.

Defined cases: vectors that are null, hold null or non-finite components, or have no id take no
part. Shorter vectors count as zero beyond their end. Rows that repeat an id are each a candidate, and each
query id is asked once with its smallest vector; rows with the query's own id are never its
candidates. An empty table gives an empty result. A component of 2^62 or more after scaling is an error, and so
is a score among the best that no bigint holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallybook.llm.common import staged
from tallybook.llm.vectors import best, matrix, top, valid, width_of

LEVEL = 16
SHARD_ROWS = 16_384
BLOCK_QUERIES = 2_048
PORTIONS = 24
FEW = 64
EPS = np.finfo(np.float64).eps
WORD = float(1 << 62)  # products that may pass it are taken in whole numbers of any size


def quantised(rows: DataFrame, factor: int) -> DataFrame:
    x = F.transform("vector", lambda v: F.floor(v * factor).cast("double"))
    large = F.exists("vector", lambda v: F.abs(v * factor) >= WORD)
    told = F.raise_error(F.lit(f"a component is beyond {WORD:.0f} after scaling"))
    return rows.withColumn("vector", F.when(large, told.cast("array<double>")).otherwise(x))


class ImpactIndex:
    """Postings of one shard by component, in segments of falling value."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows.astype(np.int64)
        count, width = rows.shape
        order = np.argsort(self.rows, axis=0, kind="stable").T
        self.postings = np.ascontiguousarray(order).ravel()
        values = np.take_along_axis(self.rows.T, order, axis=1)
        level = values // LEVEL
        edge = np.ones((width, count), dtype=bool)
        edge[:, 1:] = level[:, 1:] != level[:, :-1]
        self.first = np.flatnonzero(edge.ravel())
        self.size = np.diff(np.r_[self.first, count * width])
        self.component = self.first // max(count, 1)
        flat = values.ravel()
        self.low = flat[self.first].astype(np.float64)
        self.high = flat[self.first + self.size - 1].astype(np.float64)
        self.reach = np.abs(rows).max(axis=0, initial=0)

    def scores(self, places: np.ndarray, query: np.ndarray, far: float) -> np.ndarray:
        """Exact scores; ``far`` is at least the sum of the sizes of their products."""
        if far < WORD:
            return self.rows[places] @ query
        return self.rows[places].astype(object) @ query.astype(object)

    def search(self, query: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best rows; ``own`` marks rows that are no candidates."""
        count, width = self.rows.shape
        steep = query.astype(np.float64)
        far = float(np.abs(steep) @ self.reach)
        slack = (2 * width + PORTIONS + 8) * EPS * far
        weight = steep[self.component]
        impact = np.where(weight > 0, weight * self.high, weight * self.low)
        order = np.argsort(-impact, kind="stable")
        portion = -(-len(self.postings) // PORTIONS)
        cut = np.searchsorted(np.cumsum(self.size[order]), np.arange(1, PORTIONS) * portion)
        sums, seen = np.zeros(count), np.zeros(count, dtype=np.int64)
        for part in np.split(order, np.unique(cut)):
            if not len(part):
                continue
            size = self.size[part]
            place = np.repeat(self.first[part] - np.cumsum(size) + size, size)
            place += np.arange(len(place))
            row = self.postings[place]
            sums += np.bincount(row, weights=np.repeat(impact[part], size), minlength=count)
            seen += np.bincount(row, minlength=count)
            done = part[-1] == order[-1]
            coming = 0 if done else impact[part[-1]]
            most = sums + (width - seen) * coming + slack
            most[own] = -np.inf
            if count - own.sum() <= k:
                break
            leading = np.argpartition(-most, k)[: k + 1]
            leading = leading[~own[leading]]
            beat = np.sort(self.scores(leading, query, far))[::-1][k - 1]
            possible = np.flatnonzero(most >= float(beat))
            if len(possible) <= FEW or done:
                exact = self.scores(possible, query, far)
                return possible[top(exact, ids[possible], k)]
        possible = np.flatnonzero(~own)
        return possible[top(self.scores(possible, query, far), ids[possible], k)]


def exact_top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    factor: int = 256,
    id_: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score for each query; ``is_query`` is a condition on vec_id."""
    indexed = staged(quantised(valid(rows, id_, vector), factor), "quantised")
    queries = (
        indexed.where(is_query)
        .groupBy(F.col("vec_id").alias("query_id"))
        .agg(F.min("vector").alias("vector"))
    )
    shards = max(1, -(-indexed.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def share(count: int, *parts: str) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(count)).cast("int")

    left = indexed.select(
        "vec_id",
        "vector",
        share(shards, "vec_id", "vector").alias("shard"),
        every(blocks).alias("block"),
    )
    right = queries.select(
        "query_id",
        "vector",
        every(shards).alias("shard"),
        share(blocks, "query_id").alias("block"),
    )

    def search(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(answers(held, asked)), schema=SCHEMA)

    def answers(held: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        if not held.num_rows or not asked.num_rows:
            return
        width = width_of(held.column("vector"), asked.column("vector"))
        ids = held.column("vec_id").to_numpy()
        index = ImpactIndex(matrix(held.column("vector"), width))
        vectors = matrix(asked.column("vector"), width).astype(np.int64)
        for query, x in zip(asked.column("query_id").to_numpy(), vectors, strict=True):
            place = index.search(x, ids == query, ids, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(place), query)),
                    pa.array(ids[place]),
                    pa.array(index.scores(place, x, np.inf), pa.int64()),
                ],
                schema=SCHEMA,
            )

    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    found = met.applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    return best(found, k)


SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
