"""Approximate nearest neighbours by a k-means tree, best bin first.

The tree is fitted on the driver to at most ``SAMPLE`` rows, the first in hash order of their id;
this number bounds the fit, the number of leaves and what is broadcast. Every row is then indexed in
the leaf it descends to. A query walks the tree with a priority queue: the nearest centre
seen so far is opened next, and leaves come out in the order in which they are worth visiting. How
many leaves are visited is calibrated: for at most ``CALIBRATION`` queries the exact
neighbours among all rows are found, and the visits are widened until the leaves hold ``recall`` of
them. In a visited leaf all cosines are computed in double precision; a full leaf is
cut in parts and its visits are dealt to blocks of queries, so a vector that a third of all rows
share is many tasks, and no task holds more of either side as the input grows.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have no id take
no part. Shorter vectors count as zero beyond their end. Rows that repeat an id are each a candidate,
each query id is asked once with its smallest vector; rows with the query's own id
are never its candidates. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook.llm.common import staged
from tallybook.llm.vectors import best, matrix, top, valid, width_of

SAMPLE = 16_384
LEAF_SAMPLE = 64
BRANCHES = 8
ROUNDS = 8
CALIBRATION = 256
RECALL = 0.97
PART_ROWS = 4_096
BLOCK_QUERIES = 2_048
SAME = 1e-9
SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FIELDS = "query_id bigint, vec_id bigint, score double"


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@dataclass
class Tree:
    """Nodes by number: centre, children; leaves have no children and a leaf number."""

    width: int
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(rows.mean(axis=0) if len(rows) else np.zeros(self.width))
        self.children.append([])
        self.leaf.append(-1)
        parts = cluster(rows, rng) if len(rows) > LEAF_SAMPLE else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self.grow(rows[p], rng) for p in parts]
        return node

    def finish(self) -> Tree:
        self.table = [
            np.array([self.centres[c] for c in kids]) if kids else None for kids in self.children
        ]
        return self

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf each row descends to."""
        out = np.empty(len(rows), dtype=np.int64)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, mine = waiting.pop()
            if self.leaf[node] >= 0:
                out[mine] = self.leaf[node]
                continue
            near = distances(rows[mine], self.table[node]).argmin(axis=1)
            for n, child in enumerate(self.children[node]):
                if len(some := mine[near == n]):
                    waiting.append((child, some))
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            away = distances(query[None, :], self.table[node])[0].tolist()
            for d, child in zip(away, self.children[node], strict=True):
                heapq.heappush(heap, (d, child))
        return out


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(axis=1) - 2 * rows @ centres.T


def cluster(rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Places of the rows of each cluster; fewer than two if the rows are all alike."""
    centres = np.unique(rows[rng.choice(len(rows), min(BRANCHES, len(rows)), replace=False)], axis=0)
    for _ in range(ROUNDS):
        near = distances(rows, centres).argmin(axis=1)
        used = np.unique(near)
        centres = np.array([rows[near == c].mean(axis=0) for c in used])
    near = distances(rows, centres).argmin(axis=1)
    return [np.flatnonzero(near == c) for c in np.unique(near)]


def fit(rows: DataFrame) -> Tree:
    sample = rows.orderBy(F.xxhash64(F.lit(10), "vec_id"), "vec_id", "vector").limit(SAMPLE)
    held = sample.select("vector").toArrow()
    width = width_of(held.column(0)) if held.num_rows else 1
    tree = Tree(width)
    tree.grow(unit(matrix(held.column(0), width)), np.random.default_rng(10))
    return tree.finish()


def fitting(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in the tree's space; components beyond it do not steer the walk."""
    rows = unit(matrix(column, max(width, width_of(column))))
    return rows[:, :width]


def place_rows(rows: DataFrame, tree: Tree) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.assign(fitting(batch.column(1), shared.value.width))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaf)], ["vec_id", "vector", "leaf"]
                )

    return rows.mapInArrow(work, "vec_id bigint, vector array<double>, leaf bigint")


def answers(held: pa.Table, asked: pa.Table, k: int) -> Iterator[tuple]:
    """For each query its id, and places and cosines of its k best of the held rows.

    Products of a whole block pick the rows; each picked row is then computed by itself, so
    that equal vectors get equal scores wherever they stand.
    """
    if not held.num_rows or not asked.num_rows:
        return
    width = width_of(held.column("vector"), asked.column("vector"))
    ids = held.column("vec_id").to_numpy()
    rows = matrix(held.column("vector"), width)
    vectors = matrix(asked.column("vector"), width)
    sizes = np.sqrt((rows * rows).sum(axis=1))
    scaled = rows / sizes[:, None]
    for query, x in zip(asked.column("query_id").to_numpy(), vectors, strict=True):
        size = np.sqrt((x * x).sum())
        about = scaled @ (x / size)
        about[ids == query] = -np.inf
        if len(about) > k:
            picked = np.flatnonzero(about >= np.partition(about, -k)[-k] - SAME)
        else:
            picked = np.arange(len(about))
        picked = picked[ids[picked] != query]
        exact = (rows[picked] * x).sum(axis=1) / (sizes[picked] * size)
        kept = top(exact, ids[picked], k)
        yield query, picked[kept], exact[kept]


def calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit so that they hold ``recall`` of the exact neighbours of the sample."""
    spark = indexed.sparkSession
    chosen = queries.orderBy(F.xxhash64(F.lit(20), "query_id"), "query_id").limit(CALIBRATION)
    asked = chosen.toArrow()
    if not asked.num_rows:
        return 1
    shared = spark.sparkContext.broadcast(asked)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            held = pa.Table.from_batches([batch])
            for query, place, score in answers(held, shared.value, k):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(place), query)),
                        pa.array(held.column("vec_id").to_numpy()[place]),
                        pa.array(score),
                        pa.array(leaf[place]),
                    ],
                    ["query_id", "vec_id", "score", "leaf"],
                )

    found = indexed.mapInArrow(work, FIELDS + ", leaf bigint")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    exact = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    exact = exact.select("query_id", "leaf").toArrow().to_pandas().groupby("query_id")["leaf"]
    exact = exact.apply(list).to_dict()
    vectors = fitting(asked.column("vector"), tree.width)
    needed = []
    for query, x in zip(asked.column("query_id").to_pylist(), vectors, strict=True):
        rank = {leaf: n + 1 for n, leaf in enumerate(tree.visits(x, tree.leaves))}
        needed += [rank[leaf] for leaf in exact.get(query, [])]
    if not needed:
        return 1
    return int(np.quantile(needed, recall, method="higher"))


def dealt(indexed: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and visits of each visited leaf by leaf, part and block; each part meets each block."""

    def shares(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / most).alias(name))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    sizes = shares(indexed, PART_ROWS, "parts").join(
        shares(visits, BLOCK_QUERIES, "blocks"), "leaf"
    )
    held = indexed.join(sizes, "leaf").select(
        "leaf",
        F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")).alias("part"),
        every("blocks").alias("block"),
        "vec_id",
        "vector",
    )
    asked = visits.join(sizes, "leaf").select(
        "leaf",
        every("parts").alias("part"),
        F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"),
        "query_id",
        "vector",
    )
    return held, asked


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    recall: float = RECALL,
    id_: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score for each query; ``is_query`` is a condition on vec_id."""
    some = F.exists("vector", lambda v: v != 0)
    usable = valid(rows, id_, vector).where(some)
    tree = fit(usable)
    indexed = staged(place_rows(usable, tree), "vectors-by-leaf")
    queries = (
        indexed.where(is_query)
        .groupBy(F.col("vec_id").alias("query_id"))
        .agg(F.min("vector").alias("vector"))
    )
    most = calibrate(indexed, queries, tree, k, recall)
    shared = indexed.sparkSession.sparkContext.broadcast(tree)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = fitting(batch.column(1), shared.value.width)
                leaves = [shared.value.visits(x, most) for x in vectors]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaves, pa.list_(pa.int64()))],
                    ["query_id", "vector", "leaves"],
                )

    walks = staged(
        queries.mapInArrow(walk, "query_id bigint, vector array<double>, leaves array<bigint>"),
        "walks",
    )
    visits = walks.select("query_id", "vector", F.explode("leaves").alias("leaf"))
    held, asked = dealt(indexed, visits)

    def search(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids = mine.column("vec_id").to_numpy()
        out = [
            pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), query)), pa.array(ids[place]), pa.array(score)],
                schema=SCHEMA,
            )
            for query, place, score in answers(mine, theirs, k)
        ]
        return pa.Table.from_batches(out, schema=SCHEMA)

    met = held.groupBy("leaf", "part", "block").cogroup(asked.groupBy("leaf", "part", "block"))
    return best(met.applyInArrow(search, FIELDS), k)
