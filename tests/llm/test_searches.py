import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import nearest, topk, vectors

NAN, INF = float("nan"), float("inf")
SHAPE = "vec_id bigint, embedding array<float>, score string, shard string, vector string"


def given(spark, rows):
    rows = [(i, v, "clash", "clash", "clash") for i, v in rows]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


def some(n=400, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    rows = centres[rng.integers(0, 8, n)] + 0.4 * rng.normal(size=(n, width))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    out = [(i, r.astype(np.float32).tolist()) for i, r in enumerate(rows)]
    out += [(1000 + i, out[20][1]) for i in range(60)]  # one vector many times
    out += [
        (2000, None), (2050, [0.1] * 15 + [None]), (2100, [NAN] * 16), (2150, [INF] + [0.0] * 15),
        (2200, [0.0] * 16), (2250, []), (2300, [0.5, -0.5]), (None, [0.1] * 16),
    ]
    out += [out[50], out[50], (50, [0.25] * 16)]  # repeated rows and ids
    return out


def usable(rows, zero):
    ok = [
        (i, np.float64(np.float32(v)))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    return ok if zero else [(i, v) for i, v in ok if v.any()]


def first_of_each(rows):
    out = {}
    for i, v in rows:
        if i % 50 == 0 and (i not in out or v.tolist() < out[i].tolist()):
            out[i] = v
    return out


def brute_top(rows, k=5):
    whole = [(i, np.floor(256 * v).astype(int)) for i, v in usable(rows, True)]
    return {
        q: sorted(((-int(v @ x), i) for i, v in whole if i != q))[:k]
        for q, x in first_of_each(whole).items()
    }


@pytest.mark.parametrize(("shard", "block", "few"), [(16_384, 2_048, 64), (90, 3, 2), (200, 50, 0)])
def test_top_k_as_by_brute_force(spark, monkeypatch, shard, block, few):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    rows = some()
    found = topk.exact_top_k(given(spark, rows), F.col("vec_id") % 50 == 0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = brute_top(rows)
    assert got == want


@pytest.mark.parametrize("few", [0, 1, 64, 10_000])
def test_search_stops_only_on_proof(monkeypatch, few):
    monkeypatch.setattr(topk, "FEW", few)
    rng = np.random.default_rng(few)
    rows = rng.integers(-256, 256, (700, 12)).astype(float)
    rows[100:160] = rows[7]
    index, ids = topk.ImpactIndex(rows), rng.permutation(700)
    for _ in range(40):
        query = rng.integers(-256, 256, 12)
        own = ids == rng.integers(0, 700)
        place = index.search(query, own, ids, 5)
        scores = rows.astype(int) @ query
        want = sorted((-s, i) for s, i, o in zip(scores, ids, own, strict=True) if not o)[:5]
        assert [(-scores[p], ids[p]) for p in place] == want


@pytest.mark.parametrize("size", [10**4, 10**5, 10**6, 10**7])
def test_large_components_are_bounded_rightly(size):
    rng = np.random.default_rng(size)
    rows = np.floor(256 * rng.uniform(-size, size, (700, 12)))
    rows[:9] = np.abs(rows[:9]) + 256 * size  # the best rows by far
    ids = rng.permutation(700)
    index = topk.ImpactIndex(rows)
    flat = np.zeros(12)
    flat[3] = 256
    for query in (flat, rows[0], rows[50], np.abs(rows[60]), -rows[70]):
        query, own = query.astype(np.int64), ids == ids[0]
        place = index.search(query, own, ids, 5)
        exact = [sum(int(a) * int(b) for a, b in zip(r, query, strict=True)) for r in rows]
        want = sorted((-s, i) for s, i, o in zip(exact, ids, own, strict=True) if not o)[:5]
        assert [(-exact[p], ids[p]) for p in place] == want


def test_large_components_in_a_table(spark):
    rows = [(i, [float(i * 10**4), 3e6 - i, -5.0 * i]) for i in range(200)] + [(1000, [0.0, 1.0, 0.0])]
    got = {}
    for r in topk.exact_top_k(given(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: sorted(own) for q, own in got.items()} == brute_top(rows)


def brute_near(rows, k=5):
    whole = usable(rows, False)
    out = {}
    for q, x in first_of_each(whole).items():
        scored = [
            (-((v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))), i)
            for i, v in whole
            if i != q
        ]
        out[q] = sorted(scored)[:k]
    return out


def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART_ROWS", 50)
    rows = some(950)
    found = nearest.nearest(given(spark, rows), F.col("vec_id") % 50 == 0).collect()
    want = brute_near(rows)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(got) == set(want)
    right = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert right >= 0.9 * sum(map(len, want.values()))
    exact = {q: dict((i, s) for s, i in brute_near(rows, 10_000)[q]) for q in list(want)[:5]}
    for q, own in exact.items():
        assert len(got[q]) == 5
        assert got[q] == sorted(got[q])
        assert all(s == pytest.approx(own[i], abs=1e-12) for s, i in got[q])


def test_all_leaves_give_exact_neighbours(spark):
    rows = some(600, seed=3)
    found = nearest.nearest(given(spark, rows), F.col("vec_id") % 50 == 0, recall=1.0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [i for _, i in own] for q, own in brute_near(rows).items()}
    assert got == want


def test_queries_of_a_leaf_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART_ROWS", 100)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 50)
    one = F.array(F.lit(1.0)).alias("vector")
    rows = spark.range(300).select(F.col("id").alias("vec_id"), one, (F.col("id") % 2).alias("leaf"))
    visits = spark.range(600).select(F.col("id").alias("query_id"), one, F.lit(0).alias("leaf"))
    held, asked = nearest.dealt(rows, visits)
    cell = ["leaf", "part", "block"]
    assert max(r["count"] for r in asked.groupBy(*cell).count().collect()) <= 100
    assert max(r["count"] for r in held.groupBy(*cell).count().collect()) <= 150
    met = held.drop("vector").join(asked.drop("vector"), cell)
    assert met.count() == met.select("vec_id", "query_id").distinct().count() == 150 * 600


def test_blocks_of_queries_give_exact_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART_ROWS", 50)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 3)
    rows = some(600, seed=3)
    found = nearest.nearest(given(spark, rows), F.col("vec_id") % 50 == 0, recall=1.0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for _, i in own] for q, own in brute_near(rows).items()}


def test_walk_visits_every_leaf_once():
    rng = np.random.default_rng(1)
    tree = nearest.Tree(4)
    rows = nearest.unit(rng.normal(size=(900, 4)))
    tree.grow(rows, rng)
    tree.finish()
    order = tree.visits(rows[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 8
    assert order[0] == tree.assign(rows[:1])[0]
    alike = nearest.Tree(4)
    alike.grow(np.ones((500, 4)), rng)
    assert alike.leaves == 1


def test_few_or_no_rows(spark):
    none = spark.createDataFrame([], SHAPE)
    for search in (topk.exact_top_k, nearest.nearest):
        assert search(none, F.col("vec_id") % 50 == 0).collect() == []
        one = given(spark, [(0, [1.0, 2.0])])
        assert search(one, F.col("vec_id") % 50 == 0).collect() == []
        two = given(spark, [(0, [1.0, 2.0]), (3, [2.0, 1.0])])
        found = search(two, F.col("vec_id") % 50 == 0).collect()
        assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 3)]


def test_shorter_vectors_are_padded():
    import pyarrow as pa

    got = vectors.matrix(pa.array([[1.0], [], [1.0, 2.0, 3.0]]), 3)
    assert got.tolist() == [[1, 0, 0], [0, 0, 0], [1, 2, 3]]


def test_components_no_bigint_holds_are_an_error(spark):
    rows = [(0, [1 / 256, 0.0]), (1, [1e17, 0.0]), (2, [0.5, 0.0])]
    with pytest.raises(Exception, match="beyond"):
        topk.exact_top_k(given(spark, rows), F.col("vec_id") == 0).collect()
