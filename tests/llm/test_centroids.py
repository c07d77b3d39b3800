import hashlib
import math

import numpy as np
import pytest

from tallybook.llm import centroids

NAN, INF = float("nan"), float("inf")
SHAPE = "vec_id bigint, embedding array<float>, cluster string, distance string, v string, x string"


def given(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 4) for i, v in rows], SHAPE).repartition(3)


def some(n=300, width=64, seed=3):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(5, width))[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, width))
    out = [(i, r.astype(np.float32).tolist()) for i, r in enumerate(rows)]
    out += [(900 + i, out[7][1]) for i in range(100)]  # a third of all share one vector
    out += [
        (2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [0.5] * 63 + [None]),
        (2005, [NAN] * 64), (2006, [-INF] + [0.0] * 63), (None, [0.1] * 64), (2007, [0.0] * 64),
    ]
    return [*out, out[5], out[5], (5, [0.25] * 64)]  # repeated rows and ids


def brute(rows, k=16, rounds=3, width=64):
    kept = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]

    def order(row):
        name = hashlib.sha256(f"1:{row[0]}".encode()).hexdigest()
        return (row[0] is None, name, row[1])

    places = [v for _, v in sorted(kept, key=order)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(places))

    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(near(v)[1], []).append(v)
        places = [
            [sum(c) // len(mine[n]) for c in zip(*mine[n])] if n in mine else place
            for n, place in enumerate(places)
        ]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), places


def test_clusters_as_by_brute_force(spark):
    rows = some()
    found = centroids.cluster(given(spark, rows))
    want, places = brute(rows)
    assert found.rows.columns == ["vec_id", "cluster", "distance"]
    assert sorted(map(tuple, found.rows.collect()), key=str) == want
    centres = sorted(found.centres.collect())
    assert [r.centroid for r in centres] == places
    assert [r.inertia for r in centres] == [sum(w[2] for w in want if w[1] == n) for n in range(16)]
    assert [r["size"] for r in centres] == [sum(w[1] == n for w in want) for n in range(16)]


def test_ties_empty_centroids_and_few_rows(spark):
    rows = [(n, [0.0] * 64) for n in range(20)]
    found = centroids.cluster(given(spark, rows))
    assert {tuple(r)[1:] for r in found.rows.collect()} == {(0, 0)}
    assert [r["size"] for r in sorted(found.centres.collect())] == [20] + [0] * 15
    few = some(8)[:3]
    found = centroids.cluster(given(spark, few))
    want, places = brute(few)
    assert sorted(map(tuple, found.rows.collect()), key=str) == want
    assert len(places) == found.centres.count() == 3


def test_empty_and_too_large(spark):
    found = centroids.cluster(given(spark, []))
    assert found.rows.collect() == [] and found.centres.collect() == []
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(given(spark, [(1, [1e17] + [0.0] * 63), (2, [0.0] * 64)])).rows.collect()
