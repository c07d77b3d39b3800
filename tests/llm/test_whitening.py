import math

import numpy as np
import pytest

from tallybook.llm import whitening

NAN, INF = float("nan"), float("inf")
SHAPE = "vec_id bigint, embedding array<float>, n string, x string, part string, component string"


def given(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 4) for i, v in rows], SHAPE).repartition(3)


def some(n=300, width=24, seed=5):
    rng = np.random.default_rng(seed)
    spread = np.geomspace(3, 0.05, width)
    rows = (rng.normal(size=(n, width)) * spread) @ np.linalg.qr(rng.normal(size=(width, width)))[0]
    out = [(i, r.astype(np.float32).tolist()) for i, r in enumerate(rows)]
    out += [(900 + i, out[7][1]) for i in range(150)]  # a third of all share one vector
    out += [
        (2000, None), (2001, []), (2002, [0.5] * 4), (2003, [0.5] * (width - 1) + [None]),
        (2004, [NAN] * width), (2005, [INF] + [0.0] * 3), (None, [0.1] * width),
    ]
    return [*out, out[5], out[5], (5, [0.25] * width)]


def brute(rows):
    kept = [
        (i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    width = max(len(v) for _, v in kept)
    kept = [(i, v + [1_000_000] * (width - len(v))) for i, v in kept]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], dtype=float) / n
    values, vectors = np.linalg.eigh(x.T @ x / n)
    exact = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for _, v in kept]
    mean = np.array(sums) / n
    y = np.array([[n * c - s for c, s in zip(v, sums)] for _, v in kept], dtype=float) / n
    assert mean.shape == (width,)
    return kept, n, exact, values[::-1], vectors[:, ::-1], y


def test_rows_as_by_a_whole_decomposition(spark):
    rows = some()
    kept, n, exact, values, vectors, y = brute(rows)
    got = whitening.whiten(given(spark, rows)).collect()
    assert len(got) == 16 * len(kept)
    assert {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r)
    want = {}
    for (i, _), e, projected in zip(kept, exact, y, strict=True):
        want.setdefault((i, e), []).append(projected)
    assert set(want) == set(by_row)
    signs = {}
    for key, projected in want.items():
        for c in range(1, 17):
            found = by_row[key][c]
            assert len(found) == len(projected)
            for r in found:
                size = abs(projected[0] @ vectors[:, c - 1]) / math.sqrt(values[c - 1])
                assert abs(abs(r.whitened) - size) < 1e-9
                assert math.isclose(r.explained, values[c - 1] / values.sum(), rel_tol=1e-9)
                if size > 1e-6:
                    sign = math.copysign(1, (projected[0] @ vectors[:, c - 1]) * r.whitened)
                    assert signs.setdefault(c, sign) == sign


@pytest.mark.parametrize("kind", ["spread", "equal", "flat", "alike"])
def test_updates_keep_a_spectrum(kind):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(200, 12))
    if kind == "spread":
        rows *= np.geomspace(1e4, 1e-4, 12)
    if kind == "equal":
        rows = np.tile(np.eye(12), (6, 1)) * 3
    if kind == "flat":
        rows[:, 5:] = 0
    if kind == "alike":
        rows[:] = rows[0]
    d, q = np.zeros(12), np.eye(12)
    for row in rows:
        d, q = whitening.rank_one(d, q, row)
    scatter = rows.T @ rows
    assert np.abs(q.T @ q - np.eye(12)).max() < 1e-12
    assert np.abs(q * d @ q.T - scatter).max() < 1e-11 * np.abs(scatter).max()
    assert (np.diff(d) >= 0).all()


def test_roots_lie_in_their_gaps():
    rng = np.random.default_rng(2)
    for _ in range(50):
        k = int(rng.integers(2, 40))
        d = np.sort(rng.normal(size=k) ** 3)
        zz = rng.normal(size=k) ** 2 * 10.0 ** rng.integers(-12, 3, k)
        roots, delta = whitening.secular_roots(d, zz)
        assert (delta[np.arange(k), np.arange(k)] <= 0).all()
        assert (delta[np.arange(1, k), np.arange(k - 1)] >= 0).all()
        whole = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(zz), np.sqrt(zz)))
        assert np.abs(roots - whole).max() < 1e-12 * max(1, np.abs(whole).max())


def test_whole_numbers_of_any_size():
    x = np.array([[1 << 39, 5], [7, -(1 << 39)]])
    sums = [(1 << 39) + 7, 5 - (1 << 39)]
    for n in (2, 1 << 30):
        want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
        assert whitening.exact_squares(whitening.exact_differences(x, n, sums)) == want


def test_no_variance_and_empty(spark):
    assert whitening.whiten(given(spark, [])).collect() == []
    assert whitening.whiten(given(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(given(spark, [(n, [0.5, 0.25]) for n in range(5)])).collect() == []
    # two vectors differ in one direction only
    got = whitening.whiten(given(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in got) == [
        (1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0),
    ]
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(given(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])])).collect()
