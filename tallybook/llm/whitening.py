"""Whiten vectors by an incremental eigendecomposition.

Components become whole numbers. The distinct vectors are the fit list; its count and sums are exact, so every
vector is centred exactly before anything is multiplied.

Each task starts from an empty spectrum and takes its vectors one by one, each a rank-one update: the vector in
the present eigenbasis gives the secular equation whose roots are the new eigenvalues. Equal eigenvalues are
reflected until one of them meets the update, and directions the update does not touch keep their
pair (deflation). The spectra of the tasks are combined ``FAN`` at a time, each eigenpair of one being a
rank-one update of the other. Last, a Rayleigh-Ritz step: the vectors are projected on the basis found, the small
covariance of these projections is summed over all tasks, and its eigenvectors turn the basis. There the
covariance is nearly diagonal, so small eigenvalues keep their digits too.

A task holds one spectrum, ``width`` squared numbers, and one batch of vectors; a task that combines holds
``FAN`` spectra. The driver gets one spectrum and two sums of that size, whatever the number of rows.

Defined cases: vectors that are null or hold null or non-finite components take no part. Shorter vectors
count as zero beyond their end. Rows that repeat an id or a vector are each answered; the fit list
holds each vector once. A row without an id is answered with a null id. Components without variance cannot
be scaled and are left out, so fewer than ``components`` may come back, and none where all vectors are
alike. An empty table gives an empty result. Components beyond ``LIMIT`` after scaling raise an error. A
deviation beyond a bigint is null in the query; the operator gives it as a decimal of 38 digits. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.common import staged, tasks

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
LIMIT = 1 << 40
FAN = 8
EPS = float(np.finfo(np.float64).eps)
FLAT = 1e-13  # of the largest eigenvalue; less is no variance

STATE = "part bigint, eigenvalues array<double>, vectors array<double>"
SUMS = "i int, j int, total double"
OUT = (
    "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double"
)


def reflect_equal(d: np.ndarray, q: np.ndarray, z: np.ndarray, tol: float) -> None:
    """Turn the vectors of equal eigenvalues so that the last of them alone meets the update."""
    close = np.flatnonzero(np.diff(d) <= tol)
    if not len(close):
        return
    for group in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
        a, b = group[0], group[-1] + 2
        size = np.sqrt(z[a:b] @ z[a:b])
        if size == 0:
            continue
        mirror = z[a:b].copy()
        sign = 1.0 if mirror[-1] >= 0 else -1.0
        mirror[-1] += sign * size
        q[:, a:b] -= np.outer(q[:, a:b] @ mirror, mirror * (2 / (mirror @ mirror)))
        z[a:b] = 0
        z[b - 1] = -sign * size


def secular_roots(d: np.ndarray, zz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum zz_i / (d_i - x), one in each gap, and all differences d_i - root_j.

    Every root is held as its distance to the nearer pole, so that differences keep their
    digits. Steps match value and slopes on both sides of a gap; a step that leaves the bracket is halved instead.
    """
    k = len(d)
    if k == 1:
        return d + zz, -zz[:, None]
    gap = np.append(np.diff(d), zz.sum())
    middle = d + gap / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        at_middle = 1 + (zz[:, None] / (d[:, None] - middle)).sum(axis=0)
        right = at_middle < 0
        near = right.copy()
        near[-1] = False  # the last root has one pole only
        pole = np.arange(k) + near
        base = d[:, None] - d[pole]
        low = np.where(near, -gap / 2, 0.0)
        high = np.where(near, 0.0, gap / 2)
        if right[-1]:
            low[-1], high[-1] = gap[-1] / 2, gap[-1]
        else:
            low[-1], high[-1] = 0.0, gap[-1] / 2
        lower = np.tri(k).T  # poles at or before the gap
        own = np.arange(k)
        x = (low + high) / 2
        for _ in range(80):
            delta = base - x
            part = zz[:, None] / delta
            f = 1 + part.sum(axis=0)
            slope = part / delta
            psi = (slope * lower).sum(axis=0)
            phi = slope.sum(axis=0) - psi
            low = np.where(f < 0, x, low)
            high = np.where(f < 0, high, x)
            left = delta[own, own]
            after = delta[np.minimum(own + 1, k - 1), own]
            c = f - left * psi - after * phi
            a = (left + after) * f - left * after * (psi + phi)
            b = left * after * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = left[-1] + left[-1] ** 2 * psi[-1] / (f[-1] - left[-1] * psi[-1])
            new = x + step
            ok = (new > low) & (new < high)
            new = np.where(ok, new, (low + high) / 2)
            # nothing but rounding is left of the sum: a further step would only leave the bracket
            found = np.abs(f) <= 2 * EPS * (1 + np.abs(part).sum(axis=0))
            done = found | (np.abs(new - x) <= 4 * EPS * np.abs(new))
            x = np.where(found, x, new)
            if done.all():
                break
    return d[pole] + x, base - x


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of q diag(d) q' + v v'."""
    z = v @ q
    size = np.sqrt(z @ z)
    tol = 8 * EPS * max(abs(d[-1]), size * size)
    if tol == 0:
        return d, q
    q = q.copy()
    reflect_equal(d, q, z, tol)
    live = np.flatnonzero(np.abs(z) * size > tol)
    if not len(live):
        return d, q
    poles = d[live]
    roots, delta = secular_roots(poles, z[live] ** 2)
    # the update these roots belong to exactly, which keeps the vectors at right angles
    k = len(live)
    weight = -delta[:, -1]  # root_j - pole_i, over pole_j or the pole after it
    if k > 1:
        before = np.tri(k, k - 1, -1, dtype=bool)  # j < i
        gaps = np.where(before, poles[:-1], poles[1:]) - poles[:, None]
        weight = weight * (-delta[:, :-1] / gaps).prod(axis=1)
    weight = np.sqrt(np.maximum(weight, 0))
    weight = np.copysign(weight, z[live])
    turn = weight[:, None] / delta
    turn /= np.sqrt((turn * turn).sum(axis=0))
    q[:, live] = q[:, live] @ turn
    d = d.copy()
    d[live] = roots
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def exact_differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums in whole numbers, of any size where 64 bits would not do."""
    bound = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if bound < 1 << 61:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def exact_squares(differences: np.ndarray) -> list[int]:
    """The sum of squares of each row."""
    if differences.dtype != object:
        most = int(np.abs(differences).max(initial=0))
        if most * most * max(1, differences.shape[1]) < 1 << 62:
            return (differences * differences).sum(axis=1).tolist()
    wide = differences.astype(object)
    return [int(s) for s in (wide * wide).sum(axis=1)]


def whole_vectors(
    rows: DataFrame, id_: str, vector: str, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """vec_id, x: the whole numbers of the rows that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    unfit = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    large = F.exists("x", lambda c: F.abs(c * scale) >= LIMIT)
    whole = F.transform("x", lambda c: F.floor(c * scale) + shift)
    return (
        rows.select(F.col(f"`{id_}`").cast("bigint").alias("vec_id"), x.alias("x"))
        .where(F.col("x").isNotNull() & ~unfit)
        .select(
            "vec_id",
            F.when(large, F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling")))
            .otherwise(whole)
            .cast("array<bigint>")
            .alias("x"),
        )
    )


def to_matrix(column: pa.Array, width: int, shift: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector has zeros, which is ``shift``, beyond its end."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(lengths), width), shift, dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Centre:
    """Count and sums of the fit list, and how a batch of vectors is centred by them."""

    def __init__(self, n: int, sums: list[int], shift: int):
        self.n, self.sums, self.shift, self.width = n, sums, shift, len(sums)

    def differences(self, column: pa.Array) -> np.ndarray:
        return exact_differences(to_matrix(column, self.width, self.shift), self.n, self.sums)

    def centred(self, column: pa.Array) -> np.ndarray:
        return self.differences(column).astype(np.float64) / self.n


def task_spectra(fit: DataFrame, centre: Centre) -> DataFrame:
    """part, eigenvalues, vectors: one spectrum for each task, of the sum over its vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        d, q, seen = np.zeros(centre.width), np.eye(centre.width), False
        for batch in batches:
            for v in centre.centred(batch.column(0)) if batch.num_rows else ():
                d, q = rank_one(d, q, v)
                seen = True
        if seen:
            yield state(TaskContext.get().partitionId(), d, q)

    return fit.select("x").mapInArrow(work, STATE)


def state(part: int, d: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([part], pa.int64()),
            "eigenvalues": pa.array([d], pa.list_(pa.float64())),
            "vectors": pa.array([q.ravel()], pa.list_(pa.float64())),
        }
    )


def combined(spectra: DataFrame, fan: int = FAN) -> DataFrame:
    """The spectra of ``fan`` neighbouring parts as one, by an update with each eigenpair."""

    def work(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy())
        first, *others = order.tolist()

        def pairs(row: int) -> tuple[np.ndarray, np.ndarray]:
            d = table.column("eigenvalues")[row].values.to_numpy()
            q = table.column("vectors")[row].values.to_numpy()
            return d, q.reshape(len(d), len(d))

        d, q = pairs(first)
        for row in others:
            values, vectors = pairs(row)
            for n in np.flatnonzero(values > 0):
                d, q = rank_one(d, q, vectors[:, n] * np.sqrt(values[n]))
        part = table.column("part")[first].as_py() // fan
        return pa.Table.from_batches([state(part, d, q)])

    return spectra.groupBy(F.floor(F.col("part") / fan).alias("_group")).applyInArrow(work, STATE)


def gram(fit: DataFrame, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """The covariance of the fit list's projections on the columns of ``basis``."""
    shared = fit.sparkSession.sparkContext.broadcast(basis)
    rows, columns = np.triu_indices(basis.shape[1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((shared.value.shape[1],) * 2)
        for batch in batches:
            if batch.num_rows:
                y = centre.centred(batch.column(0)) @ shared.value
                total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows.astype(np.int32)),
                pa.array(columns.astype(np.int32)),
                pa.array(total[rows, columns]),
            ],
            ["i", "j", "total"],
        )

    sums = fit.select("x").mapInArrow(work, SUMS).groupBy("i", "j").agg(F.sum("total").alias("total"))
    out = np.zeros((basis.shape[1],) * 2)
    for row in sums.collect():  # width squared sums
        out[row.i, row.j] = out[row.j, row.i] = row.total / centre.n
    return out


def spectrum(fit: DataFrame, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of the covariance and their vectors as columns."""
    parts = staged(task_spectra(fit, centre), "spectra")
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts, most = combined(parts), most // FAN
    found = parts.select("vectors").first()
    start = np.array(found.vectors).reshape(centre.width, centre.width)
    basis = np.linalg.qr(start)[0]
    values, turn = np.linalg.eigh(gram(fit, centre, basis))
    vectors = np.linalg.qr(basis @ turn)[0][:, ::-1]
    # the sign in which the largest entry is positive
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(centre.width)]
    return values[::-1], vectors * np.where(largest < 0, -1.0, 1.0)


def whiten(
    rows: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
    id_: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    spark = rows.sparkSession
    whole = staged(whole_vectors(rows, id_, vector, scale, shift), "whole-vectors")
    width = whole.agg(F.max(F.size("x"))).first()[0] or 0
    none = spark.createDataFrame([], OUT + ", identity_error double")
    if not width:
        return none
    padded = F.concat(
        F.col("x"), F.array_repeat(F.lit(shift).cast("bigint"), F.lit(width) - F.size("x"))
    )
    same = whole.select(padded.alias("x")).distinct()
    # a given number of tasks: what follows costs far more than its bytes tell
    fit = staged(same.repartition(tasks(spark), F.xxhash64("x")), "fit-list")
    sums = fit.agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(x[{i}]) AS s{i}") for i in range(width)]
    ).first()
    centre = Centre(sums.n, [sums[f"s{i}"] for i in range(width)], shift)
    if centre.n < 2:
        return none
    values, vectors = spectrum(fit, centre)
    kept = min(components, int((values > FLAT * values[0]).sum())) if values[0] > 0 else 0
    if not kept:
        return none
    scaled = vectors[:, :kept] / np.sqrt(values[:kept])
    error = float(np.abs(gram(fit, centre, scaled) - np.eye(kept)).max())
    explained = values[:kept] / values.sum()
    shared = spark.sparkContext.broadcast(scaled)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(1, kept + 1, dtype=np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            count = batch.num_rows
            differences = centre.differences(batch.column(1))
            y = (differences.astype(np.float64) / centre.n) @ shared.value
            exact = [Decimal(s) for s in exact_squares(differences)]
            place = pa.array(np.repeat(np.arange(count), kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(place),
                    pa.array(np.tile(numbers, count)),
                    pa.array(np.full(count * kept, centre.n)),
                    pa.array(exact, pa.decimal128(38, 0)).take(place),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, count)),
                ],
                [f.split()[0] for f in OUT.split(", ")],
            )

    return whole.mapInArrow(work, OUT).withColumn("identity_error", F.lit(error))
