"""Whitening of embeddings by a one-sided Jacobi SVD behind a blockwise TSQR.

Components become whole numbers, ``floor(256 * c)``. The fit list is each different vector once; its exact sums give the centre. Tasks
centre their rows and reduce them to triangular factors, block by block; factors meet ``FAN`` at a time until one R is left, whose size
depends on the vectors' length alone. Its columns are made orthogonal by plane rotations (Hestenes), several disjoint pairs
at a time: the accumulated rotations are the components, and the columns' norms over the root of n their standard deviations, small
ones as accurately as large ones, since no squares of the data are ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored

COMPONENTS, FAN, ROWS = 4, 32, 4096
#: Entries at or beyond this take their row out: the squares of others are longs.
LARGEST = float(1 << 31)
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, x of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(256 * c) < LARGEST)), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.transform(v, lambda c: F.floor(256 * c))).alias("x")).where("x is not null")


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = _matrix(batch.column(0), width).sum(0)  # below 2**63: a batch has fewer than 2**31 rows
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "total"])

    parts = fit.select("x").mapInArrow(run, "n long, total array<long>")
    n = parts.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = parts.select(F.posexplode("total").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [0] * width
    for r in rows:
        out[r["i"]] = int(r["s"])
    return n, out


def _triangle(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def tsqr(fit: DataFrame, centre: np.ndarray) -> np.ndarray:
    """R of the centred rows: a triangle a task, then of ``FAN`` stacked triangles at a time."""
    width = len(centre)
    schema = "part int, triangle array<double>"

    def emit(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["part", "triangle"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                r = _triangle(np.concatenate([r, _matrix(batch.column(0).slice(first, ROWS), width) - centre]))
        if len(r):
            yield emit(TaskContext.get().partitionId(), r)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, flat in zip(batch.column(0).to_pylist(), batch.column(1)):
                r = flat.values.to_numpy(zero_copy_only=False).reshape(-1, width)
                groups[part // FAN] = _triangle(np.concatenate([groups.get(part // FAN, np.zeros((0, width))), r]))
        for part, r in groups.items():
            yield emit(part, r)

    parts = stored(fit.select("x").mapInArrow(leaf, schema), "triangles")
    while parts.agg(F.max("part").alias("last")).first()["last"]:
        met = stored(parts.repartition(F.expr(f"part div {FAN}")).mapInArrow(join, schema), "triangles")
        discard(parts)
        parts = met
    found = parts.collect()  # one triangle
    discard(parts)
    return np.array(found[0]["triangle"]).reshape(-1, width)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), falling, of a small matrix by one-sided rotations."""
    width = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(width)
    scale = np.abs(a).max(initial=0.0)
    if not scale:
        return np.zeros(width), v
    a /= scale
    seats = list(range(width + width % 2))  # an odd width has one that sits out
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):  # a tournament: every pair meets once a sweep
            pairs = [(min(x, y), max(x, y)) for x, y in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :])) if max(x, y) < width]
            p, q = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            alpha, beta, gamma = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0), (a[:, p] * a[:, q]).sum(0)
            off = np.abs(gamma) / np.maximum(np.sqrt(alpha * beta), np.finfo(float).tiny)
            turn = off > 1e-16
            worst = max(worst, off.max(initial=0.0))
            p, q = p[turn], q[turn]
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst < 4e-15:
            break
    sigma = np.sqrt((a**2).sum(0)) * scale
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row that takes part and each component, from 1.

    Rows without a vector, with a null or non-finite entry, or with one at or beyond 2**31 once multiplied take no part. Null ids stay null, rows
    that repeat come back as often, and equal vectors are fitted once. Vectors of each length are fitted by themselves; an empty one has no component.
    A component along which the fit list does not vary (beyond rounding) has a null ``whitened`` and no part in ``identity_error``; without any variance ``explained`` is null. A deviation
    beyond a long is null. An empty table gives no rows. A component points to where its largest entry is positive.
    """
    rows = stored(whole_numbers(vectors), "whole")
    lengths = sorted(r["d"] for r in rows.select(F.size("x").alias("d")).distinct().collect())
    out = [_whiten(rows.where(F.size("x") == d), d, components) for d in lengths if d]
    return reduce(DataFrame.unionByName, out) if out else vectors.sparkSession.createDataFrame([], OUT)


def _whiten(rows: DataFrame, width: int, components: int) -> DataFrame:
    fit = stored(rows.select("x").distinct(), "fit")
    n, total = _sums(fit, width)
    centre = np.array([s / n for s in total])
    sigma, axes = jacobi(tsqr(fit, centre))
    many = min(components, width)
    largest = np.abs(axes).argmax(0)
    axes = (axes * np.where(axes[largest, np.arange(width)] < 0, -1.0, 1.0))[:, :many]
    deviation = sigma[:many] / np.sqrt(n)
    varies = sigma[:many] > sigma[0] * width * np.finfo(float).eps * 4
    variance = (sigma**2).sum()
    explained = [float(s * s / variance) if variance else None for s in sigma[:many]]

    def project(x: np.ndarray) -> list[pa.Array]:
        with np.errstate(all="ignore"):
            w = (x - centre) @ axes / np.where(varies, deviation, 1.0)
        return [pa.array(w[:, k]) if varies[k] else pa.nulls(len(x), pa.float64()) for k in range(many)]

    names = [f"w{k}" for k in range(many)]

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(project(_matrix(batch.column(0), width)), names)

    inner = [k for k in range(many) if varies[k]]
    pairs = [(i, j) for i in inner for j in inner if i <= j]
    shared = fit.select("x").mapInArrow(fitted, ", ".join(f"{x} double" for x in names))
    spread = shared.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else {}
    error = max((abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs), default=0.0)
    discard(fit)
    whole = max(abs(s) for s in total) + n * int(LARGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(total, np.int64 if whole < 1 << 62 else object)
        for batch in batches:
            x = _matrix(batch.column(1), width)
            gap = n * (x if sums.dtype == np.int64 else x.astype(object)) - sums
            if float(np.abs(gap).max(initial=0)) ** 2 * width < 1 << 62:
                far = pa.array((gap.astype(np.int64) ** 2).sum(1))
            else:
                exact = [sum(int(g) ** 2 for g in row) for row in gap]
                far = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), far, *project(x)], ["vec_id", "deviation", *names])

    wide = rows.mapInArrow(run, f"vec_id long, deviation long, {', '.join(f'{x} double' for x in names)}")
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"), F.lit(explained[k]).cast("double").alias("explained")) for k in range(many)])).alias("c")
    return wide.select("vec_id", "deviation", each).select("vec_id", F.col("c.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))
