"""Nearest neighbours by shifted Hilbert curves, and an exact check in blocks.

Vectors are projected to ``DIMS`` dimensions by ``CURVES`` random rotations with
shifts, and each projection orders all vectors along a Hilbert curve. The orders are
range-partitioned and sorted by Spark; a query reranks the ``WINDOW`` vectors before
and after it on each curve by cosine, and the windows' results are merged.

Curves miss neighbours of queries that are far from everything, so a check follows
(``exact``): the sixth best of the windows bounds what can still enter; runs of
vectors along the first curve whose centroid and radius exclude a better one are skipped
and the others compared. Queries go out in blocks of ``QUERY_BLOCK``, whatever their number.

Equal vectors are one class with its smallest ids, so a vector that a third of all rows share
costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

DIMS, BITS, CURVES, WINDOW = 6, 8, 4, 48
QUERY_BLOCK = 4096
RUN = 256


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of integers below 2**bits (Skilling's transform, vectorised)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(unit: np.ndarray, curve: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, curve])
    d = unit.shape[1]
    spread = rng.standard_normal((d, DIMS)) @ np.diag(np.ones(DIMS))
    shift = rng.uniform(0, 1, DIMS)
    places = (unit @ spread) / 8.0 + 0.5 + (shift - 0.5) * 0.25  # four deviations to either side
    return hilbert(np.clip(places * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: angles stay to the last bit, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows with one vector, in one order of summation."""
    x, y = _scaled(x), _scaled(y)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum()))


HITS = "qrep long, cid long, score double"


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    q, c, s = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], ["qrep", "cid", "score"])


def _along_curves(classes: DataFrame, queries: DataFrame, curves: int, window: int, keep: int, seed: int) -> DataFrame:
    rows = classes.select(F.col("cid").alias("id"), "v", F.lit(0).alias("ask")).unionByName(queries.select(F.col("qrep").alias("id"), "v", F.lit(1).alias("ask")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1)))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(curve_keys(unit, c, seed)), *batch.columns], ["curve", "place", "id", "v", "ask"])

    placed = rows.mapInArrow(place, "curve int, place long, id long, v array<double>, ask int")
    ordered = placed.repartitionByRange("curve", "place", "id").sortWithinPartitions("curve", "place", "id", "ask")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None

        def scan(t: pa.Table, lo: int, hi: int) -> list[tuple]:
            """Answers the queries at rows lo .. hi - 1 of ``t``."""
            curve, ids, ask = (t.column(c).to_numpy() for c in ("curve", "id", "ask"))
            asked = [i for i in range(lo, hi) if ask[i]]
            if not asked:
                return []
            x = _matrix(t.column("v").combine_chunks())
            out = []
            for i in asked:
                near = np.arange(max(0, i - window), min(len(ids), i + window + 1))
                near = near[(ask[near] == 0) & (curve[near] == curve[i])]
                if len(near):
                    s = cosine(x[near], x[i])
                    best = np.argsort(-s, kind="stable")[:keep]
                    out += zip([int(ids[i])] * len(best), ids[near[best]].tolist(), s[best].tolist())
            return out

        # a sliding table: `window` rows of history, and answers wait for `window` rows to come
        done = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            tail = t if tail is None else pa.concat_tables([tail, t]).combine_chunks()
            ready = tail.num_rows - window
            if ready > done:
                if rows := scan(tail, done, ready):
                    yield _hits(rows)
                cut = max(0, ready - window)
                tail, done = tail.slice(cut), ready - cut
        if tail is not None and (rows := scan(tail, done, tail.num_rows)):
            yield _hits(rows)

    return ordered.mapInArrow(search, HITS)


def _check(classes: DataFrame, bounds: DataFrame, keep: int, seed: int) -> Iterator[DataFrame]:
    """Classes that reach the bound of a query, by runs of vectors along the first curve.

    The driver holds one block of queries at a time; each block's hits are written before the next is read.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(curve_keys(_unit(_matrix(batch.column(1))), 0, seed)), *batch.columns], ["place", "cid", "v"])

    ordered = stored(classes.mapInArrow(place, "place long, cid long, v array<double>").repartitionByRange("place", "cid").sortWithinPartitions("place", "cid"), "ordered")

    def block(asked: list) -> DataFrame:
        ids = np.array([r["qrep"] for r in asked], np.int64)
        q = np.array([r["v"] for r in asked], np.float64)
        least = np.array([r["bound"] for r in asked]) - 1e-9

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit = _unit(q)
            best: dict[int, list[tuple[float, int]]] = {}
            for batch in batches:
                for first in range(0, batch.num_rows, RUN):
                    part = batch.slice(first, RUN)
                    x, cid = _matrix(part.column(2)), part.column(1).to_numpy()
                    y = _unit(x)
                    centre = y.mean(0)
                    size = np.sqrt((centre * centre).sum())
                    ask = np.arange(len(ids))
                    if size > 1e-9:
                        centre = centre / size
                        radius = np.arccos(np.clip(y @ centre, -1, 1)).max()
                        reach = np.cos(np.maximum(0, np.arccos(np.clip(unit @ centre, -1, 1)) - radius - 1e-7))
                        ask = np.flatnonzero(reach >= least)
                    if not len(ask):
                        continue
                    s = unit[ask] @ y.T
                    for a, i in zip(*np.nonzero(s >= least[ask][:, None])):
                        best.setdefault(int(ask[a]), []).append((int(i), x[i], int(cid[i])))
                    rows = []
                    for k, found in best.items():
                        exact = cosine(np.array([f[1] for f in found]), q[k])
                        order = sorted(range(len(found)), key=lambda j: (-exact[j], found[j][2]))[:keep]
                        rows += [(int(ids[k]), found[j][2], float(exact[j])) for j in order]
                    best.clear()
                    if rows:
                        yield _hits(rows)

        return ordered.select("place", "cid", "v").mapInArrow(run, HITS)

    asked: list = []
    for row in bounds.select("qrep", "v", "bound").toLocalIterator():
        asked.append(row)
        if len(asked) == QUERY_BLOCK:
            yield stored(block(asked), "checked")
            asked = []
    if asked:
        yield stored(block(asked), "checked")


def search(vectors: DataFrame, queries: F.Column | str, k: int = 5, curves: int = CURVES, window: int = WINDOW, exact: bool = True, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each row that ``queries`` selects, itself left out.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    null ids. Only vectors of equal length are compared; each length is searched by itself. Rows that repeat an id and a
    vector are one. Equal scores go by smaller vec_id. An empty table gives no rows.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    mine = reduce(DataFrame.unionByName, [_near(rows.where(F.size("v") == n), queries, k, curves, window, exact, seed) for n in lengths])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _near(rows: DataFrame, queries: F.Column | str, k: int, curves: int, window: int, exact: bool, seed: int) -> DataFrame:
    """query_id, vec_id, score of the nearest vectors of rows of one length; k of them at least where there are so many."""
    keep = k + 1
    same = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.distinct().withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= keep)
    ranked = stored(ranked, "ranked")
    classes = ranked.where("rn = 1").select(F.col("vec_id").alias("cid"), "v")
    members = ranked.select("v", "vec_id").join(classes, "v").select("cid", "vec_id")
    asked = rows.where(queries).distinct()
    heads = stored(asked.groupBy("v").agg(F.min("vec_id").alias("qrep")), "heads")
    asked = asked.join(heads, "v").select("qrep", F.col("vec_id").alias("query_id"))
    found = stored(_along_curves(classes, heads, curves, window, keep, seed), "windows")
    by_query = Window.partitionBy("qrep").orderBy(F.desc("score"), "cid")
    if exact:
        best = found.groupBy("qrep", "cid").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= keep)
        bound = best.groupBy("qrep").agg(F.when(F.count(F.lit(1)) == keep, F.min("score")).otherwise(F.lit(-2.0)).alias("bound"))
        bounds = stored(heads.join(bound, "qrep", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0))), "bounds")
        for more in _check(classes, bounds, keep, seed):
            found = found.unionByName(more)
    best = found.groupBy("qrep", "cid").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= keep)
    near = best.join(members, "cid").select("qrep", "vec_id", "score")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("qrep").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= keep).drop("r")
    return near.join(asked, "qrep").where("vec_id != query_id").select("query_id", "vec_id", "score")
