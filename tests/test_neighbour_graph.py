"""Overlap joins, exact neighbours by blocks and the neighbour-graph plane."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrove.operators import neighbour_graph as ng
from kinetrove.operators.overlaps import overlapping, within


@pytest.mark.parametrize("width", [1, 7, 64])
def test_overlaps_against_all_pairs(spark, width):
    rng = random.Random(width)
    left = [(rng.choice("ab"), i, lo, lo + rng.randrange(-2, 30)) for i in range(60) for lo in [rng.randrange(-50, 200)]] + [("a", 99, None, 5)]
    right = [(rng.choice("ab"), i, lo, lo + rng.randrange(-2, 90)) for i in range(40) for lo in [rng.randrange(-50, 200)]] + [("a", 99, 3, None)]
    a, b = spark.createDataFrame(left, "clip string, i int, lo long, hi long"), spark.createDataFrame(right, "clip string, j int, start long, stop long")
    got = sorted((r["i"], r["j"]) for r in overlapping(a, b, ["clip"], width).collect())
    whole = lambda r: r[2] is not None and r[3] is not None and r[2] <= r[3]
    assert got == sorted((x[1], y[1]) for x in left for y in right if whole(x) and whole(y) and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_rows_within_intervals(spark, how):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f) for f in range(-20, 300)]
    spans = [("a", 1, 5, 90), ("a", 2, 50, 60), ("b", 3, -10, -10), ("b", 4, 200, 299), ("b", 5, 9, 8)]
    out = within(spark.createDataFrame(rows, "clip string, frame long"), spark.createDataFrame(spans, "clip string, id int, start long, stop long"), ["clip"], width=16, how=how)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = []
    for c, f in rows:
        held = [(c, f, i, a, b) for k, i, a, b in spans if k == c and a <= f <= b]
        want += {"inner": held, "left": held or [(c, f, None, None, None)], "left_semi": [(c, f)] if held else []}[how]
    assert got == sorted(want, key=str)
    assert "SortMergeJoin" in out._jdf.queryExecution().toString() or "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_rows_formed_are_bounded_by_bins(spark):
    """A long interval is a row a bin, not a row a frame."""
    long = spark.createDataFrame([("a", 0, 10**6)], "clip string, start long, stop long")
    some = spark.createDataFrame([("a", f) for f in range(0, 10**6, 10**4)], "clip string, frame long")
    out = within(some, long, ["clip"], width=1 << 16)
    assert out.count() == 100
    assert long.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / (1 << 16)), F.floor(F.col("stop") / (1 << 16))))).count() == 16


def cloud(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2)) * 2
    return np.column_stack([x, np.sin(x[:, 0]), 0.1 * rng.standard_normal(n)])


@pytest.mark.parametrize("n,size", [(300, 32), (300, 1024), (40, 8), (6, 4), (1, 4)])
def test_nearest_rows_are_exact(spark, n, size):
    x = cloud(n)
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(1000 + i, *map(float, x[0])) for i in range(50)] + [(5000, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, d double").repartition(6)
    got = {}
    for r in ng.neighbour_distances(df, ["a", "b", "c", "d"], 5, size).collect():
        got.setdefault(r["key"], {})[r["rank"]] = r["distance"]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    want = np.sort(far, 1)[:, : min(5, n - 1)]
    for key, own in got.items():
        i = key if key < 1000 else 0
        assert sorted(own) == list(range(1, len(want[i]) + 1)) and [own[k] for k in sorted(own)] == pytest.approx(want[i].tolist())
    assert set(got) == (set(range(n)) | set(range(1000, 1050)) if n > 1 else set())


def test_weights_have_their_sum_and_are_united(spark):
    rng = np.random.default_rng(2)
    links = [(i, (i + s) % 40, float(d), k + 1) for i in range(40) for k, (s, d) in enumerate(zip((1, 2, 5, 9, 11, 17), np.sort(rng.uniform(0.1, 3, 6))))]
    got = {(r["node"], r["near"]): r["weight"] for r in ng.weights(spark.createDataFrame(links, "node long, near long, distance double, rank int"), 6).collect()}
    own = {}
    for i in range(40):
        mine = [(j, d) for n, j, d, _ in links if n == i]
        low, high = 0.0, 1e4
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if sum(math.exp(-(d - mine[0][1]) / m) for _, d in mine) < math.log2(6) else (low, m)
        own |= {(i, j): math.exp(-(d - mine[0][1]) / high) for j, d in mine}
    pairs = set(own) | {(j, i) for i, j in own}
    assert set(got) == pairs
    for i, j in pairs:
        a, b = own.get((i, j), 0.0), own.get((j, i), 0.0)
        assert got[i, j] == pytest.approx(a + b - a * b, abs=1e-6)


def trust(x, y, k=15):
    """Share of neighbours in the plane that are neighbours, by how far off the others are (1: all)."""
    n = len(x)
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(near, -1)
    found = np.argsort(near, 1)[:, 1 : k + 1]
    rank = np.argsort(np.argsort(far, 1), 1)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, found, 1) - k, 0).sum()


def test_the_plane_is_trustworthy(spark):
    rng = np.random.default_rng(4)
    turn = rng.uniform(0, 3 * np.pi, 500)
    x = np.column_stack([turn * np.cos(turn), rng.uniform(0, 8, 500), turn * np.sin(turn)])  # a rolled sheet
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(900, *map(float, x[7])), (901, None, 0.0, 0.0)], "key long, a double, b double, c double")
    out = {r["key"]: (r["plane_1"], r["plane_2"]) for r in ng.neighbour_plane(df, ["a", "b", "c"], epochs=10, size=128).collect()}
    assert set(out) == set(range(500)) | {900} and out[900] == out[7]
    assert trust(x, np.array([out[i] for i in range(500)])) >= 0.9
