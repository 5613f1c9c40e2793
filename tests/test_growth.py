"""Steps whose cost must not grow faster than the input: rounds of changepoints, neighbours, votes."""

import random

import numpy as np
from pyspark.sql import functions as F

from kinetrove.operators import changepoint as cp
from kinetrove.operators import neighbour_graph as ng
from kinetrove.operators import region


def test_gaps_between_frames_make_no_more_rounds(spark):
    """A few rows a clip are one range, however far apart their frames are; a long clip has ranges of bounded length."""
    rng = random.Random(3)
    rows = [(c, 1000 * k + ord(c), rng.randrange(2)) for c in "abc" for k in range(120)] + [("long", k, rng.randrange(2)) for k in range(450)]
    got = cp._packed(spark.createDataFrame(rows, "clip string, frame long, hit int"), 100).select("clip", "round", F.size("rows").alias("n"), F.col("rows.frame").alias("f")).collect()
    of = lambda c: sorted((r["round"], r["n"]) for r in got if r["clip"] == c)
    assert all(of(c) == [(0, 100), (1, 20)] for c in "abc") and of("long") == [(0, 100), (1, 100), (2, 100), (3, 100), (4, 50)]
    for c in ("a", "long"):
        along = [f for r in sorted((r for r in got if r["clip"] == c), key=lambda r: r["round"]) for f in r["f"]]
        assert along == sorted(f for k, f, _ in rows if k == c)


def test_clips_of_unequal_length_end_in_their_own_round(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for clip, n, step in (("a", 300, 1), ("b", 40, 997), ("c", 130, 13), ("d", 1, 1)):
        x = [int(rng.random() < (0.1, 0.9)[k // 25 % 2]) for k in range(n)]
        frames = [5 + step * k for k in range(n)]
        rows += [(clip, f, 10.0 if v else 30.0) for f, v in zip(frames, x)]
        start = event = 0
        for stop in cp.changepoints(x, 2, 1.0) or [n]:
            held = 2 * sum(x[start:stop]) > stop - start
            want |= {(clip, f): event if held else -1 for f in frames[start:stop]}
            event, start = event + held, stop
    got = cp.threshold_events(spark.createDataFrame(rows, "clip string, frame long, v double"), "v", 25.0, penalty=1.0, chunk=64).collect()
    assert {(r["clip"], r["frame"]): r["event_id"] for r in got} == want and len(got) == len(rows)


def test_cells_have_equal_shares_and_blocks_are_small():
    x = np.random.default_rng(1).standard_normal((5000, 3)) ** 3
    cells = np.bincount(ng._cell_of(x, *ng._cells(x[::4], 4)))
    assert len(cells) == 16 and cells.min() > 200 and cells.max() < 450
    blocks = ng._blocks(x, 64)
    assert max(map(len, blocks)) <= 64 and sorted(np.concatenate(blocks).tolist()) == list(range(5000))
    assert not ng._cell_of(x, *ng._cells(x[:0], 0)).any()


def test_neighbours_of_cells_are_exact_and_few_blocks_are_asked(spark, monkeypatch):
    """Rows spread in three columns: a row is compared with the rows of a few blocks, not with a slice of one axis."""
    asked = {}
    store = ng.stored

    def seen(df, name):
        out = store(df, name)
        if name == "asked":
            asked[name] = out.agg(F.sum(F.size("node"))).first()[0]
        return out

    monkeypatch.setattr(ng, "stored", seen)
    x = np.random.default_rng(5).uniform(size=(4000, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "key long, a double, b double, c double")
    got = {(r["key"], r["rank"]): r["distance"] for r in ng.neighbour_distances(df, ["a", "b", "c"], 4, 32).collect()}
    far = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 1)[:, 1:5]
    assert len(got) == 16000 and max(abs(got[i, k + 1] - far[i, k]) for i in range(4000) for k in range(4)) < 1e-12
    assert asked["asked"] < 12 * 4000  # of 125 blocks


def test_votes_are_summed_in_tasks_that_do_not_grow(spark, monkeypatch):
    """Ten times the clips are about ten times the tasks, each with whole circles' cells of its own."""
    monkeypatch.setattr(region, "VOTES", 1 << 12, raising=False)
    edges = lambda n: spark.createDataFrame([(f"c{c}", 20 + k, 20) for c in range(n) for k in range(9)], "clip string, cx int, cy int").coalesce(1)
    rows = {}
    for n in (4, 40):
        votes = region.circle_votes(edges(n), range(3, 8), 60, 60)
        held = votes.groupBy(F.spark_partition_id().alias("task")).count().collect()
        rows[n] = [r["count"] for r in held]
        assert votes.agg(F.sum("votes")).first()[0] == n * 9 * sum(map(region.ring, range(3, 8)))
    assert len(rows[40]) > 4 * len(rows[4]) and max(rows[40]) < 4 * max(rows[4])


def test_epochs_of_the_layout_keep_rows_in_parts_and_move_them_right(spark, monkeypatch):
    """An epoch stores a row a part, not a row a node, and moves nodes as the direct sums say."""
    n, epochs, samples, seed = 20_000, 3, 5, 7
    written = []
    store = ng.stored

    def seen(df, name):
        out = store(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(ng, "stored", seen)
    rng = np.random.default_rng(6)
    y = rng.uniform(-9, 9, (n, 2))
    links = [(i, (i + s) % n) for i in range(n - 5) for s in (1, n - 1, 7777, 12_345)]  # the last five have none
    weight = rng.uniform(0.1, 1, len(links))
    places = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "i long, y1 double, y2 double")
    table = spark.createDataFrame([(*ij, float(w)) for ij, w in zip(links, weight)], "i long, j long, weight double")
    got = {r["i"]: (r["y1"], r["y2"]) for r in ng.layout(places, table, n, epochs, samples, seed=seed).collect()}
    a, b = np.array(links).T
    share = (weight / np.bincount(a, weights=weight, minlength=n)[a])[:, None]
    for epoch in range(epochs):
        hashes = spark.range(n).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(epoch), F.lit(s), F.lit(seed)), F.lit(n)) for s in range(samples)]).alias("j")).orderBy("id").collect()
        j = np.array([r["j"] for r in hashes]).ravel()
        i = np.repeat(np.arange(n), samples)
        force = np.zeros_like(y)
        for at, other, share_of, pull in ((a, b, share, True), (i[i != j], j[i != j], 0.2, False)):
            gap = y[at] - y[other]
            d = np.maximum((gap**2).sum(1), 1e-12)[:, None]
            factor = -2 * ng.CURVE_A * ng.CURVE_B * d ** (ng.CURVE_B - 1) / (1 + ng.CURVE_A * d**ng.CURVE_B) if pull else 2 * ng.CURVE_B / ((0.001 + d) * (1 + ng.CURVE_A * d**ng.CURVE_B))
            np.add.at(force, at, share_of * np.clip(factor * gap, -4, 4))
        y = y + (1 - epoch / epochs) * force
    assert sorted(got) == list(range(n)) and max(np.abs(np.array(got[k]) - y[k]).max() for k in range(n)) < 1e-9
    assert sum(name == "places" for name, _ in written) == epochs + 1 and all(count <= 3 for name, count in written if name == "places")


def test_a_plane_of_no_rows_and_of_one(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0), (3, 2.0, 3.0)], "key long, a double, b double")
    assert ng.neighbour_plane(rows.where("a is null"), ["a", "b"]).count() == 0
    got = ng.neighbour_plane(rows, ["a", "b"]).collect()
    assert {r["key"] for r in got} == {1, 3} and len({(r["plane_1"], r["plane_2"]) for r in got}) == 1
