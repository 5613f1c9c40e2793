"""Region estimation on planted masks, against plain Python."""

import colorsys
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrove.operators import region
from kinetrove.operators.components import components

MASK = "clip string, cx int, cy int"


def flood(cells):
    """4-connected areas of a set of cells."""
    left, out = set(cells), []
    while left:
        todo, area = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            area.add((x, y))
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in left:
                    left.remove(c)
                    todo.append(c)
        out.append(area)
    return out


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["clip"], set()).add((r["cx"], r["cy"]))
    return out


def test_labels_of_a_tile_follow_winding_areas():
    grid = np.zeros((9, 9), bool)
    grid[0] = grid[2] = grid[4] = grid[6] = grid[8] = True
    grid[1, 8] = grid[3, 0] = grid[5, 8] = True  # the last row stands alone
    label = region.label_tile(grid)
    assert set(label[grid].tolist()) == {0, 72} and (label[~grid] == 81).all() and (label[8] == 72).all()


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_small_areas_are_filled_and_dropped_across_tiles(spark, tile):
    rng = random.Random(tile)
    width, height = 37, 29
    clips = {c: {(x, y) for x in range(width) for y in range(height) if rng.random() < p} for c, p in (("a", 0.45), ("b", 0.6), ("c", 0.75), ("d", 0.02))}
    ring = {(x, y) for x in range(width) for y in range(height) if 64 <= (x - 18) ** 2 + (y - 14) ** 2 <= 121}
    clips["e"] = ring | {(0, 0)}
    mask = spark.createDataFrame([(c, *xy) for c, cells in clips.items() for xy in cells] * 2, MASK)
    every = {(x, y) for x in range(width) for y in range(height)}
    want = {}
    for c, cells in clips.items():
        filled = set(cells).union(*[a for a in flood(every - cells) if len(a) < 300])
        want[c] = set().union(*[a for a in flood(filled) if len(a) >= 12])
    got = rows_of(region.clean_mask(mask, width, height, 300, 12, tile))
    assert got == {c: cells for c, cells in want.items() if cells}
    assert (18, 14) in got["e"] and (0, 0) not in got["e"]  # the ring's inside is filled, the speck is gone


@pytest.mark.parametrize("centre,radius", [((30, 33), 12), ((41, 22), 9), ((20, 20), 15)])
def test_a_planted_circle_is_found_within_a_cell(spark, centre, radius):
    rng = random.Random(radius)
    inside = {(x, y) for x in range(70) for y in range(60) if (x - centre[0]) ** 2 + (y - centre[1]) ** 2 <= radius**2}
    cells = {c for c in inside if rng.random() < 0.8} | {(rng.randrange(70), rng.randrange(60)) for _ in range(40)}
    mask = spark.createDataFrame([("a", *c) for c in cells], MASK)
    r = region.estimate(mask, 70, 60, range(6, 20), 200, 30).first()
    assert abs(r["cx"] - centre[0]) <= 1 and abs(r["cy"] - centre[1]) <= 1 and abs(r["r"] - radius) <= 1


def test_edges_are_thin_closed_and_of_the_right_slope(spark):
    square = {(x, y) for x in range(10, 20) for y in range(8, 22)}
    found = {(r["cx"], r["cy"]): (r["gx"], r["gy"]) for r in region.edges(spark.createDataFrame([("a", *c) for c in square], MASK), 40, 40).collect()}
    assert all(g[0] > 0 for (x, y), g in found.items() if x < 12 and 11 < y < 18) and all(g[1] < 0 for (x, y), g in found.items() if y > 20 and 12 < x < 17)
    assert len({x for x, y in found if y == 15}) == 2 and len({y for x, y in found if x == 15}) == 2
    assert region.edges(spark.createDataFrame([], MASK), 40, 40).count() == 0


def test_weak_edges_need_a_strong_one(spark):
    line = spark.createDataFrame([("a", x, 20) for x in range(40)] + [("b", 5, 5)], MASK)
    assert region.edges(line, 40, 40, 0.1, 0.99).count() == 0 and region.edges(line, 40, 40, 0.1, 0.2).count() > 0


def test_votes_are_circles_and_ties_go_to_the_first(spark):
    one = spark.createDataFrame([("a", 20, 20)], MASK)
    got = {(r["r"], r["cx"], r["cy"]) for r in region.circle_votes(one, range(3, 8, 2), 41, 41).collect()}
    want = {(r, 20 + x, 20 + y) for r in (3, 5, 7) for x in range(-8, 9) for y in range(-8, 9) if round((x * x + y * y) ** 0.5) == r}
    assert got == want and all(region.ring(r) == sum(k == r for k, _, _ in want) for r in (3, 5, 7))
    votes = spark.createDataFrame([("a", 5, 9, 9, 0.5), ("a", 4, 9, 9, 0.5), ("a", 4, 8, 9, 0.5), ("a", 4, 7, 8, 0.5), ("a", 9, 1, 1, 0.4), ("a", 9, 2, 1, 0.4), ("b", 1, 1, 1, 0.1)], "clip string, r int, cx int, cy int, score double")
    assert [tuple(r) for r in region.best_circle(votes).orderBy("clip").collect()] == [("a", 4, 7, 8, 0.5), ("b", 1, 1, 1, 0.1)]
    assert [tuple(r)[1:5] for r in region.peaks(votes).where("clip = 'a'").orderBy("rank").collect()] == [(1, 4, 7, 8), (2, 9, 1, 1)]


def test_hue(spark):
    rng = random.Random(3)
    colours = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(300)] + [(0, 0, 0), (9, 9, 9), (255, 0, 0), (255, 0, 255)]
    df = spark.createDataFrame(colours, "r int, g int, b int").select("*", region.hue(F.col("r"), F.col("g"), F.col("b")).alias("h"))
    for r in df.collect():
        assert r["h"] == pytest.approx(colorsys.rgb_to_hsv(r["r"] / 255, r["g"] / 255, r["b"] / 255)[0], abs=1e-12)


def test_components_of_chains_stars_and_cycles(spark):
    links = [("a", i, i + 1) for i in range(60)] + [("a", 100, k) for k in range(101, 140)] + [("a", 203, 201), ("a", 201, 202), ("a", 202, 203)] + [("b", 5, 4), ("b", 9, 9)]
    got = {(r["clip"], r["node"]): r["component"] for r in components(spark.createDataFrame(links, "clip string, a long, b long"), ["clip"]).collect()}
    assert got == {("a", i): 0 for i in range(61)} | {("a", i): 100 for i in range(100, 140)} | {("a", i): 201 for i in (201, 202, 203)} | {("b", 4): 4, ("b", 5): 4}
    assert components(spark.createDataFrame([], "clip string, a long, b long"), ["clip"]).count() == 0
