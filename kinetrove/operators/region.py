"""The region of each clip, found from an image mask: hue or occupancy, clean-up, edges, circles.

A mask is a table (clip, cx, cy) of the cells that are set, on a grid of ``width`` by ``height`` cells; an image of any size is many
rows. Neighbourhoods are met by equi-joins on cells or by spreading each cell to its neighbours and summing up; connected areas are labelled in tiles, and
labels that touch across the borders of tiles are joined as links of a graph. All weights are whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, each_row, stored
from .components import components

TILE, VOTES = 32, 1 << 21
#: Binomial weights (a Gaussian of one cell) and those of its slope, over -2 .. 2 (fixed values).
SMOOTH, SLOPE = [1, 4, 6, 4, 1], [-1, -2, 0, 2, 1]
STEEPEST = sum(SMOOTH) * sum(x for x in SLOPE if x > 0)
AREA = "clip string, tx int, ty int, node long, cells array<int>"


def hue(red: Column, green: Column, blue: Column) -> Column:
    """The hue of a colour, from 0 to below 1; greys have 0."""
    r, g, b = (c.cast("double") for c in (red, green, blue))
    top = F.greatest(r, g, b)
    spread = top - F.least(r, g, b)
    turn = F.when(r == top, (g - b) / spread).when(g == top, 2 + (b - r) / spread).otherwise(4 + (r - g) / spread)
    return F.when(spread > 0, F.pmod(turn / 6, F.lit(1.0))).when(spread == 0, 0.0)


def hue_mask(pixels: DataFrame, low: float = 0.4, high: float = 0.5) -> DataFrame:
    """Cells of an image (clip, cx, cy, red, green, blue) whose hue lies between ``low`` and ``high``, ends excluded."""
    at = hue(F.col("red"), F.col("green"), F.col("blue"))
    return pixels.where((at > low) & (at < high)).select("clip", "cx", "cy")


def occupancy(pose: DataFrame, cell: int, least: int, width: int, height: int) -> DataFrame:
    """Cells of ``cell`` pixels that hold at least ``least`` points of a clip; points outside the image count nowhere."""
    at = pose.select("clip", F.floor(F.col("x") / cell).cast("int").alias("cx"), F.floor(F.col("y") / cell).cast("int").alias("cy"))
    at = at.where((F.col("cx") >= 0) & (F.col("cx") < width) & (F.col("cy") >= 0) & (F.col("cy") < height))
    return at.groupBy("clip", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("clip", "cx", "cy")


def label_tile(grid: np.ndarray) -> np.ndarray:
    """The least cell number of each set cell's 4-connected area in a small grid; unset cells have the grid's size."""
    none = grid.size
    label = np.where(grid, np.arange(none).reshape(grid.shape), none)
    while True:
        edge = np.pad(label, 1, constant_values=none)
        near = np.minimum.reduce([label, edge[:-2, 1:-1], edge[2:, 1:-1], edge[1:-1, :-2], edge[1:-1, 2:]])
        near = np.where(grid, near, none)
        near = np.append(near.ravel(), none)[near]  # a label's own label is of the same area
        if np.array_equal(near, label):
            return label
        label = near


def tile_areas(mask: DataFrame, width: int, height: int, on: bool, tile: int = TILE) -> DataFrame:
    """(clip, tx, ty, node, cells): the 4-connected areas of set (or unset) cells within each tile; a task holds one tile at a time.

    cells are numbered row by row in the tile; node is unique in the clip.
    """
    across, down = -(-width // tile), -(-height // tile)
    own = ((F.col("cy") % tile) * tile + F.col("cx") % tile).cast("int")
    tx, ty = F.floor(F.col("cx") / tile).cast("int").alias("tx"), F.floor(F.col("cy") / tile).cast("int").alias("ty")
    held = mask.groupBy("clip", tx, ty).agg(F.collect_set(own).alias("set"))  # at most a tile's cells
    if not on:  # tiles without a set cell are all background
        every = mask.select("clip").distinct().select("clip", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("tx")).select("clip", "tx", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("ty"))
        held = every.join(held, ["clip", "tx", "ty"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                rows = []
                grid = np.zeros(tile * tile, bool)
                grid[np.array(r["set"] or [], np.int64)] = True
                grid = (grid if on else ~grid).reshape(tile, tile)
                grid[max(0, height - r["ty"] * tile) :] = False
                grid[:, max(0, width - r["tx"] * tile) :] = False
                label = label_tile(grid).ravel()
                cells = np.flatnonzero(label < tile * tile)
                cells = cells[np.argsort(label[cells], kind="stable")]
                names, first = np.unique(label[cells], return_index=True)
                for name, some in zip(names.tolist(), np.split(cells, first[1:])):
                    rows.append((r["clip"], r["tx"], r["ty"], (r["ty"] * across + r["tx"]) * tile * tile + name, some.tolist()))
                if not rows:
                    continue
                kinds = pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["clip", "tx", "ty", "node", "cells"])

    return held.select("clip", "tx", "ty", "set").mapInArrow(run, AREA)


def _touching(areas: DataFrame, tile: int) -> DataFrame:
    """(clip, a, b): areas that meet across a border of tiles. Each border cell is keyed by its line and its place on it; the sides meet by equi-joins."""
    cells = areas.select("clip", "tx", "ty", "node", F.explode("cells").alias("c")).withColumns({"lx": F.col("c") % tile, "ly": F.floor(F.col("c") / tile)})
    x, y = F.col("tx") * tile + F.col("lx"), F.col("ty") * tile + F.col("ly")
    sides = []
    for axis, place, here, there in ((0, "lx", x, y), (1, "ly", y, x)):
        a, b = (cells.where(F.col(place) == at).select("clip", F.lit(axis).alias("axis"), (here + step).alias("line"), there.alias("spot"), F.col("node").alias(n)) for at, step, n in ((tile - 1, 1, "a"), (0, 0, "b")))
        sides.append(a.join(b, ["clip", "axis", "line", "spot"]).select("clip", "a", "b"))
    return sides[0].unionByName(sides[1]).distinct()


def flip_small(mask: DataFrame, width: int, height: int, on: bool, least: int, tile: int = TILE) -> DataFrame:
    """The mask without 4-connected areas of fewer than ``least`` cells: set ones are dropped (``on``), or unset ones filled.

    The background of a clip without a set cell is not looked at.
    """
    areas = stored(tile_areas(mask, width, height, on, tile), "areas")
    found = components(_touching(areas, tile), ["clip"])
    areas_of = areas.join(found, ["clip", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    sizes = areas_of.groupBy("clip", "component").agg(F.sum(F.size("cells")).alias("n"))
    change = areas_of.join(sizes.where((F.col("n") >= least) if on else (F.col("n") < least)), ["clip", "component"], "left_semi")
    cell = F.explode("cells").alias("c")
    cells = change.select("clip", "tx", "ty", cell).select("clip", (F.col("tx") * tile + F.col("c") % tile).cast("int").alias("cx"), (F.col("ty") * tile + F.floor(F.col("c") / tile)).cast("int").alias("cy"))
    out = stored(cells if on else mask.select("clip", "cx", "cy").unionByName(cells), "mask")
    discard(areas)
    return out


def clean_mask(mask: DataFrame, width: int, height: int, hole: int, speck: int, tile: int = TILE) -> DataFrame:
    """The mask with holes of fewer than ``hole`` cells filled, then areas of fewer than ``speck`` cells dropped."""
    filled = flip_small(mask.distinct(), width, height, False, hole, tile)
    out = flip_small(filled, width, height, True, speck, tile)
    discard(filled)
    return out


def _spread(rows: DataFrame, axis: str, sums: dict[str, tuple[str, list[int]]]) -> DataFrame:
    """Each row's values sent to the cells up to two away along ``axis``, times a weight by distance, and summed up there."""
    reach = F.explode(F.array(*[F.lit(u) for u in range(-2, 3)])).alias("u")
    rows = rows.select("*", reach)
    weight = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("u") + 3)
    to = (F.col(axis) - F.col("u")).alias(axis)
    cells = [to if c == axis else F.col(c) for c in ("cx", "cy")]
    return rows.groupBy("clip", *cells).agg(*[F.sum(F.col(value) * weight(kernel)).alias(name) for name, (value, kernel) in sums.items()])


def gradient(mask: DataFrame, width: int, height: int) -> DataFrame:
    """(clip, cx, cy, gx, gy, m): slope of the smoothed mask and its square, where it is not zero; outside the image nothing is set."""
    ones = mask.select("clip", "cx", "cy", F.lit(1).cast("long").alias("one"))
    along = _spread(ones, "cx", {"s": ("one", SMOOTH), "d": ("one", SLOPE)})
    both = _spread(along, "cy", {"gx": ("d", SMOOTH), "gy": ("s", SLOPE)})
    both = both.where((F.col("cx") >= 0) & (F.col("cx") < width) & (F.col("cy") >= 0) & (F.col("cy") < height))
    return both.withColumn("m", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).where("m > 0")


def edges(mask: DataFrame, width: int, height: int, low: float = 0.1, high: float = 0.2) -> DataFrame:
    """(clip, cx, cy, gx, gy): thin edges, where the slope is the largest across the edge and, or by 8-neighbours along an edge, steep enough.

    ``low`` and ``high`` are shares of the steepest slope there is. Of two equal slopes across an edge the one further along counts.
    """
    slope = stored(gradient(mask, width, height), "slope")
    ax, ay = F.abs("gx"), F.abs("gy")
    flat, upright = 5 * ay <= 2 * ax, 5 * ax <= 2 * ay  # within 22 degrees of an axis
    dx = F.when(upright, 0).otherwise(1)
    dy = F.when(flat, 0).when(upright, 1).when((F.col("gx") > 0) == (F.col("gy") > 0), 1).otherwise(-1)
    rows = slope.where(F.col("m") >= (low * STEEPEST) ** 2).withColumns({"dx": dx, "dy": dy})
    for name, sign in (("before", -1), ("after", 1)):
        rows = rows.withColumns({"nx": F.col("cx") + sign * F.col("dx"), "ny": F.col("cy") + sign * F.col("dy")})
        rows = rows.join(slope.select("clip", F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("m").alias(name)), ["clip", "nx", "ny"], "left")
    thin = rows.where("m >= coalesce(before, 0) and m > coalesce(after, 0)").select("clip", "cx", "cy", "gx", "gy", (F.col("cy").cast("long") * width + F.col("cx")).alias("node"), (F.col("m") >= (high * STEEPEST) ** 2).alias("strong"))
    thin = stored(thin, "thin")
    ahead = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 0), (-1, 1), (0, 1), (1, 1))])).alias("o")
    steps = thin.select("clip", F.col("node").alias("a"), "cx", "cy", ahead).select("clip", "a", (F.col("cx") + F.col("o.x")).alias("cx"), (F.col("cy") + F.col("o.y")).alias("cy"))
    links = steps.join(thin.select("clip", "cx", "cy", F.col("node").alias("b")), ["clip", "cx", "cy"]).select("clip", "a", "b")
    thin_of = thin.join(components(links, ["clip"]), ["clip", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    firm = thin_of.groupBy("clip", "component").agg(F.bool_or("strong").alias("strong")).where("strong")
    out = stored(thin_of.join(firm.select("clip", "component"), ["clip", "component"], "left_semi").select("clip", "cx", "cy", "gx", "gy"), "edges")
    discard(slope, thin)
    return out


def ring(radius: int) -> int:
    """The number of cells of a circle: those whose distance from the centre rounds to the radius."""
    return sum((2 * radius - 1) ** 2 < 4 * (x * x + y * y) < (2 * radius + 1) ** 2 for x in range(-radius, radius + 1) for y in range(-radius, radius + 1))


def circle_votes(found: DataFrame, radii: range, width: int, height: int) -> DataFrame:
    """(clip, r, cx, cy, votes, score): for each radius, the edge cells whose circle passes through a cell, as a count and as a share of a whole circle.

    An edge cell votes for all centres at the radius; a row's circle is spelt out in place. Before that the rows are dealt out by clip and radius to tasks of
    about ``VOTES`` votes, so the sums that a task holds do not grow with the number of clips; one clip's sums at a radius are a cell each at most.
    """
    parts = max(1, -(-found.count() * sum(map(ring, radii)) // VOTES))
    r, dx = F.col("r"), F.col("dx")
    rows = found.select("clip", "cx", "cy", F.explode(F.array(*map(F.lit, radii))).alias("r")).repartition(parts, "clip", "r")
    rows = rows.select("*", F.explode(F.sequence(-r, r)).alias("dx"))
    # odd numbers: their half roots are never whole
    near, far = F.sqrt(F.greatest((2 * r - 1) * (2 * r - 1) - 4 * dx * dx, F.lit(0)).cast("double")) / 2, F.sqrt(((2 * r + 1) * (2 * r + 1) - 4 * dx * dx).cast("double")) / 2
    rows = rows.withColumns({"lo": F.ceil(near).cast("int"), "hi": F.floor(far).cast("int")}).where("lo <= hi")
    up = F.sequence("lo", "hi")
    rows = rows.select("clip", "r", (F.col("cx") + dx).alias("cx"), F.col("cy").alias("y"), F.explode(F.array_distinct(F.concat(up, F.transform(up, lambda d: -d)))).alias("dy"))
    rows = rows.select("clip", "r", "cx", (F.col("y") + F.col("dy")).alias("cy")).where((F.col("cx") >= 0) & (F.col("cx") < width) & (F.col("cy") >= 0) & (F.col("cy") < height))
    sums = rows.groupBy("clip", "r", "cx", "cy").agg(F.count(F.lit(1)).alias("votes"))
    whole = F.create_map(*[F.lit(x) for k in radii for x in (k, ring(k))])
    return sums.withColumn("score", F.col("votes") / whole[F.col("r")])


def best_circle(votes: DataFrame) -> DataFrame:
    """(clip, r, cx, cy, score): the largest score of each clip; of equal ones the smallest radius, then the upper, then the left one."""
    best = votes.groupBy("clip").agg(F.max(F.struct("score", (-F.col("r")).alias("r"), (-F.col("cy")).alias("cy"), (-F.col("cx")).alias("cx"))).alias("b"))
    return best.select("clip", *[(-F.col(f"b.{c}")).alias(c) for c in ("r", "cx", "cy")], "b.score")


def peaks(votes: DataFrame, most: int = 3, share: float = 0.5, near: int = 2, step: int = 1) -> DataFrame:
    """(clip, rank, r, cx, cy, score): the first ``most`` circles that no better one is near, among those with ``share`` of the clip's best score.

    Near: up to ``near`` cells off in either direction, at the same radius or the next (``step``). Equal scores go as in ``best_circle``; one of two near ones stays.
    """
    top = votes.groupBy("clip").agg(F.max("score").alias("top"))
    some = votes.join(top, "clip").where(F.col("score") >= share * F.col("top")).select("clip", "r", "cx", "cy", "score")
    some = some.withColumn("order", F.struct("score", (-F.col("r")).alias("r"), (-F.col("cy")).alias("cy"), (-F.col("cx")).alias("cx")))
    steps = [(r, x, y) for r in (-step, 0, step) for x in range(-near, near + 1) for y in range(-near, near + 1)]
    to = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(x).alias("x"), F.lit(y).alias("y")) for r, x, y in steps])).alias("o")
    seen = some.select("clip", "r", "cx", "cy", "order", to).groupBy("clip", (F.col("r") + F.col("o.r")).alias("r"), (F.col("cx") + F.col("o.x")).alias("cx"), (F.col("cy") + F.col("o.y")).alias("cy")).agg(F.max("order").alias("best"))
    kept = some.join(seen, ["clip", "r", "cx", "cy"]).where(F.col("order") == F.col("best"))
    rank = F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("order")))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).select("clip", "rank", "r", "cx", "cy", "score")


def region_table(circles: DataFrame, cell: int = 1) -> DataFrame:
    """(clip, roi_x, roi_y, roi_r) in pixels of circles in cells."""
    return circles.select("clip", ((F.col("cx") + 0.5) * cell).alias("roi_x"), ((F.col("cy") + 0.5) * cell).alias("roi_y"), (F.col("r") * cell).cast("double").alias("roi_r"))


def estimate(mask: DataFrame, width: int, height: int, radii: range, hole: int, speck: int) -> DataFrame:
    """(clip, r, cx, cy, score): the most likely circle around the mask of each clip."""
    cleaned = clean_mask(mask, width, height, hole, speck)
    found = edges(cleaned, width, height)
    out = stored(best_circle(circle_votes(found, radii, width, height)), "circles")
    discard(cleaned, found)
    return out
