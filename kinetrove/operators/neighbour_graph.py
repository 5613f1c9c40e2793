"""A plane for many columns by a weighted neighbour graph: near rows attract, sampled others repel.

Rows are dealt to cells, boxes of all columns whose bounds are fitted on some rows, and packed into blocks, smaller boxes. A row's k-th nearest
row in its own block bounds how far its neighbours can lie, so it is compared with the rows of those blocks alone whose box it reaches: a few, however many
rows there are. The k nearest are exact. Each row's distances become weights by a bandwidth of its own, the two directions of a
link are united, and epochs of attraction along links and repulsion from hashed samples move the rows, each epoch one stored table of parts of rows, which
tell each other the places that their links and samples need.
No table of all rows reaches the driver or a single task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, stored
from .projection import principal_plane

BLOCK = 1024
#: The curve of attraction for rows that may come as near as 0.1 (fixed values).
CURVE_A, CURVE_B = 1.577, 0.895
#: Cells at most, rows a cell in blocks, and rows that the cells are fitted on at most; the neighbours do not depend on them.
CELLS, BLOCKS_A_CELL, FITTED = 1024, 16, 1 << 15
PACKED = "cell int, block long, lo array<double>, hi array<double>, node array<long>, v array<double>, bound array<double>"
ASKED = "other long, node array<long>, v array<double>, bound array<double>"
#: Rows of a part of the layout.
PART = 1 << 13
PLACES, ASKS = "part long, y binary", "part long, asker long, at binary, place binary"


def _cells(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) of a tree that halves rows ``depth`` times across their widest column, the children of i being 2i + 1 and 2i + 2."""
    axis, cut, parts = [], [], [x]
    for _ in range(depth):
        halves = []
        for some in parts:
            c = int(np.ptp(some, 0).argmax()) if len(some) else 0
            at = float(np.median(some[:, c])) if len(some) else 0.0
            axis.append(c)
            cut.append(at)
            halves += [some[some[:, c] < at], some[some[:, c] >= at]]
        parts = halves
    return np.array(axis, np.int64), np.array(cut)


def _cell_of(x: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    at, each = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(len(axis).bit_length()):  # a level of the tree each
        at = 2 * at + 1 + (x[each, axis[at]] >= cut[at])
    return at - len(axis)


def _blocks(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of rows in blocks of at most ``size``, halved across the widest column."""
    todo, out = [np.arange(len(x))], []
    while todo:
        some = todo.pop()
        if len(some) <= size:
            out.append(some)
            continue
        values = x[some]
        order = np.argpartition(values[:, np.ptp(values, 0).argmax()], len(some) // 2)
        todo += [some[order[len(some) // 2 :]], some[order[: len(some) // 2]]]
    return out


def _row(batch: pa.RecordBatch, name: str, at: int) -> np.ndarray:
    return batch.column(name)[at].values.to_numpy(zero_copy_only=False)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([*values, np.zeros(0)]) if kind == pa.float64() else np.concatenate(values), kind))


def _pack(width: int, size: int, k: int):
    """The blocks of partitions (cell, node, v) sorted by cell: their bounding boxes, rows, and for each row the distance of its k-th nearest in the block."""

    def emit(cell: int, held: list) -> Iterator[pa.RecordBatch]:
        node, x = np.concatenate([n for n, _ in held]), np.concatenate([x for _, x in held])
        for block, at in enumerate(_blocks(x, size)):
            some = x[at]
            _, far = _nearest(some, some, k, True)
            bound = far[:, k - 1] if len(some) > k else np.full(len(some), np.inf)
            values = pa.array([cell], pa.int32()), pa.array([cell << 32 | block], pa.int64()), _lists([some.min(0)], pa.float64()), _lists([some.max(0)], pa.float64()), _lists([node[at]], pa.int64()), _lists([some.ravel()], pa.float64()), _lists([bound], pa.float64())
            yield pa.RecordBatch.from_arrays(list(values), [f.split(" ")[0] for f in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], -1
        for batch in batches:
            cell, node = batch.column("cell").to_numpy(), batch.column("node").to_numpy()
            x = batch.column("v").flatten().to_numpy().reshape(-1, width)
            edges = np.flatnonzero(np.diff(cell, prepend=last))
            for at, to in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)]):
                if at in edges and held:
                    yield from emit(last, held)
                    held = []
                if to > at:
                    held.append((node[at:to], x[at:to]))
                    last = int(cell[at])
        if held:
            yield from emit(last, held)

    return run


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        gap = x[:, c][:, None] - y[:, c][None, :]
        square += gap * gap
    return square


def _nearest(x: np.ndarray, y: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places in y, distances) of each row's first k rows of ``y``, nearest first, ties by place; a row itself is left out."""
    square = _squares(x, y)
    if own:
        np.fill_diagonal(square, np.inf)
    order = np.argsort(square, axis=1, kind="stable")[:, :k]
    return order, np.sqrt(np.take_along_axis(square, order, 1))


def _gap(lo: Column, hi: Column, other_lo: Column, other_hi: Column, width: int) -> Column:
    """The distance of two boxes."""
    apart = [F.greatest(F.get(other_lo, F.lit(c)) - F.get(hi, F.lit(c)), F.get(lo, F.lit(c)) - F.get(other_hi, F.lit(c)), F.lit(0.0)) for c in range(width)]
    return F.sqrt(reduce(add, [g * g for g in apart]))


def nearest_rows(rows: DataFrame, columns: list[str], k: int, size: int = BLOCK) -> DataFrame:
    """(node, near, distance, rank) of rows (node: a whole number, columns...) that differ in ``columns``: the k nearest of each by Euclidean distance,
    ties by smaller node; all, where there are fewer.
    """
    width = len(columns)
    n = rows.count()
    depth = max(0, min(CELLS, n // (BLOCKS_A_CELL * size)).bit_length() - 1)
    some = rows.where(F.pmod(F.xxhash64("node"), F.lit(max(n, 1))) < FITTED).select(*columns).limit(2 * FITTED).collect() if depth else []  # about ``FITTED`` rows
    axis, cut = _cells(np.array(some, float).reshape(-1, width), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(_cell_of(x, axis, cut), pa.int32()), batch.column("node"), batch.column("v")], ["cell", "node", "v"])

    placed = rows.select("node", F.array(*columns).alias("v")).mapInArrow(place, "cell int, node long, v array<double>")
    packed = stored(placed.repartition(1 << depth, "cell").sortWithinPartitions("cell").mapInArrow(_pack(width, size, k), PACKED), "blocks")
    boxes = packed.select("cell", "block", "lo", "hi", F.array_max("bound").alias("reach"))
    ends = [F.array(*[f(F.get(side, F.lit(c))) for c in range(width)]).alias(f"cell_{side}") for side, f in (("lo", F.min), ("hi", F.max))]
    cells = packed.groupBy(F.col("cell").alias("other_cell")).agg(*ends)  # at most ``CELLS`` rows
    met = boxes.drop("cell").crossJoin(F.broadcast(cells)).where(_gap(F.col("lo"), F.col("hi"), F.col("cell_lo"), F.col("cell_hi"), width) <= F.col("reach"))
    others = boxes.select(F.col("cell").alias("other_cell"), F.col("block").alias("other"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"))
    met = met.join(others, "other_cell").where(_gap(F.col("lo"), F.col("hi"), F.col("other_lo"), F.col("other_hi"), width) <= F.col("reach"))
    met = met.groupBy("block").agg(F.collect_list("other").alias("others"), F.flatten(F.collect_list(F.concat("other_lo", "other_hi"))).alias("ends"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows for each block whose box they reach."""
        for batch in batches:
            for r in range(batch.num_rows):
                x, node, bound = _row(batch, "v", r).reshape(-1, width), _row(batch, "node", r), _row(batch, "bound", r)
                for other, box in zip(_row(batch, "others", r).tolist(), _row(batch, "ends", r).reshape(-1, 2, width)):
                    apart = np.zeros(len(x))
                    for c in range(width):
                        g = np.maximum(np.maximum(box[0, c] - x[:, c], x[:, c] - box[1, c]), 0)
                        apart += g * g
                    at = np.flatnonzero(np.sqrt(apart) <= bound)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([other], pa.int64()), _lists([node[at]], pa.int64()), _lists([x[at].ravel()], pa.float64()), _lists([bound[at]], pa.float64())], ["other", "node", "v", "bound"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = _row(batch, "v", r).reshape(-1, width), _row(batch, "other_v", r).reshape(-1, width)
                node, near, bound = _row(batch, "node", r), _row(batch, "other_node", r), _row(batch, "bound", r)
                far = np.sqrt(_squares(x, y))
                at = np.nonzero((far <= bound[:, None]) & (near[None, :] != node[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(node[at[0]]), pa.array(near[at[1]]), pa.array(far[at])], ["node", "near", "distance"])

    asked = packed.select("block", "node", "v", "bound").join(met, "block").select("node", "v", "bound", "others", "ends").mapInArrow(ask, ASKED)
    asked = stored(asked, "asked")
    both = asked.join(packed.select(F.col("block").alias("other"), F.col("node").alias("other_node"), F.col("v").alias("other_v")), "other")
    found = both.select("node", "v", "bound", "other_node", "other_v").mapInArrow(search, "node long, near long, distance double")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("distance", "near"))
    links = stored(found.withColumn("rank", rank).where(F.col("rank") <= k), "nearest")
    discard(packed, asked)
    return links


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (node, axis, ...) with i: numbers from 0 along the axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            count = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(count, part), pa.int32()), pa.array(np.arange(done, done + count)), *batch.columns], ["part", "p", *batch.schema.names])
            done += count

    ordered = rows.repartitionByRange("axis", "node").sortWithinPartitions("axis", "node")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = stored(ordered.mapInArrow(run, f"part int, p long, {fields}"), "order")
    starts, total = {}, 0
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a partition
        starts[r["part"]] = total
        total += r["n"]
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("part")] if starts else F.lit(0)
    return placed.select(*rows.columns, (start + F.col("p")).alias("i"))


def weights(links: DataFrame, k: int) -> DataFrame:
    """(node, near, weight) in both directions: a + b - a * b of the two rows' weights, exp(-(d - nearest) / bandwidth).

    A row's bandwidth makes its weights sum to log2(k), found by halving an interval; the nearest row that is not at distance 0 has weight 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            each = [np.array(d) for d in batch.column(2).to_pylist()]
            count = np.array([len(d) for d in each], np.int64)
            d = np.full((len(each), count.max(initial=1)), np.inf)
            for row, values in zip(d, each):
                row[: len(values)] = values
            first = np.where(d > 0, d, np.inf).min(1, initial=np.inf)
            past = np.maximum(d - np.where(np.isfinite(first), first, 0.0)[:, None], 0)
            low, high = np.zeros(len(d)), np.full(len(d), 1e-12)
            sums = lambda s: np.exp(-past / np.maximum(s, 1e-300)[:, None]).sum(1)
            goal = math.log2(k)
            for _ in range(64):  # a bandwidth large enough, where there is one
                high = np.where(sums(high) < np.minimum(goal, count * (1 - 1e-9)), 2 * high, high)
            for _ in range(64):
                middle = (low + high) / 2
                above = sums(middle) > goal
                low, high = np.where(above, low, middle), np.where(above, middle, high)
            w = np.exp(-past / np.maximum(high, 1e-300)[:, None])
            near = [x for row in batch.column(1).to_pylist() for x in row]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, count)), pa.array(near, pa.int64()), pa.array(w[np.arange(w.shape[1])[None, :] < count[:, None]])], ["node", "near", "w"])

    lists = links.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "near", "distance"))).alias("l"))  # at most k a row
    own = lists.select("node", F.col("l.near").alias("near"), F.col("l.distance").alias("distance")).mapInArrow(run, "node long, near long, w double")
    low = F.col("node") < F.col("near")
    pairs = own.groupBy(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).agg(F.sum(F.when(low, F.col("w")).otherwise(0.0)).alias("x"), F.sum(F.when(~low, F.col("w")).otherwise(0.0)).alias("y"))
    pairs = pairs.select("a", "b", (F.col("x") + F.col("y") - F.col("x") * F.col("y")).alias("weight"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("near"), "weight").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("near"), "weight"))


def _split(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each different key with its rows of ``columns``."""
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order])) + 1
    for at in np.split(order, edges) if len(order) else []:
        yield int(key[at[0]]), [c[at] for c in columns]


def _push_asks(samples: int, parts: int):
    """Rows (i, j: ``samples`` rows that push it) as asks: a part's rows and the places in another part that they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = np.repeat(batch.column("i").to_numpy(), samples), batch.column("j").flatten().to_numpy()
            i, j = i[i != j], j[i != j]
            split = list(_split(i // PART * parts + j // PART, (i % PART).astype(np.int32), (j % PART).astype(np.int32)))
            values = pa.array([key % parts for key, _ in split], pa.int64()), pa.array([key // parts for key, _ in split], pa.int64()), *(pa.array([c[k].tobytes() for _, c in split], pa.binary()) for k in range(2))
            yield pa.RecordBatch.from_arrays(list(values), ["part", "asker", "at", "place"])

    return run


def _pull_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asks of parts for the other ends of their links, one for each part that holds some."""
    for batch in batches:
        for part, wanted in zip(batch.column("part").to_pylist(), batch.column("wanted")):
            j = np.frombuffer(wanted.as_buffer(), np.int64)
            split = list(_split(j // PART, (j % PART).astype(np.int32)))
            values = pa.array([of for of, _ in split], pa.int64()), pa.array([part] * len(split), pa.int64()), pa.nulls(len(split), pa.binary()), pa.array([c[0].tobytes() for _, c in split], pa.binary())
            yield pa.RecordBatch.from_arrays(list(values), ["part", "asker", "at", "place"])


def _pack_links(links: pa.Table) -> pa.Table:
    """A part's links: rows, other ends as places in ``wanted`` (the different ones, in order), and shares of the rows' total weight."""
    i, j, weight = (links.column(c).to_numpy() for c in ("i", "j", "weight"))
    wanted, place = np.unique(j, return_inverse=True)
    at = i % PART
    share = weight / np.bincount(at, weights=weight)[at]
    values = at.astype(np.int32), place.astype(np.int32), share, wanted
    return pa.table([pa.array([i[0] // PART], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], ["part", "at", "place", "share", "wanted"])


def _pack_places(places: pa.Table) -> pa.Table:
    i = places.column("i").to_numpy()
    y = np.column_stack([places.column(c).to_numpy() for c in ("y1", "y2")])[np.argsort(i)]
    return pa.table([pa.array([i[0] // PART], pa.int64()), pa.array([y.tobytes()], pa.binary())], ["part", "y"])


def _unpack_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("y")):
            y = _points(packed)
            yield pa.RecordBatch.from_arrays([pa.array(part * PART + np.arange(len(y))), pa.array(y[:, 0].copy()), pa.array(y[:, 1].copy())], ["i", "y1", "y2"])


def _points(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_buffer()).reshape(-1, 2)


def _answer(mine: pa.Table, asks: pa.Table) -> pa.Table:
    """A part's places for those who asked, and for itself (sender -1)."""
    part, y = mine.column("part")[0].as_py(), _points(mine.column("y")[0])
    told = [y[np.frombuffer(place.as_buffer(), np.int32)].tobytes() for place in asks.column("place")]
    to, sender = [part, *asks.column("asker").to_pylist()], [-1] + [part] * len(told)
    at = [None, *asks.column("at").to_pylist()]
    return pa.table([pa.array(to, pa.int64()), pa.array(sender, pa.int64()), pa.array(at, pa.binary()), pa.array([y.tobytes(), *told], pa.binary())], ["part", "sender", "at", "y"])


def _force(y: np.ndarray, at: np.ndarray, z: np.ndarray, factor: Callable[[np.ndarray], np.ndarray], share: np.ndarray | float) -> np.ndarray:
    """The sums by row of what the points z do to the rows ``at`` of y."""
    gap = y[at] - z
    square = np.maximum((gap * gap).sum(1), 1e-12)
    each = np.clip(factor(square)[:, None] * gap, -4.0, 4.0) * (share[:, None] if isinstance(share, np.ndarray) else share)
    return np.column_stack([np.bincount(at, weights=each[:, c], minlength=len(y)) for c in range(2)])


def _along(square: np.ndarray) -> np.ndarray:
    return -2 * CURVE_A * CURVE_B * square ** (CURVE_B - 1) / (1 + CURVE_A * square**CURVE_B)


def _away(square: np.ndarray) -> np.ndarray:
    return 2 * CURVE_B / ((0.001 + square) * (1 + CURVE_A * square**CURVE_B))


def _move(rate: float, repulsion: float):
    """A part's rows moved, by what it was told and its links."""

    def run(told: pa.Table, links: pa.Table) -> pa.Table:
        sender, at, sent = told.column("sender").to_pylist(), told.column("at").to_pylist(), told.column("y")
        own = sender.index(-1)
        y = _points(sent[own])
        force = np.zeros_like(y)
        if links.num_rows:
            ends = np.concatenate([_points(sent[m]) for m in sorted((m for m, a in enumerate(at) if a is None and m != own), key=sender.__getitem__)])
            row, place, share = (np.frombuffer(links.column(c)[0].as_buffer(), kind) for c, kind in (("at", np.int32), ("place", np.int32), ("share", np.float64)))
            force += _force(y, row, ends[place], _along, share)
        pushed = [m for m, a in enumerate(at) if a is not None]
        if pushed:
            row = np.concatenate([np.frombuffer(at[m], np.int32) for m in pushed])
            force += _force(y, row, np.concatenate([_points(sent[m]) for m in pushed]), _away, repulsion)
        return pa.table([pa.array([told.column("part")[own].as_py()], pa.int64()), pa.array([(y + rate * force).tobytes()], pa.binary())], ["part", "y"])

    return run


def layout(places: DataFrame, links: DataFrame, n: int, epochs: int = 15, samples: int = 5, repulsion: float = 0.2, seed: int = 7) -> DataFrame:
    """(i, y1, y2): places (i from 0 below n, y1, y2) moved for some epochs along links (i, j, weight).

    A row moves by the weighted mean of its links' pulls and ``samples`` pushes, each cut to 4, times a rate that falls from 1 to 0. Pushes come
    from rows chosen by a hash of the row, epoch, sample and ``seed``.

    Rows are kept in parts of ``PART``, a table row each. In an epoch a part tells others the places of those of its rows that their links or pushes need, each
    once for all links of a part, and moves its own by what it was told: links and rows are packed once, not joined and sorted anew.
    """
    parts, spark = -(-n // PART), places.sparkSession
    of = F.expr(f"i div {PART}").alias("part")
    pulls = stored(links.select(of, "i", "j", "weight").groupBy("part").applyInArrow(_pack_links, "part long, at binary, place binary, share binary, wanted binary"), "links")
    needs = stored(pulls.select("part", "wanted").mapInArrow(_pull_asks, ASKS), "needs")
    at = stored(places.select(of, "i", "y1", "y2").groupBy("part").applyInArrow(_pack_places, PLACES), "places")
    rows = spark.range(parts).select(F.explode(F.sequence(F.col("id") * PART, F.least((F.col("id") + 1) * PART, F.lit(n)) - 1)).alias("i"))
    for epoch in range(epochs):
        chosen = rows.select("i", F.array(*[F.pmod(F.xxhash64("i", F.lit(epoch), F.lit(s), F.lit(seed)), F.lit(n)) for s in range(samples)]).alias("j"))
        asks = needs.unionByName(chosen.mapInArrow(_push_asks(samples, parts), ASKS))
        told = at.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(_answer, "part long, sender long, at binary, y binary")
        moved = told.groupBy("part").cogroup(pulls.drop("wanted").groupBy("part")).applyInArrow(_move(1 - epoch / epochs, repulsion), PLACES)
        after = stored(moved, "places")
        discard(at)
        at = after
    discard(pulls, needs)
    return at.mapInArrow(_unpack_places, "i long, y1 double, y2 double")


def _classes(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classes, members): equal rows without NULLs as one class (node, columns..., axis), and the rows with their class."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    rows = stored(rows.where(whole), "rows")  # once: sums in another order could give other values, which then meet no class
    plane = principal_plane(rows.select(*columns).distinct(), columns, name="_axis")
    classes = stored(plane.withColumn("node", F.monotonically_increasing_id()), "classes").withColumn("axis", F.col("_axis_1"))
    return classes, rows.join(classes.select("node", *columns), columns)


def neighbour_distances(rows: DataFrame, columns: list[str], k: int, size: int = BLOCK) -> DataFrame:
    """``rows`` without NULLs in ``columns`` with rank and distance of their k nearest different rows, equal rows being one."""
    classes, members = _classes(rows, columns)
    links = nearest_rows(classes, columns, k, size)
    return members.join(links.select("node", "rank", "distance"), "node").drop("node")


def neighbour_plane(rows: DataFrame, columns: list[str], k: int = 15, epochs: int = 15, size: int = BLOCK, name: str = "plane") -> DataFrame:
    """Adds ``plane_1`` and ``plane_2`` to rows without NULLs in ``columns``; rows that are equal there share a place. It starts from the principal plane."""
    classes, members = _classes(rows, columns)
    ordered = numbered(classes)
    n = ordered.count()
    wide = ordered.agg(F.max(F.greatest(F.abs("_axis_1"), F.abs("_axis_2")))).first()[0] or 1.0
    start = ordered.select("i", (F.col("_axis_1") * (10 / wide)).alias("y1"), (F.col("_axis_2") * (10 / wide)).alias("y2"))
    near = nearest_rows(ordered.select(F.col("i").alias("node"), *columns), columns, k, size)
    links = weights(near, k).select(F.col("node").alias("i"), F.col("near").alias("j"), "weight")
    placed = layout(start, links, n, epochs).join(ordered.select("i", "node"), "i").select("node", F.col("y1").alias(f"{name}_1"), F.col("y2").alias(f"{name}_2"))
    discard(near)
    return members.join(placed, "node").drop("node")
