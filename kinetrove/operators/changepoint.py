"""Threshold events by penalised changepoints (l2 cost), range by range.

The best partition of a clip ends, at every frame, in a segment from one of the frames before it, so the search runs along the clip. It is
cut into ranges of about ``CHUNK`` of its rows: a round takes the next range of every clip that has one, a clip's range being one small task, and hands on the
clip's state, which holds only the segment starts that can still win. So there are as many rounds as the longest clip has ranges, whatever the frames' numbers. A second row of rounds goes back over the stored choices and cuts the ranges into the pieces of
segments. So a task holds one range, whatever a clip's length, and a lost executor repeats one range.

Values are hits (0 or 1), so a segment of m frames with g hits costs g * (m - g) / m; costs are counted in steps of 1 / ``UNIT``, in whole
numbers, and of equal ones the latest start wins. Results are those of the unpruned search.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, each_row, stored

CHUNK, UNIT = 1 << 16, 1 << 20
NEVER = 1 << 62
_LISTS = "place array<long>, cost array<long>, hits array<long>, until array<long>"
FORWARD = f"clip string, first long, frames array<long>, choice array<long>, choice_hits array<long>, n long, h long, run long, value int, {_LISTS}"
BACK = "clip string, edge long, edge_hits long, frames array<long>, starts array<long>, sizes array<long>, seg_start array<long>, seg_stop array<long>, seg_hits array<long>"


class State(NamedTuple):
    """What a clip's search hands on: frames and hits so far, where the current run of equal values began and its value, and the starts that can
    still win: place, least cost up to it, hits before it, and the frame from which on it cannot.
    """

    n: int
    h: int
    run: int
    value: int
    place: np.ndarray
    cost: np.ndarray
    hits: np.ndarray
    until: np.ndarray


def opening() -> State:
    return State(0, 0, 0, -1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, NEVER))


def advance(state: State, values: np.ndarray, min_size: int, penalty: int) -> tuple[State, np.ndarray, np.ndarray]:
    """The state after some more values, and for each the start of its best last segment (-1: none is long enough) and the hits before that.

    A start falls away ``min_size`` frames after one that is no worse can take its place: the start at frame t itself, if the cost up to the older start and
    from there to t is no less than that up to t (rounding may hide a step, so one is asked for), or if all values between are equal and the
    older start's cost is no less.
    """
    n, h, run, value, place, cost, hits, until = state
    choice, before = np.full(len(values), -1), np.zeros(len(values), np.int64)
    for k, x in enumerate(values.tolist()):
        if x != value:
            run, value = n, x
        n += 1
        h += x
        if (until <= n).any():
            keep = until > n
            place, cost, hits, until = place[keep], cost[keep], hits[keep], until[keep]
        fit = int(np.searchsorted(place, n - min_size, "right"))
        if not fit:
            continue
        m, g = n - place[:fit], h - hits[:fit]
        spread = g * (m - g)
        reached = cost[:fit] + spread // m * UNIT + spread % m * UNIT // m
        best = int(reached.min())
        at = fit - 1 - int(np.argmin(reached[::-1]))
        choice[k], before[k] = place[at], hits[at]
        best += penalty
        beaten = np.append(reached > best, np.zeros(len(place) - fit, bool)) | ((place >= run) & (cost >= best))
        until = np.where(beaten, np.minimum(until, n + min_size), until)
        place, cost, hits, until = np.append(place, n), np.append(cost, best), np.append(hits, h), np.append(until, NEVER)
    return State(n, h, run, value, place, cost, hits, until), choice, before


def changepoints(values: np.ndarray, min_size: int = 2, penalty: float = 3.0) -> list[int]:
    """Ends of the best segments of one sequence of hits."""
    _, choice, _ = advance(opening(), np.asarray(values).astype(np.int64), min_size, round(penalty * UNIT))
    ends, at = [], len(choice)
    while at > 0:
        ends.append(at)
        at = max(0, int(choice[at - 1]))
    return ends[::-1]


def _forward(min_size: int, penalty: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                state = opening() if r["n"] is None else State(r["n"], r["h"], r["run"], r["value"], *(np.array(r[c], np.int64) for c in ("place", "cost", "hits", "until")))
                frames = [x["frame"] for x in r["rows"]]
                after, choice, before = advance(state, np.array([x["hit"] for x in r["rows"]], np.int64), min_size, penalty)
                out = {"clip": r["clip"], "first": state.n, "frames": frames, "choice": choice.tolist(), "choice_hits": before.tolist(), **{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in after._asdict().items()}}
                yield pa.RecordBatch.from_pylist([out], schema=_arrow(FORWARD))

    return run


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in each_row(batch):
            first, edge, held = r["first"], r["edge"], r["edge_hits"]
            at = first + len(r["frames"])
            starts, cuts, segments = [], [], []
            if edge < at:  # a segment of a later range reaches into this one
                starts, cuts, at = [edge], [at - max(edge, first)], edge
            while at > first:
                start = max(0, r["choice"][at - first - 1])
                hits = r["choice_hits"][at - first - 1]
                segments.append((start, at, held - hits))
                starts.append(start)
                cuts.append(at - max(start, first))
                at, held = start, hits
            starts, cuts = starts[::-1], cuts[::-1]
            seg = [list(c) for c in zip(*segments)] or [[], [], []]
            out = {"clip": r["clip"], "edge": at, "edge_hits": held, "frames": r["frames"], "starts": starts, "sizes": cuts, "seg_start": seg[0], "seg_stop": seg[1], "seg_hits": seg[2]}
            yield pa.RecordBatch.from_pylist([out], schema=_arrow(BACK))


def _arrow(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


def _packed(rows: DataFrame, chunk: int) -> DataFrame:
    """(clip, round, rows): the rows (clip, frame, hit) of each clip in ranges of about ``chunk`` rows (fewer than twice as many), numbered from 0 along the clip.

    Rows are counted by stretches of ``chunk`` frames, and stretches with few rows go into one range: gaps between frames make no more ranges.
    """
    rows = rows.withColumn("stretch", F.floor(F.col("frame") / chunk))
    along = Window.partitionBy("clip").orderBy("stretch")
    counts = rows.groupBy("clip", "stretch").agg(F.count(F.lit(1)).alias("n"))
    full = F.floor(F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / chunk)
    counts = counts.select("clip", "stretch", full.alias("full"))
    rounds = counts.select("clip", "stretch", (F.dense_rank().over(Window.partitionBy("clip").orderBy("full")) - 1).alias("round"))
    return rows.join(rounds, ["clip", "stretch"]).groupBy("clip", "round").agg(F.sort_array(F.collect_list(F.struct("frame", "hit"))).alias("rows"))


def threshold_events(rows: DataFrame, value: str, thresh: float, min_size: int = 2, penalty: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """(clip, frame, event_id): segments of ``value < thresh`` whose share of hits is above one half, numbered from 0; -1 elsewhere.

    A missing value is no hit. A clip of fewer than ``min_size`` frames is one segment.
    """
    hit = F.coalesce(F.col(value) < thresh, F.lit(False)).cast("int").alias("hit")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = stored(_packed(rows.select("clip", "frame", hit), chunk).repartition(parts, "clip", "round"), "ranges")
    last = packed.agg(F.max("round")).first()[0]
    if last is None:
        return rows.select("clip", "frame").limit(0).withColumn("event_id", F.lit(-1).cast("bigint"))
    kept = ["n", "h", "run", "value", "place", "cost", "hits", "until"]
    passed = []
    for k in range(last + 1):  # as many as the longest clip has ranges; a clip is out after its last one
        here = packed.where(F.col("round") == k).select("clip", "rows")
        if not passed:
            here = here.select("*", *[F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in FORWARD.split(", ")[5:]])
        else:
            here = here.join(passed[-1].select("clip", *kept), "clip")
        passed.append(stored(here.mapInArrow(_forward(min_size, round(penalty * UNIT)), FORWARD), "forward"))
    cut = []
    for done in reversed(passed):
        there = done.select("clip", "first", "frames", "choice", "choice_hits", "n", "h")
        # a clip's way back begins at its last frame, and in earlier ranges where the later one left it
        later = cut[-1].select("clip", "edge", "edge_hits") if cut else None
        there = there.join(later, "clip", "left") if cut else there.withColumns({c: F.lit(None).cast("bigint") for c in ("edge", "edge_hits")})
        there = there.withColumns({"edge": F.coalesce("edge", "n"), "edge_hits": F.coalesce("edge_hits", "h")}).drop("n", "h")
        cut.append(stored(there.mapInArrow(_backward, BACK), "pieces"))
    out = cut[0]
    for more in cut[1:]:
        out = out.unionByName(more)
    segments = out.select("clip", F.explode(F.arrays_zip("seg_start", "seg_stop", "seg_hits")).alias("s")).select("clip", F.col("s.seg_start").alias("start"), (2 * F.col("s.seg_hits") > F.col("s.seg_stop") - F.col("s.seg_start")).alias("event"))
    number = (F.row_number().over(Window.partitionBy("clip").orderBy("start")) - 1).cast("bigint")
    found = segments.where("event").select("clip", "start", number.alias("event_id"))
    ends = F.transform("sizes", lambda _, i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("bigint"), lambda t, x: t + x))
    pieces = out.select("clip", "frames", F.explode(F.arrays_zip("starts", "sizes", ends.alias("skip"))).alias("p"))
    pieces = pieces.select("clip", F.col("p.starts").alias("start"), F.slice("frames", (F.col("p.skip") + 1).cast("int"), F.col("p.sizes").cast("int")).alias("frames"))
    labelled = pieces.join(found, ["clip", "start"], "left").select("clip", F.explode("frames").alias("frame"), F.coalesce("event_id", F.lit(-1).cast("bigint")).alias("event_id"))
    out = stored(labelled, "events")
    discard(packed, *passed, *cut)
    return out
