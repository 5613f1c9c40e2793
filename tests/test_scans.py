"""Segmented scans, and what is built on them, at several range sizes."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrove.operators import refine, scans, sequences


def rows_of(seed, n=220):
    rng = random.Random(seed)
    rows = []
    for g in "abc":
        at = rng.randrange(-40, 5)
        for _ in range(n):
            at += 1 if rng.random() < 0.85 else rng.randrange(2, 90)
            rows.append((g, at, rng.randrange(0, 4)))
    return rows


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_sums_and_previous_rows(spark, chunk):
    rows = rows_of(chunk)
    df = spark.createDataFrame(rows, "clip string, frame long, v long").repartition(5)
    got = {(r["clip"], r["frame"]): (r["s"], r["previous_v"], r["previous_frame"]) for r in scans.previous(scans.running_sum(df, ["clip"], F.col("v"), "s", chunk=chunk), ["clip"], ["frame", "v"], chunk=chunk).collect()}
    want, total, last = {}, {}, {}
    for g, f, v in sorted(rows):
        total[g] = total.get(g, 0) + v
        want[g, f] = (total[g], *last.get(g, (None, None)))
        last[g] = (v, f)
    assert got == want


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_runs_do_not_depend_on_ranges(spark, chunk):
    rows = rows_of(chunk + 50)
    df = spark.createDataFrame(rows, "clip string, frame long, v long")
    want, open_ = [], None
    for g, f, _ in sorted(rows):
        if open_ and open_[0] == g and open_[2] == f - 1:
            open_[2], open_[3] = f, open_[3] + 1
        else:
            want.append(open_ := [g, f, f, 1])
    got = sorted(map(tuple, sequences.runs(df, ["clip"], chunk=chunk).collect()))
    assert got == sorted(map(tuple, want))
    assert sorted(map(tuple, sequences.runs(df, ["clip"], 4, chunk=chunk).collect())) == sorted(tuple(w) for w in want if w[3] >= 4)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_group_segments_do_not_depend_on_ranges(spark, chunk):
    rng = random.Random(chunk)
    counts = {("a", f): rng.choice((0, 1, 1, 1, 2, 2, 3)) for f in range(-20, 200)} | {("b", f): 1 for f in range(50)}
    pose = [(c, f, f"individual{i}", "nose", 1.0 if i <= n else None, 1.0 if i <= n else None) for (c, f), n in counts.items() for i in (1, 2, 3)]
    got = sorted(map(tuple, refine.group_segments(spark.createDataFrame(pose, "clip string, frame long, individual string, bodypart string, x double, y double"), min_len=3, chunk=chunk).collect()))
    want = []
    for clip in "ab":
        runs, before = [], None
        for (c, f), n in sorted(counts.items()):
            if c == clip and n:
                if before == f - 1:
                    runs[-1].append((f, n))
                else:
                    runs.append([(f, n)])
                before = f
        found = []
        for run in (r for r in runs if len(r) >= 3):
            parts = [[run[0]]]
            for a, b in zip(run, run[1:]):
                if b[1] > a[1] and b[1] != 3:
                    parts.append([])
                parts[-1].append(b)
            found += [p for p in parts if len(p) >= 3]
        want += [(clip, k, p[0][0], p[-1][0], len(p)) for k, p in enumerate(found)]
    assert got == sorted(want)
