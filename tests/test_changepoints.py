"""Changepoints over ranges against the unpruned search of whole clips."""

import random
import time

import numpy as np
import pytest

from kinetrove.operators import changepoint as cp


def unpruned(x, min_size, penalty):
    """Best segment starts by trying all of them, in the same whole-number costs; the latest of equal ones."""
    n, p = len(x), np.concatenate([[0], np.cumsum(x)])
    cost, start = {0: 0}, {}
    for t in range(min_size, n + 1):
        tried = [(cost[s] + (p[t] - p[s]) * (t - s - p[t] + p[s]) * cp.UNIT // (t - s), -s) for s in cost if t - s >= min_size]
        if tried:
            best, s = min(tried)
            cost[t], start[t] = int(best) + round(penalty * cp.UNIT), -s
    ends, at = [], n
    while at > 0:
        ends.append(at)
        at = start.get(at, 0)
    return ends[::-1]


def signal(rng, n):
    out = []
    while len(out) < n:
        out += [int(rng.random() < rng.choice((0.02, 0.3, 0.5, 0.9)))] if rng.random() < 0.5 else [rng.randrange(2)] * rng.randrange(1, 25)
    return out[:n]


@pytest.mark.parametrize("min_size", [1, 2, 5, 15])
def test_pruned_search_is_exact(min_size):
    rng = random.Random(min_size)
    for _ in range(60):
        x = signal(rng, rng.randrange(0, 130))
        penalty = rng.choice((0.25, 1.0, 3.0))
        assert cp.changepoints(np.array(x, np.int64), min_size, penalty) == (unpruned(x, min_size, penalty) if x else []), (x, penalty)


def test_states_join_up():
    rng = random.Random(9)
    x = np.array(signal(rng, 700))
    whole, choice, before = cp.advance(cp.opening(), x, 4, cp.UNIT)
    state, parts = cp.opening(), []
    while state.n < len(x):
        state, *part = cp.advance(state, x[state.n : state.n + rng.randrange(1, 60)], 4, cp.UNIT)
        parts.append(part)
    assert np.array_equal(np.concatenate([p[0] for p in parts]), choice) and np.array_equal(np.concatenate([p[1] for p in parts]), before)
    assert all(np.array_equal(a, b) for a, b in zip(state, whole))


@pytest.mark.parametrize("chunk", [60, 1 << 16])
def test_ranges_give_the_events_of_whole_clips(spark, chunk):
    rng = random.Random(chunk)
    rows, want = [], {}
    for clip, n in (("a", 150), ("b", 90), ("c", 1), ("d", 40)):
        frames = sorted(rng.sample(range(3 * n), n)) if clip != "d" else list(range(500, 540))
        x = signal(rng, n)
        rows += [(clip, f, None if not v and rng.random() < 0.3 else 10.0 if v else 30.0) for f, v in zip(frames, x)]
        start = event = 0
        for stop in unpruned(x, 2, 1.0):
            held = 2 * sum(x[start:stop]) > stop - start
            want |= {(clip, f): event if held else -1 for f in frames[start:stop]}
            event, start = event + held, stop
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "clip string, frame long, v double")
    got = cp.threshold_events(df, "v", 25.0, penalty=1.0, chunk=chunk)
    assert {(r["clip"], r["frame"]): r["event_id"] for r in got.collect()} == want and got.count() == len(rows)
    assert cp.threshold_events(df.limit(0), "v", 25.0).count() == 0


@pytest.mark.parametrize("kind", ["quiet", "busy", "noisy"])
def test_what_a_border_carries_stays_small(kind):
    """The starts that survive do not grow with the clip, not even where nothing happens."""
    rng = np.random.default_rng(1)
    n = 40_000
    x = {"quiet": np.zeros(n, np.int64), "busy": (np.arange(n) // 400 % 2).astype(np.int64), "noisy": (rng.random(n) < 0.3).astype(np.int64)}[kind]
    began = time.time()
    state, *_ = cp.advance(cp.opening(), x, 2, 3 * cp.UNIT)
    assert len(state.place) < 3000 and (kind == "noisy" or len(state.place) < 100) and time.time() - began < 60
