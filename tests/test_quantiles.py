"""Quantiles by closing histograms against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrove.operators.quantiles import group_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


@pytest.mark.parametrize("few", [1, 50])
def test_quantiles_are_exact(spark, few):
    rng = random.Random(few)
    groups = {
        "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 307) for _ in range(400)], "same": [4.0] * 300, "ties": [float(rng.randrange(5)) for _ in range(500)],
        "one": [7.5], "two": [1.0, 2.0], "far": [0.0] * 200 + [1e300] + [1e-300 * i for i in range(200)], "plain": [rng.gauss(0, 1) for _ in range(3000)], "ends": [-1.7e308, 1.7e308, 0.0, 1.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").withColumns({"n": F.lit("x"), "lo": F.lit(1)})
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", SHARES, [f"q{i}" for i in range(len(SHARES))], few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        assert got[g]["n"] == len(vs)
        for i, p in enumerate(SHARES):
            at = p * (len(vs) - 1)
            low = int(at)
            want = vs[low] if low == at else (low + 1 - at) * vs[low] + (at - low) * vs[low + 1]
            assert got[g][f"q{i}"] == pytest.approx(want, rel=1e-12, abs=0), (g, p)


def test_no_rows(spark):
    assert group_quantiles(spark.createDataFrame([("a", None)], "g string, v double"), ["g"], "v", [0.5], ["m"]).count() == 0
