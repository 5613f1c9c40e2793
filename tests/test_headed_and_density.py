"""Tables with several header lines, and density curves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinetrove.operators.density import density_curves
from kinetrove.sources import headed, schema


def pose_rows(n=40):
    rng = random.Random(1)
    rows = []
    for clip, many in (("one", n), ("two", 3)):
        for f in range(many):
            for i in schema.INDIVIDUALS:
                for b in schema.BODYPARTS:
                    gone = rng.random() < 0.2
                    rows.append((clip, f, i, b, None if gone else rng.uniform(0, 700), None if gone else rng.uniform(0, 900), rng.random()))
    return rows


def test_tracker_files_come_back_whole_however_they_are_split(spark, tmp_path):
    rows = pose_rows()
    path = str(tmp_path / "t")
    headed.write_tracker(spark.createDataFrame(rows, schema.POSE), path)
    files = list((tmp_path / "t").glob("clip=*/part-*"))
    lines = files[0].read_text().splitlines()
    assert len(files) == 2 and [line.split(",")[0] for line in lines[:5]] == [*headed.TRACKER, "0"] and len(lines[0].split(",")) == 82
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # many splits, the header in the first alone
        got = headed.read_tracker(spark, path, likelihood=True)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_with_other_columns_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "aDLC_dlcrnet.csv").write_bytes(b'scorer,m,m,m\r\nbodyparts,nose,nose,nose\r\ncoords,y,x,likelihood\r\n0,1.5,2.5,0.9\r\n1,,NaN,\r\n')
    (tmp_path / "b.csv").write_text('"scorer","m, 2","m, 2"\nindividuals,individual3,individual3\nbodyparts,stripe1,stripe1\ncoords,x,y\n7,3.0,"4.0"\n\n')
    got = sorted(map(tuple, headed.read_tracker(spark, str(tmp_path)).collect()), key=str)
    assert got == [("a", 0, "individual1", "nose", 2.5, 1.5), ("a", 1, "individual1", "nose", None, None), ("b", 7, "individual3", "stripe1", 3.0, 4.0)]
    cells = headed.read_headed(spark, str(tmp_path / "b.csv"), headed.TRACKER, ["frame"]).collect()
    assert {(r["scorer"], r["coords"], r["frame"], r["value"]) for r in cells} == {("m, 2", "x", "7", 3.0), ("m, 2", "y", "7", 4.0)}


def test_error_and_collated_tables(spark, tmp_path):
    (tmp_path / "e.csv").write_text("scorer,m,m,m,m\nindividuals,i1,i1,i2,i2\nbody_parts,nose,nose,nose,tail\nmetric,rmse,conf,rmse,rmse\nlabeled/v/img1.png,1.0,0.9,3.0,\nlabeled/v/img2.png,2.0,0.9,,5.0\n")
    got = sorted(map(tuple, headed.read_errors(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("i1", "nose", 1.0), ("i1", "nose", 2.0), ("i2", "nose", 3.0), ("i2", "nose", None), ("i2", "tail", None), ("i2", "tail", 5.0)], key=str)
    rows = [(c, s, f, i, b, x, y) for (c, f, i, b, x, y, _), s in zip(pose_rows(4), [0, 1] * 1000)]
    sheet = spark.createDataFrame(rows, "clip string, segment_id long, frame long, individual string, bodypart string, x double, y double")
    headed.write_collated(sheet, str(tmp_path / "s"))
    back = headed.read_collated(spark, str(tmp_path / "s")).where("x is not null")
    assert sorted(map(tuple, back.collect()), key=str) == sorted((r for r in rows if r[5] is not None), key=str)


@pytest.mark.parametrize("bins", [8, 32])
def test_curves_match_the_direct_sum(spark, monkeypatch, bins):
    monkeypatch.setattr("kinetrove.operators.density.BINS", bins)
    rng = random.Random(bins)
    groups = {"a": [rng.gauss(0, 1) for _ in range(400)] + [rng.gauss(9, 0.3) for _ in range(100)], "b": [1.0] * 50 + [2.0], "c": [5.0] * 10, "d": [3.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double").withColumn("x", F.lit(1))
    out = {}
    for r in density_curves(df, ["g"], "v", 50).collect():
        out.setdefault(r["g"], {})[r["point"]] = (r["at"], r["density"])
    assert set(out) == {"a", "b"}
    for g, curve in out.items():
        vs = groups[g]
        n, mean = len(vs), sum(vs) / len(vs)
        h = math.sqrt(sum((v - mean) ** 2 for v in vs) / (n - 1)) * n**-0.2
        assert sorted(curve) == list(range(50)) and curve[0][0] == pytest.approx(min(vs) - 3 * h) and curve[49][0] == pytest.approx(max(vs) + 3 * h)
        for at, found in curve.values():
            want = sum(math.exp(-(((at - v) / h) ** 2) / 2) for v in vs) / (n * h * math.sqrt(2 * math.pi))
            assert found == pytest.approx(want, abs=1e-6 if bins == 32 else 1e-4)
