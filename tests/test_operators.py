"""Boundaries and brute force on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrove.functions import geometry as G
from kinetrove.operators import changepoint, events, features, intervals, kinematics, pairs, presence, projection, refine, sequences, summaries
from kinetrove.plans.queries import all_queries
from kinetrove.sources import fixtures as X
from kinetrove.sources import keys, schema, stores

POSE = "clip string, frame long, individual string, bodypart string, x double, y double"


def frames(spark, numbers, clip="c"):
    return spark.createDataFrame([(clip, n) for n in numbers], "clip string, frame long")


def brute_dbscan(points, eps, least):
    core = [p for p in points if sum(abs(p - q) <= eps for q in points) >= least]
    label, ids, last = {}, -1, None
    for c in core:
        ids += last is None or c - last > eps
        label[c], last = ids, c
    out = {}
    for p in points:
        near = sorted((abs(p - c), c) for c in core if abs(p - c) <= eps)
        out[p] = label[near[0][1]] if near else -1
    return out


@pytest.mark.parametrize("seed,eps,least", [(1, 3, 3), (2, 5, 4), (3, 1, 1), (4, 10, 6)])
def test_dbscan_against_brute_force(spark, seed, eps, least):
    rng = random.Random(seed)
    points = sorted(rng.sample(range(400), 90))
    got = sequences.dbscan1d(frames(spark, points), ["clip"], eps, least).collect()
    assert {r["frame"]: r["label"] for r in got} == brute_dbscan(points, eps, least)


@pytest.mark.parametrize("seed,eps,least,chunk", [(1, 3, 3, 7), (2, 5, 4, 40), (3, 1, 1, 3), (4, 10, 6, 21), (5, 2, 3, 1)])
def test_dbscan_over_ranges_against_brute_force(spark, seed, eps, least, chunk):
    rng = random.Random(seed)
    clips = {c: sorted(rng.sample(range(-50, 350), 90)) for c in ("a", "b")}
    rows = spark.createDataFrame([(c, n, "kept") for c, p in clips.items() for n in p], "clip string, frame long, other string")
    got = sequences.dbscan1d(rows, ["clip"], eps, least, chunk=chunk).collect()
    assert {(r["clip"], r["frame"]): r["label"] for r in got} == {(c, n): x for c, p in clips.items() for n, x in brute_dbscan(p, eps, least).items()}
    assert len(got) == 180 and {r["other"] for r in got} == {"kept"}


def test_no_hits_gives_minus_one_everywhere(spark):
    out = sequences.labelled(frames(spark, range(5)), F.lit(False), ["clip"], 3, 2, "id").collect()
    assert [r["id"] for r in out] == [-1] * 5


def test_fill_covers_gaps_inside_events_only(spark):
    base = frames(spark, range(12)).withColumn("hit", F.col("frame").isin(2, 3, 5, 6, 10))
    out = sequences.labelled(base, F.col("hit"), ["clip"], 2, 2, "id").orderBy("frame").collect()
    assert [r["id"] for r in out] == [-1, -1, 0, 0, 0, 0, 0, -1, -1, -1, -1, -1]


def test_runs_of_59_and_60(spark):
    rows = frames(spark, [*range(60), *range(100, 159)])
    assert [(r["start"], r["stop"]) for r in sequences.runs(rows, ["clip"], 60).collect()] == [(0, 59)]


def test_windows_keep_whole_ones_only(spark):
    out = sequences.windowed(frames(spark, range(5, 100)), 30).groupBy("window").count().collect()
    assert {r["window"]: r["count"] for r in out} == {1: 30, 2: 30}
    full = sequences.windowed(frames(spark, range(60)), 30, drop_last_full=True).select("window").distinct().collect()
    assert [r["window"] for r in full] == [0]


def one_fish(spark, rows):
    return spark.createDataFrame(rows, POSE)


def test_presence_is_truthy_or_not_null(spark):
    p = one_fish(spark, [("c", 0, "a", "nose", 0.0, 0.0), ("c", 0, "b", "nose", None, None), ("c", 0, "d", "nose", 1.0, None)])
    assert presence.nfish_frame(p).first()["nfish_frame"] == 1
    assert presence.nfish_frame(p, "notnull").first()["nfish_frame"] == 2


def test_region_edge_and_missing_region(spark):
    p = one_fish(spark, [("c", 0, "a", "stripe1", 60.0, 0.0), ("d", 0, "a", "stripe1", 0.0, 0.0)])
    roi = spark.createDataFrame([("c", 0.0, 0.0, 60.0)], "clip string, roi_x double, roi_y double, roi_r double")
    count = lambda inc: {r["clip"]: r["nfish_pipe"] for r in presence.nfish_pipe(p, roi, inc).collect()}
    assert count(True) == {"c": 1, "d": None}
    assert count(False) == {"c": 0, "d": None}


def test_single_fish_has_no_pairs(spark):
    p = one_fish(spark, [("c", f, "a", b, 1.0, 1.0) for f in range(3) for b in ("nose", "stripe4")])
    assert [r["min_dist"] for r in pairs.min_distance(p).collect()] == [None] * 3
    assert not any(r["mouther"] or r["mouthee"] or r["mouthing"] for r in events.directed_mouthing(p).collect())


def test_mouthing_is_any_mouther(spark, sf):
    from kinetrove.sources import fixtures

    out = events.directed_mouthing(fixtures.pose(spark, sf), min_samples=4)
    by = out.groupBy("clip", "frame").agg(F.bool_or("mouther").alias("a"), F.bool_or("mouthee").alias("b"), F.bool_or("mouthing").alias("m"))
    assert by.where("a <> m or b <> m").count() == 0 and by.where("m").count() > 0


def test_rolling_needs_all_rows(spark):
    rng = np.random.default_rng(5)
    v = [None if i in (17, 60) else float(x) for i, x in enumerate(rng.uniform(0, 360, 90))]
    rows = spark.createDataFrame([("c", i, x) for i, x in enumerate(v)], "clip string, frame long, v double")
    lin = kinematics.rolling(rows, "v", ["clip"], 31).orderBy("frame").collect()
    cir = kinematics.rolling_circular(rows, "v", ["clip"], 31).orderBy("frame").collect()
    for i in range(90):
        part = v[max(0, i - 15) : i + 16]
        if len(part) < 31 or None in part:
            assert lin[i]["rollavg_v"] is None and cir[i]["rollstd_v"] is None
            continue
        assert np.isclose(lin[i]["rollavg_v"], np.mean(part)) and np.isclose(lin[i]["rollstd_v"], np.std(part))
        z = np.exp(1j * np.radians(part)).mean()
        assert np.isclose(cir[i]["rollavg_v"], np.degrees(np.angle(z)) % 360) and np.isclose(cir[i]["rollstd_v"], np.degrees(np.sqrt(-2 * np.log(abs(z)))))


def test_kinetics_cross_gaps(spark):
    rows = spark.createDataFrame([("c", f, "a1", x, 0.0) for f, x in ((0, 0.0), (4, 1.0), (5, 3.0))], "clip string, frame long, individual string, centroid_x double, centroid_y double")
    out = kinematics.kinetics(rows).orderBy("frame").collect()
    assert [r["centroid_speed"] for r in out] == [None, 1.0, 2.0] and out[2]["centroid_tangential_acceleration"] == 1.0


def test_annotation_modes(spark):
    a = lambda *v: spark.createDataFrame(list(v), "start long, stop long")
    got = lambda rows, mode: sorted(r["frame"] for r in intervals.covered(rows, 10, mode).collect())
    assert got(a((2, 4)), "strict") == [2, 3] and got(a((2, 4)), "inclusive") == [2, 3, 4]
    assert got(a((7, 50)), "strict") == [7, 8] and got(a((7, 50)), "inclusive") == [7, 8, 9]
    assert got(a((-3, 2)), "strict") == [0, 1]
    assert got(a((-3, 50)), "strict") == []


def test_refinement_masks_then_runs(spark):
    rows = [("c", f, "a", b, 300.0, 300.0) for f in range(30) for b in "wxyz"]
    rows = [(c, f, i, b, None if f == 12 and b == "w" else x, y) for c, f, i, b, x, y in rows]
    kept = refine.refine(one_fish(spark, rows), min_keypoints=4, min_track_len=13).where("x is not null").select("frame").distinct()
    assert sorted(r["frame"] for r in kept.collect()) == list(range(13, 30))
    edge = refine.refine(one_fish(spark, [("c", f, "a", b, 0.0 if b == "w" else 50.0, 5.0) for f in range(12) for b in "wxyz"]), min_keypoints=4, border=1)
    assert edge.where("x is not null").count() == 0


def test_group_segments_split_on_a_new_fish_unless_all_are_there(spark):
    who = lambda f: ["a"] if f < 70 else ["a", "b"] if f < 140 else ["a", "b", "d"]
    p = one_fish(spark, [("c", f, i, "nose", 1.0, 1.0) for f in range(220) for i in who(f)])
    assert [(r["segment_id"], r["start"], r["stop"]) for r in refine.group_segments(p).orderBy("start").collect()] == [(0, 0, 69), (1, 70, 219)]


def test_clock_rounding_and_angles(spark):
    row = spark.range(1).select(G.clock(F.lit(36000.0)).alias("a"), G.clock(F.lit(59.9)).alias("b"), G.to_frames(F.lit(2.5 / 30)).alias("c"), G.to_frames(F.lit(3.5 / 30)).alias("d"), G.angle(F.lit(-1.0), F.lit(0.0)).alias("e")).first()
    assert tuple(row) == ("10:00:0", "0:00:59", 2, 4, 270.0)


def test_no_events_leave_only_the_count(spark):
    none = spark.createDataFrame([], "start long, stop long")
    row = summaries.lengths(none, F.expr("(stop - start) / 30"), "events").first()
    assert row["n_events"] == 0 and row["mean_len"] is None


def brute_changepoints(v, size, pen):
    n = len(v)
    cost = lambda a, b: float(((v[a:b] - v[a:b].mean()) ** 2).sum())
    best = {0: (-pen, [])}
    for e in range(size, n + 1):
        best[e] = min(((best[s][0] + cost(s, e) + pen, [*best[s][1], e]) for s in best if e - s >= size), key=lambda t: t[0], default=(np.inf, []))
    return best[n][0]


@pytest.mark.parametrize("seed", range(4))
def test_changepoints_are_optimal(seed):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.integers(0, 2, 12) * 1.0, np.ones(15), np.zeros(14), rng.integers(0, 2, 9)])
    ends = changepoint.changepoints(v, 3, 1.0)
    total = sum(((v[a:b] - v[a:b].mean()) ** 2).sum() + 1.0 for a, b in zip([0, *ends[:-1]], ends)) - 1.0
    assert ends[-1] == len(v) and np.isclose(total, brute_changepoints(v, 3, 1.0)) and min(np.diff([0, *ends])) >= 3


def test_keys(spark):
    k = F.col("k")
    rows = spark.createDataFrame([("/BHVE_group3_142200-143999",), ("CTRL_group1_000000-001799.mp4",), ("odd",)], "k string")
    first, last = keys.frame_range(k)
    out = rows.select(keys.trial(k), first, last, keys.is_clip(keys.bare(k))).collect()
    assert [tuple(r) for r in out] == [("BHVE_group3", 142200, 143999, True), ("CTRL_group1", 0, 1799, True), ("odd", None, None, False)]


def test_store_round_trip(spark, tmp_path):
    pose = spark.createDataFrame([("k1", 0, "individual1", "nose", 1.0, float("nan"), 0.5), ("k2", 0, "individual1", "nose", None, None, 0.1)], schema.POSE)
    path = str(tmp_path / "pose")
    stores.append(pose, path)
    stores.append(pose.where("clip = 'k1'").withColumn("x", F.lit(7.0)), path)
    back = stores.read_pose(spark, path)
    assert {r["clip"]: r["x"] for r in back.collect()} == {"k1": 7.0, "k2": None}
    assert stores.of_key(back, "/k1").first()["y"] is None and sorted(r["clip"] for r in stores.keys(back).collect()) == ["k1", "k2"]
    assert [r["clip"] for r in stores.collate([back], ["vid9DLC_dlcrnet_x.h5"]).select("clip").distinct().collect()] == ["vid9"]
    flat = str(tmp_path / "flat")
    stores.write_csv(stores.to_flat(back.where("clip = 'k1'")), flat, single=True)
    again = stores.read_wide_pose(spark, flat + "/" + [f for f in __import__("os").listdir(flat) if f.endswith(".csv")][0], "k1")
    assert again.where("bodypart = 'nose' and x = 7").count() == 1


def test_discover_and_first_match(spark, tmp_path):
    for n in ("a/BHVE_group1_000000-001799.mp4", "b/other.mp4", "a/BHVE_group1_000000-001799_filtered.h5"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    found = stores.discover(spark, str(tmp_path), r"(CTRL|BHVE)_group\d_\d{6}-\d{6}\.mp4")
    assert [r["name"] for r in found.collect()] == ["BHVE_group1_000000-001799.mp4"]
    assert stores.first_match(stores.discover(spark, str(tmp_path), ".*"), "BHVE_group1", "_filtered.h5").count() == 1
    assert stores.first_match(found, "nothing", ".h5").count() == 0


def test_occupancy_fractions_sum_to_one(spark, sf):
    from kinetrove.plans.queries import all_queries

    for r in all_queries()["roi_occupancy_fractions"](spark, sf).collect():
        assert abs(sum(r[1:]) - 1) < 1e-5


def test_streamed_sessions_equal_batch(spark, sf, tmp_path):
    from kinetrove.streaming.sessions import hit_sessions

    events_ = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    events_.coalesce(1).write.parquet(src)
    stream = hit_sessions(spark.readStream.schema(events_.schema).parquet(src), "value", 25.0, "5 minutes", late="3650 days", by=["user_id"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = hit_sessions(events_, "value", 25.0, "5 minutes", by=["user_id"])
    got = spark.table("sessions")
    assert got.count() == batch.count() > 0 and got.exceptAll(batch).count() == 0


def test_individual_and_frame_features_agree(spark, sf):
    from kinetrove.sources import fixtures

    p, roi = fixtures.pose(spark, sf), fixtures.roi(spark, sf)
    out = features.individual_features(p, roi, min_samples=6)
    assert out.count() == p.select("clip", "frame", "individual").distinct().count()


def test_entry_and_pruned_scan(spark):
    import __spark_entry__ as e
    from kinetrove.sources import fixtures

    assert e.entry(spark).count() > 0
    plan = fixtures.roi(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint>" in plan


def test_annotations_reach_every_clip(spark):
    d = "/root/testdata/sf0.1"
    events = X.events(spark, d)
    assert X.annotations(spark, d).count() == events.count()
    assert X.annotations(spark, d).where("start is not null").count() == events.where("value < 1").count()
    assert all(r["quivering_fraction"] > 0 for r in all_queries()["quivering_fraction"](spark, d).collect())


def test_window_speed_stays_inside_windows(spark):
    rows = [("c", f, "a", "stripe1", 3.0 * f * f, 4.0 * f * f) for f in range(4)]
    got = features.window_speed(spark.createDataFrame(rows, POSE), length=2).orderBy("start").collect()
    assert [tuple(r) for r in got] == [("c", 0, 1, 5.0), ("c", 2, 3, 25.0)]


def test_annotations_count_within_each_clip_s_own_frames(spark):
    a = spark.createDataFrame([("c", 12, 14), ("c", 18, 40), ("d", 12, 14), ("e", 0, 9), ("c", None, None), ("c", 5, None)], "clip string, start long, stop long")
    spans = spark.createDataFrame([("c", 10, 19), ("d", 0, 9)], "clip string, first long, last long")
    got = lambda mode: sorted((r["clip"], r["frame"]) for r in intervals.covered(a, spans, mode).collect())
    assert got("strict") == [("c", 12), ("c", 13), ("c", 18)]
    assert got("inclusive") == [("c", n) for n in (12, 13, 14, 18, 19)]


def test_long_clips_take_time_in_proportion(spark):
    import time

    def took(n):
        rows = spark.range(n).select(F.lit("c").alias("clip"), F.col("id").alias("frame"), (F.col("id") * 7 % 11 < 4).alias("hit"))
        began = time.perf_counter()
        out = sequences.labelled(rows, F.col("hit"), ["clip"], 15, 15, "e").agg(F.sum("e")).collect()
        return time.perf_counter() - began, out

    took(20_000)
    assert took(378_000)[0] < 30  # frames that end at the window's last row took half an hour


def test_feature_files_with_other_columns_and_orders(spark, tmp_path):
    for name, text in (("a", "clip,n,share\nx,1,0.5\n"), ("b", "share,clip\n0.9,y\n"), ("c", "n,extra,clip\n7,q,\"z,z\"\n"), ("d", "clip,n,share\nw,2,\n")):
        (tmp_path / f"{name}_clipfeatures.csv").write_text(text)
    (tmp_path / "notes.txt").write_text("clip\nno\n")
    fields = schema.T.StructType([schema.T.StructField("clip", schema.T.StringType()), schema.T.StructField("n", schema.T.LongType()), schema.T.StructField("share", schema.T.DoubleType())])
    got = sorted(tuple(r) for r in stores.read_features(spark, str(tmp_path), fields).collect())
    assert got == [("w", 2, None), ("x", 1, 0.5), ("y", None, 0.9), ("z,z", 7, None)]


def test_individuals_without_the_body_part_stay(spark):
    rows = [("c", 0, "a", "stripe1", 1.0, 1.0), ("c", 0, "a", "nose", 1.0, 1.0), ("c", 0, "b", "nose", 2.0, 2.0)]
    roi = spark.createDataFrame([("c", 0.0, 0.0, 5.0)], "clip string, roi_x double, roi_y double, roi_r double")
    got = {r["individual"]: (r["in_roi"], r["roi_occupancy"]) for r in features.individual_features(spark.createDataFrame(rows, POSE), roi).collect()}
    assert got == {"a": (True, 1), "b": (False, 1)}


def test_fractions_of_a_whole_trial(spark):
    rows = [("c", f, 1, 0, -1, 0 if f < 4 else -1, 0, f < 5) for f in range(10)]
    names = "clip string, frame long, nfish_frame long, nfish_pipe long, mouthing_event_id long, double_occupancy_event_id long, spawning_event_id long, quivering boolean"
    roi = spark.createDataFrame([("c", 0.0, 0.0, 5.0)], "clip string, roi_x double, roi_y double, roi_r double")
    table = spark.createDataFrame(rows, names)
    own, trial = (features.clip_features(table, roi, trial_frames=n).first() for n in (None, 100))
    assert (own["quivering_fraction"], own["double_occupancy_event_fraction"]) == (0.5, 0.4)
    assert (trial["quivering_fraction"], trial["double_occupancy_event_fraction"], trial["raw_zero_occupancy_fraction"]) == (0.05, 0.04, 1.0)


def test_a_shared_folder_is_asked_for_off_local_masters():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        stores.work_folder(Session(), "x")


def test_principal_plane_against_singular_values(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 4)) @ rng.standard_normal((4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(80, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double")
    got = projection.principal_plane(df, list("abcd")).orderBy("id").collect()
    _, _, v = np.linalg.svd(x - x.mean(0))
    v = v * np.sign(v[np.arange(4), np.abs(v).argmax(1)])[:, None]
    assert np.allclose([(r["axis_1"], r["axis_2"]) for r in got[:80]], (x - x.mean(0)) @ v[:2].T) and got[80]["axis_1"] is None
    assert projection.principal_plane(df.where("id = 80"), list("abcd")).first()["axis_2"] is None
