"""Hard negatives, sharding and whitening against plain Python, ties and odd rows included."""

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from kinetrove.llm import hard_negatives, sharding, whitening  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [(None, [0.5, 0.5, 0.5], 1), (901, None, 1), (902, [0.5, None, 0.5], 1), (903, [0.5, float("nan"), 0.5], 1), (904, [float("inf"), 0.0, 0.0], 1), (905, [0.25, 0.5, 0.5], None), (906, [3e38, 0.0, 1.0], 1)]


def naive_negatives(rows, every, positives, negatives):
    fine, out = [], []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = tuple(math.floor(256 * c) for c in v)
        if sum(c * c for c in x) < 1 << 61:
            fine.append((i, (label + 1) % 10 if i % 7 == 0 else label, x))
    fine = sorted(set(fine))
    for a in fine:
        if a[0] % every:
            continue
        score = {r: sum(p * q for p, q in zip(a[2], r[2])) for r in fine if r != a and len(r[2]) == len(a[2])}
        order = sorted(score, key=lambda r: (-score[r], r[0]))
        for p in [r for r in order if r[1] == a[1]][:positives]:
            found = [r for r in order if r[1] != a[1] and 30 * score[p] <= 100 * score[r] <= 90 * score[p]]
            out += [(a[0], p[0], k, r[0], score[p], score[r]) for k, r in enumerate(found[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,digit", [(1024, 8), (3, 3)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, block, digit):
    monkeypatch.setattr(hard_negatives, "DIGIT", digit)
    rng = random.Random(4)
    some = [[round(rng.uniform(-1, 1), 1) for _ in range(3)] for _ in range(12)]
    rows = [(i, rng.choice(some) if i % 3 else [rng.uniform(-1, 1) for _ in range(3)], rng.randrange(4)) for i in range(160)]
    rows += [(200 + i, some[0], i % 3) for i in range(90)]  # one vector that a third of the rows share, under several labels
    rows += rows[:20] + ODD + [(40, [0.1, 0.2, 0.3], 2), (910, [0.5, 0.5], 1), (920, [0.5, 0.25], 1), (921, [0.25, 0.5], 2), (930, [], 1)]
    vectors = spark.createDataFrame(rows, VECTORS).withColumns({"rank": F.lit("x"), "window": F.lit(1)}).repartition(5)
    got = hard_negatives.mine(vectors, "vec_id % 10 = 0", hard_negatives.shifted_label(), block=block)
    assert sorted(map(tuple, got.collect())) == naive_negatives(rows, 10, 5, 10)


def test_hard_negatives_of_few_and_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, "vec_id % 10 = 0", hard_negatives.shifted_label()).collect() == []
    alone = spark.createDataFrame([(100, [1.0, 0.0], 1)], VECTORS)
    assert hard_negatives.mine(alone, "vec_id % 10 = 0", hard_negatives.shifted_label()).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(i, [1e5 + i, 2e5 - i, 3.5], i % 2) for i in range(10, 40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(vectors, "vec_id % 10 = 0", hard_negatives.shifted_label())
    assert sorted(map(tuple, got.collect())) == naive_negatives(rows, 10, 5, 10)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _sharded(spark, texts, ids=None, **k):
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "size": F.lit(None)})
    return sharding.shard_documents(docs, **k).collect()


def test_shards_have_near_equal_bytes_and_gapless_places(spark):
    rng = random.Random(1)
    texts = ["wört " * rng.randrange(60) for _ in range(3000)] + ["long " * 20_000, None, "", None]
    out = _sharded(spark, texts)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == [(i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in enumerate(texts)]
    bytes_of, places = dict.fromkeys(range(24), 0), {s: [] for s in range(24)}
    for r in out:
        bytes_of[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    rest = sorted(bytes_of.values())[:-1]  # the long document fills a shard by itself
    assert max(bytes_of.values()) - min(rest) <= 100_008 and max(rest) - min(rest) <= 400
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}


def test_null_and_repeated_ids_spread(spark):
    out = _sharded(spark, ["same text"] * 2000 + ["other"], ids=[None] * 1000 + [5] * 1000 + [6])
    counts = [sum(r["shard"] == s for r in out) for s in range(24)]
    assert len(out) == 2001 and max(counts) - min(counts) <= 2
    assert _sharded(spark, []) == []


def test_a_new_shard_takes_slots_and_nothing_else_moves(spark, tmp_path):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(80), "en", "s", 0) for i in range(3000)], DOCS)
    rows = sharding.records(docs)
    bytes_of = {s: b for s, (_, b) in sharding.slot_sums(rows).items()}
    maps = sharding.ShardMap(spark, str(tmp_path / "map"))
    maps.add(sharding.first_map(bytes_of, 24), 1)
    version, moved = sharding.grown(docs, maps, 1, 25)
    moved = moved.collect()
    assert version == 2 and moved and {r["shard"] for r in moved} == {24}
    old, new = maps.shard_of(1), maps.shard_of(2)
    load = [sum(b for s, b in bytes_of.items() if new[s] == k) for k in range(25)]
    assert set(old) == set(new) and max(load) - min(load) <= 400
    assert len(moved) < 1.3 * 3000 / 25 and all(new[s] in (old[s], 24) for s in old)
    # heavier slots in one shard: some leave it, others stay
    heavy = {s: b * (3 if old[s] == 0 else 1) for s, b in bytes_of.items()}
    assert maps.rebalance(1 + 1, heavy, 25) == 3
    third = maps.shard_of(3)
    load = [sum(b for s, b in heavy.items() if third[s] == k) for k in range(25)]
    assert max(load) - min(load) <= 1000 and sum(third[s] != new[s] for s in bytes_of) < 400
    # a shard less: its slots alone go elsewhere
    fewer = sharding.edited_map(new, {}, 24)
    assert all(fewer[s] == new[s] for s in new if new[s] < 24) and max(fewer.values()) == 23


def check_whitened(rows, out, components=4):
    fine = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(256 * c) < 2**31 for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    want = {}
    for i, x in fine:
        far = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(min(components, len(sums))):
            want.setdefault((i, k + 1), []).append((far, float(np.dot([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)], vectors[:, k]) / math.sqrt(e[k]))))
    assert len(out) == sum(map(len, want.values()))
    turn = {}
    for r in sorted(out, key=lambda r: -abs(r["whitened"])):
        far, w = min(want[r["vec_id"], r["component"]], key=lambda p: abs(abs(p[1]) - abs(r["whitened"])))
        sign = turn.setdefault(r["component"], math.copysign(1, w * r["whitened"]))
        assert r["n"] == n and r["deviation"] == far and r["whitened"] == pytest.approx(sign * w, abs=1e-7)
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9) and r["identity_error"] <= 1e-9


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(3)
    mixed = rng.standard_normal((500, 7)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.1, 0.01]) @ rng.standard_normal((7, 7))
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(mixed)]
    rows += rows[:50] + [(1000 + i, rows[3][1]) for i in range(200)] + [(i, v) for i, v, _ in ODD if v is None or len(v) != 3] + [(907, [float("nan")] * 7), (None, rows[5][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"component": F.lit("x"), "n": F.lit(1)}).repartition(7)
    check_whitened(rows, whitening.whiten(vectors).collect())


def test_triangles_meet_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "ROWS", 5)
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    check_whitened(rows, whitening.whiten(vectors).collect())


def test_whitening_without_variance(spark):
    kinds = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kinds)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, []), (4, [1.0])], kinds)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one) == [(1, 1, 1, 0, None, None), (1, 2, 1, 0, None, None), (2, 1, 1, 0, None, None), (2, 2, 1, 0, None, None), (4, 1, 1, 0, None, None)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i), 2.0]) for i in range(9)], kinds)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in line)


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float((-1) ** i * 8e6), float(i)]) for i in range(300)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[256 * int(c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    far = {i: sum((300 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert all(r["deviation"] == (far[r["vec_id"]] if far[r["vec_id"]] < 2**63 else None) for r in out)


def test_small_deviations_are_accurate():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((40, 6)))
    p, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    want = np.array([1e8, 1e4, 1.0, 1e-2, 1e-4, 1e-6])
    graded = (q * want) @ p.T
    sigma, v = whitening.jacobi(np.linalg.qr(graded, mode="r"))
    assert np.abs(v.T @ v - np.eye(6)).max() < 1e-14
    assert sigma[:4] == pytest.approx(want[:4], rel=1e-6) and np.linalg.svd(graded, compute_uv=False)[:4] == pytest.approx(sigma[:4], rel=1e-9)
