"""Whole operators against plain Python on small tables, and rows that are odd in every column."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from kinetrove.llm import decontaminate, jaccard, licenses, neighbours, packing, quality, substrings, tables, token_io, toxicity, urls  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


# toxicity: the rules word by word, stems by counting, the curve by its own fit


def naive_kind(text):
    lists = (("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTING), ("intent", toxicity.FIRST_MODAL), ("subject", toxicity.FIRST), ("modal", toxicity.MODAL), ("copula", toxicity.COPULA))
    return next((k for k, names in lists if text in names), "other")


def naive_evidence(grammar, text):
    """What the composed transducers must give, by looking at the words around each match and counting down from those before it."""
    total, quoted, near = 0.0, False, toxicity.NEAR
    for line in toxicity.plain(text).split(b"\n"):
        words = line.split()
        bare = [w.strip(b"\x22'").decode("utf-8", "replace") for w in words]
        spoken = [w.strip(b"\x22").decode("utf-8", "replace") for w in words]
        people = [i for i, w in enumerate(spoken) if w in toxicity.TARGETS or w.rpartition("'")[0] in toxicity.TARGETS]
        reported, negated = False, None
        subject = intent = person = called = 0
        for i, raw in enumerate(words):
            if b"\x22" in raw and not raw.endswith(b"\x22"):
                quoted = not quoted
            kind = naive_kind(bare[i])
            if kind == "negation":
                negated = i
            elif kind == "report":
                reported = True
            elif kind == "other":
                weight, threat = grammar._match(bare[i].encode())
                if threat:
                    weight *= (1.5 if any(0 < t - i <= near for t in people) else 0.05) * (1.0 if i == 0 or intent else 0.05)
                else:
                    weight *= (1.5 if any(abs(i - t) <= near for t in people) else 1.0) * (1.25 if called else 1.0)
                weight *= 0.25 if negated is not None and i - negated <= near else 1.0
                total += weight * (0.6 if reported or quoted else 1.0)
            # intent and calling last for some words; a first person or person that is read meanwhile counts once they end
            armed = kind == "intent" or kind == "modal" and (subject or intent)
            subject, intent = (0, near) if armed else (0, intent - 1) if intent > 1 else (near if kind == "subject" else max(0, subject - 1), 0)
            if kind == "copula" and (person or called or i in people):
                person, called = 0, near
            else:
                person, called = (0, called - 1) if called > 1 else (near if i in people or kind == "subject" else max(0, person - 1), 0)
            if raw.endswith(b"\x22") and raw.count(b"\x22") % 2:
                quoted = not quoted
    return 4.0 * math.tanh(total / 16.0) + 0.5 * math.log1p(total)


def test_composed_transducers_against_the_rules():
    g, rng = toxicity.Grammar({b"zork": 4.0, b"abc$": 2.5}), random.Random(5)
    pool = ["you", "they", "idiot", "zorking", "abc", "abcd", "kill", "burned", "not", "never", "said", "claims", "plain", "word", "'moron'", "u", "i", "we", "will", "gonna", "i'll", "you're", "is", "are", "hurting", "someone", "idiotic", '"scum', 'trash"', '"loser"', '"', "he's"]
    for _ in range(400):
        text = "".join(rng.choice(pool) + rng.choice([" "] * 8 + [". ", "! ", ", ", "\n"]) for _ in range(rng.randrange(40)))
        assert g.evidence([toxicity.plain(text)])[0] == pytest.approx(naive_evidence(g, text), abs=1e-9), text


def test_the_whole_toxicity_query_against_brute_force(spark):
    rng = random.Random(6)
    clean, bad = ["alpha", "beta", "gamma", "delta", "you", "said", "not", "omega"], ["zorkish", "zorkal", "flurbed", "idiot", "grunkoa", "grunkob", "grunkic", "grunkel"]
    texts = [" ".join(rng.choice(bad if i % 4 == 0 and rng.random() < 0.5 else clean) for _ in range(rng.randrange(1, 30))) for i in range(240)]
    marks = [(i, 1, int(i % 4 == 0)) for i in range(0, 240) if i % 5]
    rows = toxicity.score_documents(docs(spark, texts), spark.createDataFrame(marks, LABELS)).collect()
    train = [(texts[i], t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {k: collections.Counter() for k in (0, 1)}
    for text, t in train:
        words = set(text.split())
        counts[t].update({w[:n] for w in words for n in range(5, 13) if len(w) >= n} | {w + "$" for w in words if len(w) >= 3})
    n1, n0 = sum(t for _, t in train), sum(1 - t for _, t in train)
    rate, stems = n1 / len(train), {}
    for s in sorted(counts[1], key=lambda s: (len(s), s)):
        b, g = counts[1][s], counts[0][s]
        p = b / (b + g + 0.5)
        family = s.endswith("$") or sum(w.startswith(s) for w in counts[1] if w.endswith("$")) >= 3
        if family and b >= 4 and p >= max(0.7, min(0.95, 2 * rate)) and b * math.log(p / rate) + (g + 0.5) * math.log((1 - p) / (1 - rate)) >= 10 and not any(s.startswith(x) for x in stems):
            stems[s] = math.log((b + 0.5) / (n1 + 1)) - math.log((g + 0.5) / (n0 + 1))
    assert "grunk" in stems and "zorkish$" in stems and not any("grunk".startswith(s) for s in stems if s != "grunk")
    grammar = toxicity.Grammar({s.encode(): w for s, w in stems.items()})
    x = np.array([naive_evidence(grammar, t) for t, _ in train])
    a, b = toxicity.fit_curve(np.round(x, 3), np.array([t for _, t in train], float))
    assert stems and len(rows) == len(texts)
    for r in rows:
        p = 1 / (1 + math.exp(-(a + b * naive_evidence(grammar, texts[r["doc_id"]]))))
        assert r["score"] == pytest.approx(p, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


# quality: counts, ratios, noise and the draw


def test_the_whole_draw_against_brute_force(spark):
    rng = random.Random(7)
    good, junk = [f"fine{i}" for i in range(30)], [f"spam{i}" for i in range(30)]
    texts = [" ".join(rng.choice(good if i % 3 else junk) for _ in range(rng.randrange(0, 40))) for i in range(150)] + [None, ""]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 150, 2)]
    rows = {r["doc_id"]: r for r in quality.resample(docs(spark, texts), spark.createDataFrame(labels, LABELS), seed=3).collect()}
    grams = [quality._buckets([(t or "").encode()])[0] for t in texts]
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, g in enumerate(grams):
        np.add.at(raw, g, 1)
        if i % 2 == 0 and i < 150 and i % 3:
            np.add.at(target, g, 1)
    base = (raw + 1) / (raw.sum() + quality.BUCKETS)
    ratio = np.log((target + 0.5 * base * quality.BUCKETS) / (target.sum() + 0.5 * quality.BUCKETS)) - np.log(base)
    weight = np.array([ratio[g].sum() for g in grams])
    mixed = quality.mix(np.arange(len(texts)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(3))
    key = weight - np.log(-np.log(((mixed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53))
    k = round(sum(q for _, q, _ in labels) / len(labels) * len(texts))
    assert set(rows) == set(np.argsort(-key, kind="stable")[:k].tolist())
    assert all(r["log_weight"] == pytest.approx(weight[i], abs=1e-6) and r["n_grams"] == len(grams[i]) for i, r in rows.items())


# decontamination: edit distance of every item to every document


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_all_items_in_all_documents_against_dynamic_programming(spark):
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(40)
    items = [[word() for _ in range(rng.choice((1, 3, 5, 9, 20, 33, 70)))] for _ in range(25)]
    items += [items[4], ["w1", "w2", "w3", "w4"] * 6]
    texts = []
    for _ in range(60):
        text = [word() for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            copy = list(rng.choice(items))
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.choice((0, 1))] = rng.choice(([], [word()]))
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
        texts.append(text)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    table = docs(spark, [" ".join(t) for t in texts])
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(table, bench).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            if (n := least_edits(item, text)) <= decontaminate.budget(len(item), 15):
                want[d, i] = n
    assert got == want and any(want.values())
    assert sorted(r["doc_id"] for r in decontaminate.clean(table, bench).collect()) == sorted(set(range(60)) - {d for d, _ in want})


def test_a_nearly_full_filter_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 64)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(40)], "item_id long, text string")
    table = docs(spark, [f"x y a{i} b{i} c{i} d{i} e{i} f{i} z" for i in range(0, 40, 3)])
    assert sorted(r["item_id"] for r in decontaminate.find_leaks(table, bench).collect()) == list(range(0, 40, 3))


# tokens: ids of the library itself


@pytest.mark.parametrize("name,end", (("word_bpe_49k.json", 1), ("byte_bpe_50k.json", 2)))
def test_pieces_and_files_hold_the_library_s_ids(spark, sf, name, end):
    from tokenizers import Tokenizer

    texts = [None, "", "a", "x " * 2500, "don't 12,3 日本語\x00"] + [r["text"] for r in tables.table(spark, sf, "documents").limit(30).collect()]
    library = Tokenizer.from_file(P.path(name))
    library.encode_special_tokens = True
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]
    if end == 1:
        for r in packing.pack_documents(docs(spark, texts), P.path(name)).collect():
            mine = ids[r["doc_id"]]
            assert r["doc_tokens"] == len(mine) and r["ids_crc32"] == zlib.crc32(mine[r["start"] : r["start"] + r["length"]].tobytes())
    else:
        rows = token_io.round_trip(docs(spark, texts), P.path(name)).orderBy("doc_id").collect()
        assert [(r["n_tokens"], r["ids_crc32"]) for r in rows] == [(len(x), zlib.crc32(x.tobytes())) for x in ids]


def test_windows_are_nearly_full(spark, sf):
    rows = packing.pack_documents(tables.table(spark, "/root/testdata/sf0.1", "documents"), P.path("word_bpe_49k.json"))
    load = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("padded_to").alias("p")).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.max("n").alias("most")).first()
    assert load["most"] <= 2048 and load["n"] > 0.97 * load["p"]


@pytest.mark.parametrize("bits", (False, True))
def test_a_range_of_ids_reads_its_blocks_alone(bits):
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) for n in (100_000, 0, 70_000, 9)]
    raw, whole = token_io.encode_segment([1, 2, 3, 4], parts, bits), np.concatenate(parts)
    for a, b in ((0, 5), (65_530, 65_540), (131_071, 170_009), (170_009, 170_009), (0, 10**9)):
        assert (token_io.read_range(raw, a, b) == whole[a:b]).all()
    broken = bytearray(raw)
    last = token_io._entry(bits).unpack_from(raw, token_io.HEAD.size + 16 * 4 + 2 * token_io._entry(bits).size)[0]
    broken[last : last + 20] = bytes(20)
    assert (token_io.read_range(bytes(broken), 0, 131_072) == whole[:131_072]).all()


# near copies: what leaves the tiles


def test_one_family_over_many_tiles_gives_few_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    seen = {}

    def spied(name):
        f = getattr(jaccard, name)

        def g(*a):
            out = tables.stored(f(*a), name)
            seen[name] = (a[0].count(), out.count(), out)
            return out

        monkeypatch.setattr(jaccard, name, g)

    spied("_groups")
    spied("_forest")
    rng, texts = random.Random(4), []
    base = ["b%d" % i for i in range(150)]
    for i in range(160):  # two halves whose members miss each other's hubs by a little
        words = list(base)
        for at in rng.sample(range(150), 3):
            words[at] = f"n{i}x{at}"
        texts.append(" ".join(words))
    got = jaccard.jaccard_components(docs(spark, texts)).collect()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    parent = list(range(160))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(160):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(160)}
    rows, ties, _ = seen["_groups"]
    assert ties <= 10 * rows and seen["_forest"][1] <= ties


def test_url_tree_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.one.com", "b.one.com", "two.net", "x.two.net", "three.org"]
    data = []
    for _ in range(400):
        parts = [rng.choice(("en", "es", "p", "q")), rng.choice(("item", "".join(rng.choice("abcdefgh") for _ in range(5)), str(rng.randrange(99))))] + rng.choice(([], ["z"], ["z", "12", "t"]))
        data.append(f"http://{rng.choice(hosts)}/" + "/".join(parts) + rng.choice(("", "/", "?x=1")))
    data += [None, "", "://", "no scheme", "http://two.net"]
    rules = [("allow", "one.com", "/en/"), ("block", "net", "/es/"), ("block", "x.two.net", "/p/"), ("block", "b.one.com", "/q/")]
    cut = []
    for u in data:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        cut.append((m[1].lower(), m[2]))
    said, general = [], []
    for h, p in cut:
        fits = [(len(rh + rp), v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        said.append(max(fits)[1] if fits else None)
        general.append(re.sub("[0-9]+", "{n}", p).split("/"))
    node = [""] * len(data)
    for k in range(max(map(len, general))):
        at = collections.defaultdict(collections.Counter)
        for i, g in enumerate(general):
            if k < len(g):
                at[cut[i][0], node[i]][g[k]] += 1
        wide = set()
        for key, children in at.items():
            n = sum(children.values())
            s = (len(children) - 1) / n
            if (s + 1.92 / n - 1.96 * math.sqrt(s * (1 - s) / n + 0.96 / (n * n))) / (1 + 3.84 / n) > urls.NEW:
                wide.add(key)
        node = [x if k >= len(g) else x + ("/" if k else "") + ("*" if (cut[i][0], x) in wide else g[k]) for i, (x, g) in enumerate(zip(node, general))]
    sums = [collections.Counter() for _ in range(3)]
    domain = [".".join(h.split(".")[-2:]) for h, _ in cut]
    for i, s in enumerate(said):
        for c, key in zip(sums, ((cut[i][0], node[i]), (domain[i], node[i]), node[i])):
            c[key, "n"] += s is not None
            c[key, "good"] += s == "allow"
    want = {}
    for i, s in enumerate(said):
        (g, n), (pg, pn), (ag, an) = ((c[key, "good"], c[key, "n"]) for c, key in zip(sums, ((cut[i][0], node[i]), (domain[i], node[i]), node[i])))
        near = (pg + 2 * (ag + 1) / (an + 2)) / (pn + 2)
        alike = (g * pn - pg * n) ** 2 <= 3.84 * pg * (pn - pg) * n
        purity = round(near if alike else (g + 2 * near) / (n + 2), 9)
        want[i] = (cut[i][0], node[i], s or ("block" if purity < 0.5 else "allow"), purity)
    df = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["template"], r["verdict"], r["purity"]) for r in urls.judge_urls(df, rules).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(got[k][3] == pytest.approx(want[k][3], abs=1e-8) for k in want)
    assert {v[2] for k, v in want.items() if said[k] is None} == {"allow", "block"} and any("*" in v[1] for v in want.values())


def test_repeats_are_maximal_stretches(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(40))
    rows = substrings.remove_repeats(docs(spark, [f"x {one} y {two}", f"{one} z", f"{two} {two}"])).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r["repeats"]] for r in rows] == [[(1, 50), (52, 40)], [(0, 50)], [(0, 80)]]


# neighbours on the given vectors


def test_neighbours_on_the_given_vectors(spark):
    rows = tables.table(spark, "/root/testdata/sf0.1", "embeddings")
    local = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    ids, x = np.array([i for i, _ in local]), np.array([v for _, v in local], float)
    want, near = {}, set()
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.where(ids == ids[i], -2, neighbours.cosine(x, x[i]))
        best = sorted(zip(-s, ids.tolist()))[:5]
        want[int(ids[i])] = [j for _, j in best]
        near |= {(int(ids[i]), j) for t, j in best if -t >= 0.8}
    found = collections.defaultdict(list)
    for r in neighbours.search(rows, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert dict(found) == want
    curves = {(r["query_id"], r["vec_id"]) for r in neighbours.search(rows, "vec_id % 50 = 0", exact=False).collect()}
    assert len(near & curves) >= 0.9 * len(near)


# odd rows


LONG = ["w " * 20_000, "y" * 200_000, " ".join(f"u{i}" for i in range(20_000))]
TEXTS = [None, "", " \n\t", "a", "same words here", "same words here", "same words here", *LONG, LONG[2]]
CLASH = "rid sid n gram spans runs key path item probe held_out score predicted bits component kind header ids start part rank purity id".split()


def odd(spark):
    rows = [(i if i % 4 else None, t, None if i % 2 else "en", None if i % 3 else "s", None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (5, "same id, other words", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASH}).withColumn("Text_", F.lit(None).cast("string"))


def test_odd_rows_through_every_text_operator(spark):
    df, n = odd(spark).cache(), len(TEXTS) + 3
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (5, None, None), (6, 0, 1)], LABELS)
    bench = spark.createDataFrame([(1, None), (None, "same words here"), (2, ""), (2, "same words here"), (3, LONG[2])], "item_id long, text string").withColumn("rid", F.lit(0))
    path = P.path("word_bpe_49k.json")
    packed = packing.pack_documents(df, path).collect()
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0) and sum(r["start"] == 0 for r in packed) == n
    scored = toxicity.score_documents(df, labels).collect()
    assert len(scored) == n and all(r["predicted"] == 0 and not (r["doc_id"] is None and r["held_out"]) for r in scored)
    assert toxicity.drop_toxic(df, labels).columns == df.columns and toxicity.drop_toxic(df, labels).count() == n
    drawn = quality.resample(df, labels, share=1.0)
    assert drawn.count() == n and quality.resample(df, labels, share=0.0).count() == 0
    files = token_io.round_trip(df, P.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert len(files) == n and [r["start"] for r in files] == np.cumsum([0, *(r["n_tokens"] for r in files[:-1])]).tolist()
    assert [r["doc_id"] is None for r in files] == sorted((r["doc_id"] is None for r in files), reverse=True)
    sets = sorted((r["n_shingles"], r["component_id"] or -1) for r in jaccard.jaccard_components(df).collect())
    assert len(sets) == n and [s for s, _ in sets].count(0) == 3 and [s for s, _ in sets].count(19_996) == 2
    leaks = collections.Counter((r["item_id"], r["distance"]) for r in decontaminate.find_leaks(df, bench).collect())
    assert leaks == {(None, 0): 5, (2, 0): 5, (3, 0): 2}
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == n - 7
    cut = substrings.remove_repeats(df).collect()
    assert len(cut) == n and sorted(r["n_removed"] for r in cut)[-4:] == [0, 20_000, 20_000, 20_000]
    marked = licenses.scan_documents(df).collect()
    assert len(marked) == n and all(r["license"] is None for r in marked)


def test_empty_tables_through_every_operator(spark):
    none, labels = docs(spark, ["x"]).limit(0), spark.createDataFrame([], LABELS)
    bench, path = spark.createDataFrame([], "item_id long, text string"), P.path("word_bpe_49k.json")
    found = [
        packing.pack_documents(none, path), toxicity.score_documents(none, labels), toxicity.drop_toxic(none, labels), urls.judge_urls(spark.createDataFrame([], "page_id long, url string")),
        quality.resample(none, labels), token_io.round_trip(none, path), jaccard.jaccard_components(none), decontaminate.find_leaks(none, bench), decontaminate.clean(none, bench),
        neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 50 = 0"), substrings.remove_repeats(none), licenses.scan_documents(none),
    ]
    assert [df.count() for df in found] == [0] * 12
    assert decontaminate.clean(docs(spark, ["x y"]), bench).count() == 1


def test_odd_vectors_and_pages(spark):
    big = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [-1.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (1, [1.0, 1.0]), (50, [1.0, 1.0]), (100, [5e-324, 0.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ("v", "cid", "score", "rank", "place", "curve")})
    got = [(r["query_id"], r["vec_id"], round(r["score"], 9)) for r in neighbours.search(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect()]
    half = round(math.sqrt(0.5), 9)
    assert got == [(0, 1, 1.0), (0, 50, 1.0), (0, 100, half), (0, 2, 0.0), (50, 0, 1.0), (50, 1, 1.0), (50, 100, half), (50, 2, 0.0), (100, 0, half), (100, 1, half), (100, 50, half), (100, 2, -half)]
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None), (2, "http://b.net/" + "y/" * 500)], "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "node", "part", "good", "template")})
    rows = urls.judge_urls(pages).collect()
    assert len(rows) == 4 and [r["verdict"] for r in rows if r["page_id"] == 1] == ["allow", "allow"]
