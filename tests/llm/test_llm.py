"""The training-data operators against brute force, round trips and held-out labels, on small tables."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from kinetrove.llm import decontaminate, jaccard, licenses, neighbours, packing, quality, substrings, tables, token_io, tokencache, toxicity, urls  # noqa: E402
from kinetrove.llm.components import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "a b", "\t\n", "x " * 3000, "é" * 50, "a\x00b", "  two  spaces \n\n", "日本語 テスト", "don't stop 12 3"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def random_docs(seed, n=60, vocabulary=400):
    """Random texts with exact copies, near copies and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(vocabulary)
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.choice((2, 4, 30, 80, 200)))]
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage
        if i % 5 == 1 and out:
            words = rng.choice(out).split()
            for _ in range(rng.choice((0, 1, 2, 5))):
                if words:
                    words[rng.randrange(len(words))] = word()
        out.append(rng.choice((" ", "\n")).join(words))
    return [*ODD, *out, out[3], out[3]]


def brute_links(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", (1, 2))
def test_jaccard_components(spark, seed):
    texts = random_docs(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute_links(texts)))


def test_jaccard_tiles_agree_with_many_near_copies(spark, monkeypatch):
    """A family larger than a tile, so that tiles are cut into blocks."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    rng = random.Random(9)
    base = ["b%d" % i for i in range(120)]
    texts = []
    for _ in range(50):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = "n%d" % rng.randrange(10_000)
        texts.append(" ".join(w))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute_links(texts)))


def test_bitmap_bound_never_drops_a_link():
    rng = np.random.default_rng(3)
    for n in (5, 60, 900, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.95)], rng.integers(0, 2**63, max(1, n // 20)).astype(np.uint64)]))
        x, y = (np.frombuffer(jaccard._bitmap(s), np.uint64)[None, :] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        apart = int(np.bitwise_count(jaccard._folded(x, width) ^ jaccard._folded(y, width)).sum())
        assert (len(a) + len(b) - apart) // 2 >= len(np.intersect1d(a, b))


def brute_repeats(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("seed,vocabulary", ((1, 400), (2, 2), (3, 30)))
def test_substrings(spark, seed, vocabulary):
    texts = random_docs(seed, vocabulary=vocabulary)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))


def test_repeated_ids_and_null_ids_are_rows_of_their_own(spark):
    long = " ".join("u%d" % i for i in range(50))
    rows = [(1, long, "en", "s", 1), (1, "other words", "en", "s", 1), (None, long, "en", "s", 1), (None, None, None, None, None)]
    table = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(table).collect())
    assert got == [("1", 2, 0), ("1", 50, 50), ("None", 0, 0), ("None", 50, 50)]
    assert jaccard.jaccard_components(table).count() == 4
    assert quality.resample(table, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 4


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == find(x) for pair in links for x in pair if pair[0] != pair[1])


@pytest.mark.parametrize("name,spaced", (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)))
def test_cached_tokens_are_the_library_s(spark, sf, name, spaced):
    from tokenizers import Tokenizer

    texts = [t or "" for t in ODD] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += ["a  b", "x 'll y's", "<|endoftext|>", "İstanbul ΑΣ", "a​b c", "ﬁ ½ ²", "tab\there", "a\r\nb", "É ́x", "“q” — ok…", "1,000.5% (a)b"]
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    mine = tokencache.TokenCache(P.path(name), spaced, limit=500)
    for _ in range(2):
        assert [x.tolist() for x in mine.encode([s.encode() for s in texts])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_holds_every_id_once(spark):
    texts = random_docs(5) + ["long " * 9000]
    rows = packing.pack_documents(docs(spark, texts), P.path("word_bpe_49k.json")).collect()
    ids = tokencache.TokenCache(P.path("word_bpe_49k.json"), False).encode([(t or "").encode() for t in texts])
    ids = [np.append(x, 1).astype("<u4") for x in ids]
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) and r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sorted(by_doc) == list(range(len(texts)))


def test_differencing_raises_the_count_when_nothing_may_be_cut():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 100) for _ in range(200)]
    for cut in (True, False):
        windows = packing.pack(sizes, 100, cut)
        assert sorted(x for w in windows for i, a, n in w for x in range(sum(sizes[:i]) + a, sum(sizes[:i]) + a + n)) == list(range(sum(sizes)))
        assert max(sum(n for _, _, n in w) for w in windows) <= 100
    assert len(packing.pack(sizes, 100)) == -(-sum(sizes) // 100)
    assert packing.pack([60, 60, 60], 100, cut=False) and len(packing.pack([60, 60, 60], 100, cut=False)) == 3
    loads = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 20)]
    assert max(loads) - min(loads) <= 20


@pytest.mark.parametrize("bits", (False, True))
def test_segments_round_trip(bits):
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 7, 70_000, 3)]
    names, back = token_io.decode_segment(token_io.encode_segment([5, 6, 7, 8, 9], parts, bits))
    assert names == [5, 6, 7, 8, 9] and all((a == b).all() and len(a) == len(b) for a, b in zip(parts, back))


def test_token_files(spark):
    texts = random_docs(6)
    rows = token_io.round_trip(docs(spark, texts).repartition(3), P.path("byte_bpe_50k.json"), segment_ids=2000).orderBy("doc_id").collect()
    ids = tokencache.TokenCache(P.path("byte_bpe_50k.json"), True).encode([(t or "").encode() for t in texts])
    at = 0
    for r, x in zip(rows, ids, strict=True):
        x = np.append(x, 2).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)


def test_token_files_keep_null_ids(spark):
    df = spark.createDataFrame([(None, "one two"), (5, "three"), (None, "four five six"), (0, "seven")], "doc_id long, text string")
    got = sorted(token_io.round_trip(df, P.path("byte_bpe_50k.json"), segment_ids=3).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 0, 5]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(4)]


def test_leaks(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("t%d" % rng.randrange(3000) for _ in range(n))
    items = [text(40) for _ in range(20)] + [None, "", "only three words"]
    edited = items[4].split()
    edited[3:4], edited[20:21], edited[30:31] = ["X"], [], ["Y", "Z"]
    bad = [text(100) + " " + items[0] + " " + text(50), items[1].upper().replace(" ", ",\n"), text(9) + " " + " ".join(edited) + " " + text(9)]
    half = " ".join(items[5].split()[:20])
    table = docs(spark, [*bad, half, text(300), *ODD])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(table, bench).collect()}
    assert got == {(0, 0): 0, (1, 1): 0, (2, 4): 4}
    kept = decontaminate.clean(table, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(3, 5 + len(ODD))) and kept.columns == table.columns
    assert decontaminate.find_leaks(table, bench.limit(0)).count() == 0 and decontaminate.find_leaks(table.limit(0), bench).count() == 0


def test_myers_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        p, t = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (12, 30))
        masks = collections.defaultdict(int)
        for i, c in enumerate(p):
            masks[c] |= 1 << i
        row = [0] * (len(t) + 1)
        for c in p:
            new = [row[0] + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontaminate.distance(masks, len(p), t)[0] == min(row)


def test_toxicity_on_held_out_labels(spark):
    root = "/root/testdata/sf0.1"
    rows = toxicity.score_documents(tables.table(spark, root, "documents"), tables.table(spark, root, "labels")).where("held_out").join(tables.table(spark, root, "labels").select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.8 and hit / sum(r["predicted"] for r in rows) > 0.9


ORDINARY = """More work.|We discuss the distance and travel more.|The world is a path of work.|The clock is on the wall.|He was lost in discussion.|Scrutiny of the work is needed.|A closed door.
The idea is idiosyncratic.|Morning comes.|She works hard for them.|They travel a long distance every year.|The path was closed at night.|A scarf and a scooter.|Traditional music was played.
We will discuss this with you tomorrow.|The company said it would cut costs.|I will call you back.|You should read this book.|The stable door was shut.|More distance, less work, and the world clock.""".replace("\n", "|").split("|")
THREATENING = "I will kill you|I'm going to hurt you|We will find you and murder your family|Kill yourself|You are such a stupid loser".split("|")


def test_ordinary_english_is_clean_and_threats_are_not(spark):
    root = "/root/testdata/sf0.1"
    score = toxicity.train(tables.table(spark, root, "documents"), tables.table(spark, root, "labels"))
    p = dict(zip(ORDINARY + THREATENING, score([toxicity.plain(t) for t in ORDINARY + THREATENING])))
    assert all(p[t] < 0.3 for t in ORDINARY) and all(p[t] >= 0.3 for t in THREATENING), p


def test_toxicity_grammar_and_odd_rows(spark):
    g = toxicity.Grammar({b"zork": 4.0})
    e = lambda s: g.evidence([toxicity.plain(s)])[0]
    assert e("fine words only") == e("") == 0
    assert e("you idiot") > e("what an idiot") > e("he is not an idiot") > 0
    assert e("they said what an idiot") < e("what an idiot") and e("i will kill you") > e("kill the process")
    assert e("ZORKING, indeed") > 0 and e("“nothing”") == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs(spark, [*ODD, "you pathetic idiot moron"]), empty).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in out) and out[-1]["predicted"] == 1 and sum(r["predicted"] for r in out) == 1
    assert sum(r["held_out"] for r in out) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(out)))


def test_prefilter_passes_words_in_any_quotes():
    g = toxicity.Grammar({b"zork": 4.0, b"abc$": 4.0})
    for text in ("'idiot'", '"' + "'idiot'" + '"', "'" * 2 + "zorking", "'" * 3 + '"abc' + "'" * 2, '"' * 2 + "abc"):
        score = sum(g.clause(x.split(), False)[0] for x in toxicity.plain(text).split(b"\n"))
        assert score > 0 and g.evidence([toxicity.plain(text)])[0] > 0, text
    assert g.evidence([toxicity.plain("'' ' abcd")])[0] == 0


def test_all_word_families_are_learned(spark):
    name = lambda i: "".join("bcdfghjklm"[int(d)] for d in f"{i:04d}") + "abcdefgh"
    bad = [(" ".join(name(i) for i in range(700)), 1)] * 12
    stems = toxicity.learn_stems(spark.createDataFrame(bad + [("fine words only", 0)] * 40, "text string, toxic int"))
    assert all(any((name(i) + "$").encode().startswith(s) for s in stems) for i in range(700))
    assert not any(a != b and b.startswith(a) for a in stems for b in stems)


def test_quality_sampling(spark):
    root = "/root/testdata/sf0.1"
    labels = tables.table(spark, root, "labels")
    kept = quality.resample(tables.table(spark, root, "documents"), labels)
    both = labels.where("quality is not null").join(kept.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("k", F.lit(0))).alias("share")).collect()
    share = {r["quality"]: r["share"] for r in both}
    assert share[1] > 0.95 and share[0] < 0.2


def test_largest_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, round(rng.gauss(0, 1), 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "rid long, key double")
    for k in (0, 1, 17, 1500, 3000, 5000):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        got = quality.largest(df, "key", "rid", k, bins=4, few=5).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def brute_near(rows, k=5):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            s = sorted((-round(float(neighbours.cosine(w[None, :], v)[0]), 12), j) for j, w in ok if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


def test_neighbours_and_recall_of_the_curves(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.05 * rng.standard_normal(16)).tolist() if i % 3 else rng.standard_normal(16).tolist()) for i in range(600)]
    rows += [(i, rows[7][1]) for i in range(600, 700)] + [(701, None), (702, [0.0] * 16), (703, [None] * 16), (704, [float("nan")] * 16), (705, []), (None, rows[1][1]), (750, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = collections.defaultdict(list)
    for r in neighbours.search(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
        assert r["rank"] == len(found[r["query_id"]])
    assert dict(found) == brute_near(rows)
    fast = neighbours.search(df.where("vec_id % 3 != 0 or vec_id >= 600"), "vec_id % 50 = 0", exact=False).collect()
    want = brute_near([r for r in rows if r[0] is not None and (r[0] % 3 or r[0] >= 600)])
    assert sum(r["vec_id"] in want[r["query_id"]] for r in fast) >= 0.9 * sum(map(len, want.values()))
    assert neighbours.search(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_neighbours_of_each_length(spark):
    r = np.random.default_rng(3)
    data = [(i, [float(x) for x in r.normal(size=8 if i % 3 else 5)]) for i in range(90)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for x in neighbours.search(df, "vec_id < 12").orderBy("query_id", "rank").collect():
        got[x["query_id"]].append(x["vec_id"])
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in data}
    for q in range(12):
        assert got[q] == sorted((i for i in unit if i != q and len(unit[i]) == len(unit[q])), key=lambda i: -unit[i] @ unit[q])[:5]


def test_hilbert_visits_every_cell_once_by_unit_steps():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(neighbours.hilbert(cells, 3))
    assert sorted(neighbours.hilbert(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_urls(spark):
    rows = [
        ("https://A.Example.COM/en/5?x#y", "a.example.com", "/en/5", "example.com/en/", "block"),
        ("http://www.example.com/en/5", "www.example.com", "/en/5", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
        ("http://b.net?es", "b.net", "", None, "allow"),
        ("http://c.com", "c.com", "", None, "allow"),
        ("no scheme/en/", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], "") for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df).orderBy("page_id").collect()]
    assert got == [r[1:] for r in rows]


def test_url_templates_block_what_their_labels_say(spark):
    rows = [("block", "x.org", f"/spam/{i}/a") for i in range(3)]
    data = [f"http://x.org/spam/{i}/a" for i in range(3)] + ["http://x.org/spam/77/a", "http://x.org/good/77/a"] + [f"http://y.org/p{chr(97 + i % 26)}{'q' * (i // 26)}/z" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    got = {data[r["page_id"]]: (r["template"], r["verdict"]) for r in urls.judge_urls(df, rows).collect()}
    assert got["http://x.org/spam/77/a"] == ("/spam/{n}/a", "block") and got["http://x.org/good/77/a"][1] == "allow"
    assert got[data[-1]] == ("/*/z", "allow")
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_url_templates_go_down_to_the_last_segment(spark):
    rules = [("block", "org", "/a/b/c/spam/"), ("allow", "org", "/a/b/c/d/e/f/g/ok")]
    data = [f"http://w.org/a/b/c/spam/{'x' * (i + 1)}" for i in range(25)] + ["http://w.org/a/b/c/good/x", "http://w.org/a/b/c/d/e/f/g/ok/y", "http://w.org/a"]
    df = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    got = {data[r["page_id"]]: (r["template"], r["verdict"]) for r in urls.judge_urls(df, rules).collect()}
    assert got[data[0]] == ("/a/b/c/spam/*", "block") and got[data[25]] == ("/a/b/c/good/x", "allow")
    assert got[data[26]] == ("/a/b/c/d/e/f/g/ok/y", "allow") and got[data[27]] == ("/a", "allow") and len(got) == 28


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/b/LICENSE", gpl), (2, "a/b/c/x.txt", "no notice"), (3, "a/b/c/y.txt", "head\n" + mit + "\nmore text"), (4, "a/z.txt", "nothing"),
        (5, "a/b/c/LICENSE", mit), (6, "root.txt", None), (7, None, mit), (8, "q/w.txt", "the licensee was late"), (9, "a/b/d/e/f.txt", ""), (10, "a/b/c/y.txt", "x " * 4000),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    got = {r["id"]: (r["license"], r["basis"], r["from_directory"]) for r in licenses.scan(df).collect()}
    assert got[2] == ("MIT", "directory", "a/b/c") and got[3][:2] == ("MIT", "header") and got[9] == ("GPL-3.0", "directory", "a/b")
    assert got[1][:2] == ("GPL-3.0", "header") and got[4] == (None, "none", None) and got[6] == (None, "none", None) and got[7][:2] == ("MIT", "header") and got[8][0] is None
    assert len(got) == 10 and licenses.scan(df.limit(0)).count() == 0


#: Public licence texts (fixed values).
MIT_TEXT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
BSD_TEXT = """BSD 3-Clause License

Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
"""
ISC_TEXT = """ISC License

Copyright (c) 2020, Some Body

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.
"""


def test_real_licence_files_license_their_directories(spark):
    rows = [
        (1, "a/LICENSE", MIT_TEXT), (2, "a/y.py", "x = 1"), (3, "a/src/deep/x.py", None), (4, "b/COPYING.txt", BSD_TEXT), (5, "b/z.c", "int z;"), (6, "b/sub/LICENSE", ISC_TEXT),
        (7, "b/sub/w.c", ""), (8, "c/q.py", "y = 2"), (9, "a/src/own.py", "# Released under the ISC license\nimport numbers\n\n\ndef half(value):\n    return value / 2 if isinstance(value, numbers.Real) else None\n"), (10, "d/LICENSE", "no terms here"), (11, "d/e.py", "z"),
    ]
    got = {r["id"]: (r["license"], r["basis"], r["from_directory"]) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got[1][:2] == ("MIT", "header") and got[4][:2] == ("BSD-3-Clause", "header") and got[6][:2] == ("ISC", "header")
    assert got[2] == ("MIT", "directory", "a") and got[3] == ("MIT", "directory", "a") and got[5] == ("BSD-3-Clause", "directory", "b") and got[7] == ("ISC", "directory", "b/sub")
    assert got[8] == (None, "none", None) and got[9][:2] == ("ISC", "header") and got[10][1] == got[11][1] == "none"


def test_urls_that_share_hundreds_of_segments(spark):
    shared = "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    data = [f"http://deep.org/{shared}/{end}" for end in ("one", "two", "two/more", "")] + [f"http://deep.org/{shared}"]
    data += [f"http://wide.org/{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}x/page" for i in range(100)]
    began = time.time()
    rows = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(list(enumerate(data)), "page_id long, url string")).collect()}
    assert [rows[i]["template"] for i in range(5)] == [f"/{shared}/one", f"/{shared}/two", f"/{shared}/two/more", f"/{shared}/", f"/{shared}"]
    assert {rows[i]["template"] for i in range(5, 105)} == {"/*/page"}
    assert time.time() - began < 60


def test_short_items_have_their_budget(spark):
    item = "one two three four five six seven"
    leaks = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [f"x {item} y", "x one two three four FIVE six eight y", "x one two nine four five six seven y", "one two nine ten five six seven", "three two one"]
    got = {(r["doc_id"], r["distance"]) for r in decontaminate.find_leaks(docs(spark, texts), leaks).collect()}
    assert decontaminate.budget(7, 15) == 1 and got == {(0, 0), (1, 1), (2, 1)}


def test_licenses_without_licence_words_and_of_any_length(spark):
    bsd, mit = "Redistribution and use in source and binary forms", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [
        (1, "a/x.txt", f"some code\n{bsd}\nmore code"), (2, "b/x.txt", mit), (3, "c/LICENSE", mit), (4, "c/d/y.txt", "plain prose"),
        (5, "e/z.txt", "Released under the MIT License.\n" * 100), (6, "e/w.txt", "plain prose"), (7, "f/v.txt", "to any person of the public, in this way and at no charge, a copy was sold"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    got = {r["id"]: (r["license"], r["basis"], r["from_directory"]) for r in licenses.scan(df).collect()}
    assert got[1][0].startswith("BSD-") and got[1][1] == "header" and got[2] == ("MIT", "header", None)
    assert got[4] == ("MIT", "directory", "c") and got[6] == ("MIT", "directory", "e") and got[7] == (None, "none", None)


def brute_cosine(files):
    """Best template of each file's headers, computed by dictionaries."""
    import math
    import re

    terms = lambda s: collections.Counter(re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)?", s.lower()))
    heads = {h.strip(" ") for _, t in files if t for h in re.findall(licenses.HEADER, t)}
    df = collections.Counter(x for h in heads for x in terms(h)) + collections.Counter(x for _, t in licenses.TEMPLATES for x in terms(t))
    n = len(heads) + len(licenses.TEMPLATES)
    idf = {x: math.log((n + 1) / (k + 0.5)) for x, k in df.items()}
    vec = lambda s: {x: k * idf[x] for x, k in terms(s).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known, out = [(name, vec(text)) for name, text in licenses.TEMPLATES], {}
    for i, t in files:
        found = []
        for h in {h.strip(" ") for h in re.findall(licenses.HEADER, t or "")}:
            v = vec(h)
            tried = [(-round(sum(v[x] * w.get(x, 0) for x in v) / (norm(v) * norm(w)), 6) if v else 0, name) for name, w in known]
            found += [(best[1].startswith("LicenseRef"), *best) for best in [min(tried)] if -best[0] >= licenses.MATCH]
        out[i] = min(found)[2] if found else None
    return out


def test_license_headers_against_brute_force(spark, sf):
    rows = tables.table(spark, sf, "documents")
    files = [(r["doc_id"], r["text"]) for r in rows.collect()]
    got = {r["doc_id"]: r["header_license"] for r in licenses.scan_documents(rows).collect()}
    want = brute_cosine(files)
    assert got == want and any(want.values())


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as c

    texts = random_docs(11)
    source = docs(spark, [*texts, "you idiot moron, pathetic loser, worthless scum"])
    root = sf
    clash = source.withColumns({"rid": F.lit(1), "spans": F.lit("x"), "n_removed": F.lit(0), "runs": F.lit(2)})
    kept = c.toxicity(spark, clash, root)
    for _, stage in c.STAGES[:4]:
        assert stage(spark, clash, root).columns == source.columns
    assert kept.columns == source.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(len(texts)))
    kept = tables.stored(kept, "t")
    links = brute_links(texts)
    single = tables.stored(c.near_duplicates(spark, kept, root), "t")
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({x for _, x in links}) and single.columns == source.columns
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    cut = tables.stored(c.substrings(spark, single, root), "t")
    want = dict(zip(left, brute_repeats(list(left.values()))))
    for r in cut.collect():
        assert hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() == want[r["doc_id"]][2]
    clean = tables.stored(c.decontamination(spark, cut, root), "t")
    assert clean.count() == cut.count() and clean.schema == cut.schema
    assert c.packing(spark, clean, root).select("doc_id").distinct().count() == clean.count()


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_on_an_empty_table(spark, sf, stage):
    import corpus_pipeline as c

    assert c.STAGES[stage][1](spark, docs(spark, ["x"]).limit(0), sf).count() == 0


def test_registered_queries():
    from kinetrove.llm.queries import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
