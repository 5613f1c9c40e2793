"""Exact Jaccard join on word n-grams: size-banded tiles, bitmap bounds, sorted-array intersection.

1. Every text becomes its set of n-gram hashes; equal sets are one class (``sid``)
   and only classes go on. Each class has a hashed bitmap of parities.
2. Any two sets with Jaccard of at least t share a gram among the first
   n - ceil(t n) + 1 of either, in any order common to all sets. The order is by
   how common a gram's slot is in the whole corpus, then by hash, so grams that
   many texts share come last. Slots are a table of fixed size (``SLOTS``).
3. Classes that share such a gram meet first as stars: each with the least and the
   greatest class of the gram. Verified stars already join most copies.
4. Grams that still hold different components are cut into tiles of bounded size:
   classes of one gram, in bands of set size, in blocks of ``TILE``. Inside a tile the bit count of two
   bitmaps' difference bounds the overlap from above; pairs below the bound,
   of unequal band or of one component are dropped. What the others tie together is a group.
5. Each different group is met once: its sets are intersected exactly, and only links that join two
   components leave the task, fewer than the group has classes.

Links inside one component that the star has found need no check: the result is the
components, and those are exact. Texts without words link with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import U, Words, as_bytes, chunks, grams, mix, release, slices
from .tables import discard, loose, stored, sum_vectors, with_row_id

SLOTS = 1 << 18
LEAST_BITS, MOST_BITS = 512, 1 << 13
TILE, TILE_GRAMS = 2048, 1 << 21
SHARE = 256
SEEN = 1 << 20


def gram_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text; the whole sequence is one gram if it has fewer words."""
    w = Words(texts, lower=True)
    h = w.hashes()
    counts = np.diff(w.bounds)
    g = grams(h, k)
    out = []
    for i, n in enumerate(counts.tolist()):
        first = w.bounds[i]
        if n >= k:
            out.append(np.unique(g[first : first + n - k + 1]))
        elif n:
            out.append(grams(h[first : first + n], n))
        else:
            out.append(np.zeros(0, U))
    return out


def _sid(s: np.ndarray) -> int:
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        total = mix(np.array([np.add.reduce(mix(s ^ U(0xA5A5A5A5A5A5A5A5)))], U) + U(len(s)))
    return int(total.view(np.int64)[0])


def _bitmap(s: np.ndarray) -> bytes:
    """Parities of the hashed grams. A width w tells unrelated sets of up to about 2 w grams apart; larger ones go to the exact check."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (len(s) * 3 // 4).bit_length()))
    bits = np.bincount((mix(s) & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of a larger width as those of ``words`` words: halves add up as parities."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _long(x) -> pa.Array:
    x = np.asarray(x)
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _least_overlap(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection for 100 * i >= percent * (n1 + n2 - i)."""
    return -(-(percent * (n1 + n2)) // (100 + percent))


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """Rows of texts (kind 0: rid, n, sid, bitmap) and, at the end of each task, its slot counts (kind 1: n is the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, np.int64)
        seen: set[int] = set()
        names = ["kind", "rid", "n", "sid", "bits"]
        for batch in slices(batches):
            texts, rid = as_bytes(batch.column(1)), batch.column(0)
            for a, b in chunks(texts):
                sets = gram_sets(texts[a:b], k)
                sids = [_sid(s) for s in sets]
                for sid, s in zip(sids, sets):
                    if sid not in seen:  # a task counts equal sets once
                        if len(seen) < SEEN:
                            seen.add(sid)
                        slots += np.bincount((s >> U(46)).astype(np.int64), minlength=SLOTS) if len(s) > SLOTS else 0
                        if len(s) <= SLOTS:
                            np.add.at(slots, (s >> U(46)).astype(np.int64), 1)
                cols = [pa.array(np.zeros(b - a, np.int64)), rid.slice(a, b - a), _long([len(s) for s in sets]), pa.array(sids, pa.int64()), pa.array([_bitmap(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)
        parts = slots.reshape(16, -1)
        cols = [_long(np.ones(16)), pa.nulls(16, pa.int64()), _long(np.arange(16)), pa.array(np.random.randint(0, 64, 16)), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("rid", "text").mapInArrow(run, "kind long, rid long, n long, sid long, bits binary")


def _levels(counts: DataFrame) -> bytes:
    """One byte a slot: 0 for slots like most, else the magnitude of what they hold beyond the median."""
    total = sum_vectors(counts, 16, SLOTS // 16).ravel()
    middle = float(np.median(total))
    excess = total - middle - 6 * math.sqrt(middle + 1) - 8
    return np.where(excess > 0, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8).tobytes()


def _prefixes(docs: DataFrame, k: int, percent: int, levels: bytes) -> DataFrame:
    """(gram, sid, n, index): the grams by which a class can meet others; index 1: those by which it can meet larger ones.

    Of two sets that link, the smaller one's first n - ceil(2t n / (1 + t)) + 1 grams meet the larger one's prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels, np.uint8)
        seen: set[int] = set()
        for batch in slices(batches):
            texts = as_bytes(batch.column(0))
            for a, b in chunks(texts):
                keys, sids, sizes, index = [], [], [], []
                for s in gram_sets(texts[a:b], k):
                    n = len(s)
                    if not n or (sid := _sid(s)) in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(sid)
                    take = n - -(-percent * n // 100) + 1
                    rank = (level[(s >> U(46)).astype(np.int64)].astype(U) << U(56)) | (mix(s) >> U(8))
                    order = np.argpartition(rank, take - 1)[:take]
                    few = n - -(-2 * percent * n // (100 + percent)) + 1
                    first = np.argpartition(rank[order], few - 1)
                    keys.append(s[order[first]])
                    index.append(np.arange(take) < few)
                    sids.append(sid)
                    sizes.append(n)
                if keys:
                    count = [len(x) for x in keys]
                    cols = [_long(np.concatenate(keys)), pa.array(np.repeat(np.array(sids, np.int64), count)), pa.array(np.repeat(np.array(sizes, np.int64), count)), pa.array(np.concatenate(index).astype(np.int8))]
                    yield pa.RecordBatch.from_arrays(cols, ["gram", "sid", "n", "index"])

    return docs.select("text").mapInArrow(run, "gram long, sid long, n long, index byte")


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, xa, xb) whose sizes and bitmaps allow the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (np.asarray(batch.column(i)) for i in range(4))
            apart = np.zeros(len(a), np.int64)
            for i, (p, q) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                words = min(len(p), len(q)) // 8
                p, q = (_folded(np.frombuffer(x, U)[None, :], words) for x in (p, q))
                apart[i] = np.bitwise_count(p ^ q).sum()
            keep = (na + nb - apart) // 2 >= _least_overlap(na, nb, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    near = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return near.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that truly link. A hub's pairs go in shares of about ``SHARE``."""
    share = pairs.groupBy("a").agg((F.floor((F.count(F.lit(1)) - 1) / SHARE) + 1).alias("shares"))
    dealt = pairs.join(loose(share, "a"), "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")))
    hubs = share.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    wanted = dealt.select("a", "share", "b").unionByName(hubs.select("a", "share", F.col("a").alias("b")))
    need = wanted.select(F.col("b").alias("sid")).distinct().join(reps.select("sid", "rid"), "sid")
    texts = docs.join(need, "rid").select(F.col("sid").alias("b"), "text")
    tiles = wanted.join(texts, "b").repartition("a", "share").sortWithinPartitions("a", "share", F.col("a") != F.col("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, np.zeros(0, U)
        for batch in slices(batches):
            a, share, b = (batch.column(i).to_pylist() for i in range(3))
            out = []
            texts = as_bytes(batch.column(3))
            for lo, hi in chunks(texts):
                for i, s in zip(range(lo, hi), gram_sets(texts[lo:hi], k)):
                    if a[i] == b[i]:
                        at, hub = (a[i], share[i]), s
                        continue
                    assert at == (a[i], share[i])
                    place = np.minimum(np.searchsorted(hub, s), len(hub) - 1)
                    both = int((hub[place] == s).sum())
                    if 100 * both >= percent * (len(hub) + len(s) - both):
                        out.append((a[i], b[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return tiles.select("a", "share", "b", "text").mapInArrow(run, "a long, b long")


def _merge(label: np.ndarray, members: np.ndarray) -> None:
    """Gives the least label of ``members`` to all that share a label with one of them."""
    found = np.unique(label[members])
    if len(found) > 1:
        label[np.isin(label, found)] = found[0]


def _stack(bitmaps: list[bytes], width: int) -> np.ndarray:
    return np.concatenate([_folded(np.frombuffer(b, U)[None, :], width) for b in bitmaps])


def _allowed(p: int, q: slice, x: np.ndarray, first: int, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bitmaps allow row p, of the rows from ``first`` on in x, to link with each row of q."""
    apart = np.bitwise_count(x[q.start - first : q.stop - first] ^ x[p - first]).sum(1, dtype=np.int64)
    return (n[q] + n[p] - apart) // 2 >= _least_overlap(n[q], n[p], percent)


def _by_width(n: np.ndarray, bitmaps: list[bytes], percent: int) -> Iterator[tuple[int, int, slice, np.ndarray]]:
    """(row, first row of x, larger rows of its size band, folded bitmaps x) for rows sorted by n."""
    words = np.array([len(b) // 8 for b in bitmaps])
    top = np.searchsorted(n, n * 100 // percent, "right")  # the band of sizes that can link, upwards
    for width in np.unique(words).tolist():
        first, own = int(np.searchsorted(words, width)), int(np.searchsorted(words, width, "right"))
        x = _stack(bitmaps[first : int(top[first:own].max())], width)
        for p in range(first, own):
            if top[p] > p + 1:
                yield p, first, slice(p + 1, int(top[p])), x


def _tiles(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows whose first ``keys`` columns are equal."""
    tile: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if tile and row[:keys] != tile[0][:keys]:
                yield tile
                tile = []
            tile.append(row)
    if tile:
        yield tile
    release()


def _groups(rows: DataFrame, percent: int) -> DataFrame:
    """(group_id, sid, component) from tiles of (gram, sid, n, component, bits): classes that bitmaps let meet, in groups.

    A group holds what candidate pairs of one tile tie together, so a tile gives a row for each of its classes
    at most, however many pairs it has. Groups with the same classes have the same id and are one afterwards.
    A tile holds about ``TILE`` classes and ``TILE_GRAMS`` grams of two blocks.
    """
    blocks = F.greatest((F.count(F.lit(1)) - 1) / TILE, F.sum("n") / TILE_GRAMS)
    size = rows.groupBy("gram").agg((F.floor(blocks) + 1).alias("blocks"))
    dealt = rows.join(loose(size, "gram"), "gram").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("gram", "sid", "n", "index", "component", "bits", "block", other)
    dealt = dealt.select("gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n", "sid", "component", "bits", "block", "index")
    dealt = dealt.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "n")

    def found(tile: list[tuple]) -> Iterator[tuple[int, int, int]]:
        if len(tile) < 2:
            return
        _, i, j, n, sid, comp, bits, block, index = zip(*tile)
        n, sid, comp, block = (np.array(c, np.int64) for c in (n, sid, comp, block))
        label, met = np.arange(len(n)), np.zeros(len(n), bool)
        for p, first, q, x in _by_width(n, list(bits), percent):
            if not index[p]:  # the smaller one must meet by a gram of its index
                continue
            keep = (comp[q] != comp[p]) & (sid[q] != sid[p])
            if i[0] != j[0]:
                keep &= block[q] != block[p]
            if keep.any():
                keep &= _allowed(p, q, x, first, n, percent)
                at = np.append(np.flatnonzero(keep) + q.start, p)
                if len(at) > 1:
                    met[at] = True
                    _merge(label, at)
        for one in np.unique(label[met]).tolist():
            at = np.flatnonzero((label == one) & met)
            ids = np.unique(sid[at], return_index=True)
            for s, k in zip(ids[0].tolist(), at[ids[1]].tolist()):
                yield _sid(ids[0].view(U)), s, int(comp[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        seen: set[int] = set()
        for tile in _tiles(batches, 3):
            rows = list(found(tile))
            out += [r for r in rows if r[0] not in seen]  # a group that this task has given already is one
            seen |= {r[0] for r in rows} if len(seen) < SEEN else set()
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["group_id", "sid", "component"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["group_id", "sid", "component"])

    return dealt.mapInArrow(run, "group_id long, sid long, component long").distinct()


def _forest(groups: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links that join classes of different components, a spanning forest of each group's.

    A group's sets are intersected exactly as sorted arrays; pairs that the links found so far, or the components
    before, already join are not tried. So a group gives fewer links than it has classes.
    """
    need = groups.select("sid").distinct().join(reps.select("sid", "rid", "n"), "sid")
    texts = docs.join(need, "rid").select("sid", "n", F.col("text").cast("binary").alias("text"))
    rows = groups.join(texts, "sid").select("group_id", "n", "sid", "component", "text")
    rows = rows.repartition("group_id").sortWithinPartitions("group_id", "n", "sid")

    def links(tile: list[tuple]) -> Iterator[tuple[int, int]]:
        _, n, sid, comp, text = zip(*tile)
        n, sid = np.array(n, np.int64), np.array(sid, np.int64)
        sets: list[np.ndarray] = []
        for lo, hi in chunks(list(text)):
            sets += gram_sets(list(text[lo:hi]), k)
        label = np.unique(np.array(comp, np.int64), return_inverse=True)[1]
        for p, first, q, x in _by_width(n, [_bitmap(s) for s in sets], percent):
            keep = label[q] != label[p]
            if not keep.any():
                continue
            keep &= _allowed(p, q, x, first, n, percent)
            for b in (np.flatnonzero(keep) + q.start).tolist():
                if label[b] == label[p]:
                    continue
                mine, other = sets[p], sets[b]
                place = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                both = int((other[place] == mine).sum())
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    _merge(label, np.array([p, b]))
                    yield min(int(sid[p]), int(sid[b])), max(int(sid[p]), int(sid[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches, 1):
            if out := list(links(tile)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(rid, doc_id, n_shingles, component_rid) for every row of ``docs`` (rid, doc_id, text).

    component_rid is the least rid reachable by links; a text without words is alone.
    """
    spark = docs.sparkSession
    passed = stored(_classes(docs, k), "classes")
    rows = passed.where("kind = 0")
    levels = _levels(passed.where("kind = 1").select(F.col("n").alias("block"), F.col("sid").alias("salt"), F.col("bits").alias("vector")))
    spread = spark.sparkContext.broadcast(levels)  # SLOTS bytes, whatever the corpus
    reps = rows.where("n > 0").groupBy("sid").agg(F.min("rid").alias("rid"), F.min("n").alias("n"), F.first("bits").alias("bits"))
    reps = stored(reps, "reps")
    prefix = _prefixes(docs, k, percent, spread.value)
    shared = prefix.groupBy("gram").agg(F.min("sid").alias("hub"), F.max("sid").alias("last"), F.max("index").alias("index")).where("hub < last and index = 1").select("gram", "hub", "last")
    met = stored(prefix.join(loose(shared, "gram"), "gram"), "met")
    ends = F.array(F.col("hub"), F.col("last"))  # two hubs a gram: what one misses the other often has
    star = met.select(F.explode(ends).alias("hub"), "sid").where("sid != hub").select(F.least("hub", "sid").alias("a"), F.greatest("hub", "sid").alias("b")).distinct()
    facts = reps.select("sid", "n", "bits")
    star = star.join(facts.toDF("a", "na", "xa"), "a").join(facts.toDF("b", "nb", "xb"), "b")
    near = stored(_bounded(star, percent), "star")
    links = stored(_verified(near, docs, reps, k, percent), "links")
    known = components(links)
    rest = met.select("gram", "sid", "n", "index").distinct().join(known.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    kept = rest = stored(rest, "rest")
    discard(near, met, known)
    mixed = rest.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("index").alias("index")).where("lo < hi and index = 1").select("gram")
    rest = rest.join(loose(mixed, "gram"), "gram").join(facts.select("sid", "bits"), "sid")
    groups = stored(_groups(rest, percent), "groups")
    more = stored(_forest(groups, docs, reps, k, percent), "forest")
    whole = components(links.unionByName(more))
    discard(kept, groups, links, more)
    classes = reps.select("sid", "rid").join(whole.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = classes.groupBy("component").agg(F.min("rid").alias("component_rid"))
    classes = classes.join(loose(least, "component"), "component").select("sid", "component_rid")
    out = rows.select("rid", "sid", "n").join(classes, "sid", "left")
    out = out.select("rid", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_rid")).otherwise(F.col("rid")).alias("component_rid"))
    return out


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component) of every row.

    Repeated rows are rows of one class; a null text has no shingles; a null
    doc_id never names a component that holds another id.
    """
    rows = with_row_id(docs, ["doc_id", "text"])
    found = near_components(rows, k, percent).join(rows.select("rid", "doc_id"), "rid")
    names = found.groupBy("component_rid").agg(F.min("doc_id").alias("component_id"))
    return found.join(loose(names, "component_rid"), "component_rid").select("doc_id", "n_shingles", "component_id")
