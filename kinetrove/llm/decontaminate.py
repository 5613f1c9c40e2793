"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of W words may differ by e word edits. It is cut into e + 1 pieces;
an occurrence within e edits leaves one piece whole. Each piece is looked up by one of its runs of ``PROBE`` words (all its words, if fewer), the one
that the fewest items of the benchmark share; where it occurs, the surroundings are verified with Myers'
bit-parallel edit distance (one bit a word, any item length), the item against
the best place of the text. Words are compared in lower case without signs.

Neither side is gathered anywhere. Items with the same words are one. The executors get a
bit filter of the probes, of ``MOST_BITS`` bits at most, however large the benchmark. A first reading of the documents gives the places
where the filter lets a probe through; probes and places meet by an equi-join on the probe, whose hot keys Spark splits,
and give an item's possible places, those within the item's budget of each other as one. A second reading, of documents with
such places, cuts the words there, and each place is verified by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, Words, chunks, gram_owner, grams, slices
from .tables import BitFilter, discard, loose, stored, with_row_id

PROBE = 4
#: Signs become spaces, so that words are letters and digits.
SIGNS = bytes(b if chr(b).isalnum() or b >= 128 or b in (9, 10, 11, 12, 13) else 32 for b in range(256))
#: Bits of the filter of probes: about this many a probe, from the least to the most.
BITS_A_PROBE, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
CACHED = 2_000


def plain(text: str | None) -> bytes:
    return b"" if text is None else text.lower().encode("utf-8", "replace").translate(SIGNS)


def budget(words: int, percent: int) -> int:
    """Edits allowed: a share of the words, but a piece keeps a word at least."""
    return max(0, min(words * percent // 100, words - 1))


def distance(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of the whole pattern to any stretch of ``text``, and that stretch's end."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    for at, c in enumerate(text, 1):
        x = masks.get(c, 0) | down
        zero = (((x & up) + up) ^ up) | x
        plus = down | ~(zero | up)
        minus = up & zero
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus <<= 1
        down = plus & zero & full
        up = ((minus << 1) | ~(zero | plus)) & full
        if score < best[0]:
            best = (score, at)
    return best



def _batch(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


def _items(benchmark: DataFrame, percent: int) -> DataFrame:
    """(item_id, item, n, e, words): an item's words as hashes, ``item`` a hash of them. Items without words are left out."""
    kinds = {"item_id": pa.int64(), "item": pa.int64(), "n": pa.int64(), "e": pa.int64(), "words": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = Words([plain(text)]).hashes()
                if n := len(h):
                    rows.append((item_id, int(grams(h, n).view(np.int64)[0]), n, budget(n, percent), h.tobytes()))
            if rows:
                yield _batch(kinds, rows)

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, item long, n long, e long, words binary")


def _probes(items: DataFrame) -> DataFrame:
    """(probe, size, item, n, e, at): the run of words at word ``at`` of the item by which a piece is looked up."""
    kinds = dict.fromkeys(("probe", "size", "item", "n", "e", "piece", "at"), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, e, words in zip(*(c.to_pylist() for c in batch.columns)):
                rows, keys = [], {}
                for p in range(e + 1):
                    first, end = p * n // (e + 1), (p + 1) * n // (e + 1)
                    size = min(PROBE, end - first)
                    if size not in keys:
                        keys[size] = grams(np.frombuffer(words, U), size).view(np.int64).tolist()
                    rows += [(keys[size][at], size, item, n, e, p, at) for at in range(first, end - size + 1)]
                yield _batch(kinds, rows)

    runs = items.mapInArrow(run, "probe long, size long, item long, n long, e long, piece long, at long")
    common = runs.groupBy("probe").agg(F.count(F.lit(1)).alias("common"))
    rare = runs.join(loose(common, "probe"), "probe").groupBy("item", "n", "e", "piece").agg(F.min(F.struct("common", "probe", "at", "size")).alias("best"))
    return rare.select("best.probe", "best.size", "item", "n", "e", "best.at")


def _hits(rows: DataFrame, sizes: list[int], probes: BitFilter) -> DataFrame:
    """(rid, probe, place): words from which on the filter lets a probe of one of the sizes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = probes.holds()
        for batch in slices(batches):
            texts = [plain(t) for t in batch.column(1).to_pylist()]
            rid = np.array(batch.column(0).to_pylist(), np.int64)
            for a, b in chunks(texts):
                w = Words(texts[a:b])
                h = w.hashes()
                for size in sizes:
                    g = grams(h, size)
                    first, doc = gram_owner(w.bounds, len(g), size)
                    found = np.flatnonzero(holds(g[first])) if len(first) else first
                    if len(found):
                        cols = [rid[a:b][doc[found]], g[first[found]].view(np.int64), first[found] - w.bounds[doc[found]]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rid", "probe", "place"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, probe long, place long")


def _around(rows: DataFrame) -> DataFrame:
    """(rid, item, first, around): of rows (rid, text, item, n, e, near), the words where items may lie, from word ``first`` on."""
    kinds = {"rid": pa.int64(), "item": pa.int64(), "first": pa.int64(), "around": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, np.zeros(0, U)
        for batch in batches:
            out, size = [], 0
            for rid, text, item, n, e, near in zip(*(c.to_pylist() for c in batch.columns)):
                if rid != last:  # the rows of a text come one after the other
                    last, h = rid, Words([plain(text)]).hashes()
                first = max(0, near * (e + 1) - e)
                out.append((rid, item, first, h[first : near * (e + 1) + n + 2 * e].tobytes()))
                size += len(out[-1][3])
                if size > 1 << 24:
                    yield _batch(kinds, out)
                    out, size = [], 0
            if out:
                yield _batch(kinds, out)

    return rows.select("rid", "text", "item", "n", "e", "near").mapInArrow(run, "rid long, item long, first long, around binary")


def _verified(met: DataFrame) -> DataFrame:
    """(rid, item, distance, start) of the places (rid, item, n, e, words, first, around) within the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, dict[int, int]] = {}
        for batch in batches:
            rows = []
            for rid, item, n, e, words, first, around in zip(*(c.to_pylist() for c in batch.columns)):
                text, own = np.frombuffer(around, U), np.frombuffer(words, U)
                if len(whole := [at for at in np.flatnonzero(text[: max(0, len(text) - n + 1)] == own[0]).tolist() if np.array_equal(text[at : at + n], own)]):
                    rows.append((rid, item, 0, first + whole[0]))
                    continue
                if item not in masks:
                    if len(masks) >= CACHED:
                        masks.clear()
                    masks[item] = {}
                    for i, c in enumerate(own.tolist()):
                        masks[item][c] = masks[item].get(c, 0) | 1 << i
                score, end = distance(masks[item], n, text.tolist())
                if score <= e:
                    rows.append((rid, item, score, max(first + end - n, 0)))
            if rows:
                yield _batch(dict.fromkeys(("rid", "item", "distance", "start"), pa.int64()), rows)

    return met.select("rid", "item", "n", "e", "words", "first", "around").mapInArrow(run, "rid long, item long, distance long, start long")


def _found(rows: DataFrame, benchmark: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rid, item, distance, start) of the best place of each item in each row, and the items (item_id, item, n, e, words)."""
    items = stored(_items(benchmark, percent), "items")
    each = items.groupBy("item").agg(F.first("n").alias("n"), F.first("e").alias("e"), F.first("words").alias("words"))
    probes = stored(_probes(each), "probes")
    sizes = sorted(r["size"] for r in probes.select("size").distinct().collect())  # up to ``PROBE`` of them
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_PROBE * probes.count() - 1).bit_length()))
    hits = _hits(rows, sizes, BitFilter(probes, "probe", bits))
    near = F.floor((F.col("place") - F.col("at")) / (F.col("e") + 1)).cast("long")  # places within the budget of each other are one
    places = stored(hits.join(probes, "probe").select("rid", "item", "n", "e", near.alias("near")).distinct(), "places")
    met = _around(rows.select("rid", "text").join(places, "rid")).join(loose(each, "item"), "item")  # an item may be found in very many documents
    best = _verified(met).groupBy("rid", "item").agg(F.min(F.struct("distance", "start")).alias("best"))
    best = stored(best.select("rid", "item", "best.distance", "best.start"), "leaks")
    discard(probes, places)
    return best, items


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 15, key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, distance, error_budget, start_word): each item found in each document.

    Null and empty texts, on either side, match nothing; repeated documents or items give
    a row each. A null id of a document or item stays null. Of places with the same distance the first counts. Other
    columns are not read. With no items, or no documents, the result is empty.
    """
    rows = with_row_id(docs, [*dict.fromkeys([key, "text"])], key)
    found, items = _found(rows, benchmark, percent)
    out = found.join(items.select("item_id", "item", "e"), "item").join(rows.select("rid", key), "rid")
    return out.select(key, "item_id", "distance", F.col("e").alias("error_budget"), F.col("start").alias("start_word"))


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 15) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, all columns kept.

    Null and empty texts hold none, rows that repeat an id or have none are judged by themselves, and without items all rows stay.
    """
    names = docs.columns
    rows = with_row_id(docs.toDF(*(f"c{i}" for i in range(len(names)))), [f"c{i}" for i in range(len(names))], f"c{names.index('doc_id')}")
    found, _ = _found(rows.withColumn("text", F.col(f"c{names.index('text')}")), benchmark, percent)
    return rows.join(found.select("rid").distinct(), "rid", "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
