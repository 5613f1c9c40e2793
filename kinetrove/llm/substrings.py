"""Removal of word sequences that occur more than once: seed and extend.

Seeds are winnowed anchors: of any ``window`` consecutive words, the k-gram with
the least hash (the rightmost of equals). Equal windows choose equal anchors, so
every repeated window shares an anchor with its copy. An anchor occurrence is
extended both ways over the run of windows that chose it (its context). Contexts
of one anchor are compared whole first: a context met twice makes all its windows
repeats. Only where an anchor has contexts that differ are single windows
compared, by their hashes; one occurrence stands for all equal contexts there.
The union of repeated windows is the union of the maximal repeats of at least
``window`` words; its maximal stretches come back as ``repeats``.

No step forms pairs: hot anchors and contexts are counted with map-side partial
sums and met by joins whose large partitions Spark splits.

Rows are told apart by ``with_row_id``, so repeated rows are copies of each other
and null ids are kept. Null and empty texts have no words: nothing is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, Words, as_bytes, chunks, grams, mix, slices
from .tables import loose, stored, with_row_id

SEED_WORDS = 12
REPEATS = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))


def _runs(texts: list[bytes], window: int, k: int):
    """(text, first window, windows, anchor, context) of each anchor's run, and the window hashes by text bounds."""
    w = Words(texts)
    n = len(w)
    span = window - k + 1
    if n < window:
        return None
    h = w.hashes()
    g = grams(h, k)
    # least (hash, rightmost) of each `span` consecutive grams, by doubling
    low = U((1 << 32) - 1) - np.arange(len(g), dtype=U)
    least = (g & ~U((1 << 32) - 1)) | low
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    place = (U((1 << 32) - 1) - (least & U((1 << 32) - 1))).astype(np.int64)
    counts = np.maximum(np.diff(w.bounds) - window + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(doc):
        return None
    first = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(w.bounds[:-1], counts)
    at = place[first]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(doc)))
    return w, h, g, doc[head], first[head], size, at[head]


def _variable_grams(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    from .kernel import _GRAMS

    up, down = _GRAMS.get(len(h) + 1)
    prefix = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=prefix[1:])
    return mix((prefix[start + length] - prefix[start]) * down[start] + length.astype(U) * U(0x9E3779B97F4A7C15))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, context, rid, at, n): windows at .. at+n-1 of the row chose the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, rid = as_bytes(batch.column(1)), np.asarray(batch.column(0).to_pylist(), np.int64)
            for a, b in chunks(texts):
                if found := _runs(texts[a:b], window, SEED_WORDS):
                    w, h, g, doc, first, size, at = found
                    context = _variable_grams(h, first, size + window - 1)
                    cols = [g[at], context, rid[a:b][doc], first - w.bounds[doc], size]
                    yield pa.RecordBatch.from_arrays([_long(c) for c in cols], ["anchor", "context", "rid", "at", "n"])

    return docs.select("rid", "text").mapInArrow(run, "anchor long, context long, rid long, at long, n long")


def _window_hashes(rows: DataFrame, window: int) -> DataFrame:
    """(hash, rid, at, weight) of the single windows that ``runs`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, rid, runs = as_bytes(batch.column(1)), batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in chunks(texts):
                w = Words(texts[a:b])
                g = grams(w.hashes(), window)
                out: list[tuple] = []
                for i in range(a, b):
                    for r in runs[i]:
                        first = w.bounds[i - a] + r["at"]
                        out.append((rid[i], r["at"], r["weight"], g[first : first + r["n"]]))
                if out:
                    size = np.array([len(x[3]) for x in out])
                    at = np.concatenate([x[1] + np.arange(len(x[3])) for x in out])
                    cols = [np.concatenate([x[3] for x in out]), np.repeat([x[0] for x in out], size), at, np.repeat([x[2] for x in out], size)]
                    yield pa.RecordBatch.from_arrays([_long(np.asarray(c)) for c in cols], ["hash", "rid", "at", "weight"])

    # all columns go in, so that this join and the last one share one exchange of the texts
    rest = [c for c in rows.columns if c not in ("rid", "text", "runs")]
    return rows.select("rid", "text", "runs", *rest).mapInArrow(run, "hash long, rid long, at long, weight long")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(rid, at, n): n windows of the row from word ``at`` on occur elsewhere too. ``docs`` has rid and text, and may have more.

    Anchors met once are dropped by a count of the anchors alone, before contexts are carried anywhere.
    """
    found = anchors(docs, window)
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    met = stored(found.join(loose(again, "anchor"), "anchor"), "met")
    contexts = met.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("k"), F.min("rid").alias("rid"), F.min_by("at", "rid").alias("at"), F.min("n").alias("n"))
    contexts = stored(contexts, "contexts")
    kinds = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    whole = met.join(contexts.where("k > 1").select("anchor", "context"), ["anchor", "context"]).select("rid", "at", "n")
    runs = contexts.join(loose(kinds.select("anchor"), "anchor"), "anchor").select("rid", "at", "n", F.least("k", F.lit(2)).alias("weight"))
    runs = runs.groupBy("rid").agg(F.collect_list(F.struct("at", "n", "weight")).alias("runs"))
    hashes = _window_hashes(docs.join(runs, "rid"), window)
    twice = hashes.groupBy("hash").agg(F.sum("weight").alias("k")).where("k > 1").select("hash")
    parts = hashes.where("weight = 1").join(loose(twice, "hash"), "hash").select("rid", "at", F.lit(1).cast("long").alias("n"))
    return whole.unionByName(parts)


def remove_repeats(docs: DataFrame, window: int = 35, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and text with all repeated windows' words removed, n_words, n_removed, kept_sha256, repeats.

    Kept words are joined by one space; a text that loses nothing keeps its bytes in ``text``. ``repeats`` are the
    maximal stretches of the row that repeats of at least ``window`` words cover: first word and number of words.
    """
    keep = keep or ["doc_id"]
    rows = with_row_id(docs, [*dict.fromkeys([*keep, "doc_id", "text"])])
    extra = [c for c in keep if c != "text"]
    rows = rows.select("rid", "text", *extra)
    spans = repeated_windows(rows, window)
    spans = spans.groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    joined = rows.join(spans, "rid", "left")
    kinds = dict(joined.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in extra), "text string", "n_words long", "n_removed long", "kept_sha256 string", "repeats array<struct<start:bigint,n_words:bigint>>"])
    kept_type = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, column = as_bytes(batch.column(0)), batch.column(1).to_pylist()
            null = [x is None for x in batch.column(0).to_pylist()]
            out, total, gone, sha, repeats = [], [], [], [], []
            for i, (raw, found) in enumerate(zip(texts, column)):
                words = raw.split()
                total.append(len(words))
                lost, edges = 0, np.zeros((0, 2), np.int64)
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["at"] for s in found], 1)
                    np.add.at(edge, [s["at"] + s["n"] + window - 1 for s in found], -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    lost = int(covered.sum())
                    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    words = [x for x, c in zip(words, covered.tolist()) if not c]
                kept = b" ".join(words)
                gone.append(lost)
                repeats.append([{"start": a, "n_words": b - a} for a, b in edges.tolist()])
                sha.append(hashlib.sha256(kept).hexdigest())
                out.append(None if null[i] else (kept if lost else raw).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, kept_type), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(repeats, REPEATS)], [*extra, "text", "n_words", "n_removed", "kept_sha256", "repeats"])

    return joined.select("text", "spans", *extra).mapInArrow(run, schema)
