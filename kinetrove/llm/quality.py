"""Importance resampling by hashed n-gram models, sampled by Gumbel top-k.

Words, sign runs and their bigrams are hashed into ``BUCKETS``. The target model counts
labelled good documents (at most ``MAX_ROWS`` of them), the raw model all documents. A
document's log weight is the sum of log(target / raw) over all its n-grams: the importance ratio. Adding Gumbel
noise and keeping the k largest draws k documents without replacement with
probabilities in proportion to the weights. k is a share of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, Words, as_bytes, chunks, grams, mix, slices
from .tables import stored, sum_vectors, with_row_id

BUCKETS = 1 << 15
MAX_ROWS = 20_000
KIND = np.array([1 if chr(b).isalpha() or b >= 128 else 2 if chr(b).isdigit() else 0 if b in (9, 10, 11, 12, 13, 32) else 3 for b in range(256)], np.uint8)


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the text of each."""
    w = Words(texts)
    kind = KIND[w.buf]
    cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    start, end = np.sort(np.concatenate([w.start, cut])), np.sort(np.concatenate([w.end, cut]))
    h = w.spans(start, end)
    doc = np.searchsorted(w.doc_end, start)
    pairs = grams(h, 2)
    same = doc[1:] == doc[:-1] if len(doc) > 1 else np.zeros(0, bool)
    pairs = pairs[same] if len(pairs) else pairs
    return (np.concatenate([mix(h), pairs]) & U(BUCKETS - 1)).astype(np.int64), np.concatenate([doc, doc[1:][same]]) if len(doc) else doc


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """log(target / raw) of each bucket, and the share of good labels. Without good labels all ratios are 0."""
    sample = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows).collect()
    good = np.sort(np.array([r["doc_id"] for r in sample if r["quality"] == 1], np.int64))
    share = len(good) / len(sample) if sample else 1.0
    if not len(good):
        return np.zeros(BUCKETS), share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches):
            texts = as_bytes(batch.column(1))
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            target = (good[np.minimum(np.searchsorted(good, ids), len(good) - 1)] == ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for a, b in chunks(texts):
                bucket, doc = _buckets(texts[a:b])
                counts[0] += np.bincount(bucket, minlength=BUCKETS)
                counts[1] += np.bincount(bucket[target[a:b][doc]], minlength=BUCKETS)
        import zlib

        salt = zlib.crc32(counts.tobytes()) % 64
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array([salt, salt], pa.int64()), pa.array([x.astype("<i8").tobytes() for x in counts], pa.binary())], ["block", "salt", "vector"])

    tables = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, salt long, vector binary")
    raw, target = sum_vectors(tables, 2, BUCKETS).astype(float)
    rate = 0.5
    return np.log((target + rate * (raw + 1) / (raw.sum() + BUCKETS) * BUCKETS) / (target.sum() + rate * BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)), share


def weigh(rows: DataFrame, ratio: np.ndarray, seed: int, span: float | None = None) -> DataFrame:
    """(rid, doc_id, n_grams, log_weight, gumbel_key). The noise depends on the row id and the seed alone.

    ``span`` tempers weights to at most so many n-grams' worth, for corpora whose long texts should not be surer than short ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch.column(2))
            total, count = np.zeros(len(texts)), np.zeros(len(texts))
            for a, b in chunks(texts):
                bucket, doc = _buckets(texts[a:b])
                total[a:b] = np.bincount(doc, ratio[bucket], b - a)
                count[a:b] = np.bincount(doc, minlength=b - a)
            weight = total if span is None else total * np.minimum(1.0, span / np.maximum(count, 1))
            rid = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            uniform = ((mix(rid * U(0x9E3779B97F4A7C15) + U(seed)) >> U(11)).astype(float) + 0.5) / 2.0**53
            key = weight - np.log(-np.log(uniform))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count.astype(np.int64)), pa.array(weight), pa.array(key)], ["rid", "doc_id", "n_grams", "log_weight", "gumbel_key"])

    return rows.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "rid long, doc_id long, n_grams long, log_weight double, gumbel_key double")


def largest(df: DataFrame, key: str, tie: str, k: int, bins: int = 4096, few: int = 20_000) -> DataFrame:
    """Exactly the k rows of largest ``key`` (ties: smaller ``tie``), without a global sort.

    Histograms of a fixed number of bins narrow the range that holds the k-th row until few rows share it.
    """
    if k <= 0:
        return df.limit(0)
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df
    above = 0
    while True:
        inside = df.where((F.col(key) >= low) & (F.col(key) <= high))
        step = (high - low) / bins
        if step <= 0 or low + step == low:
            break
        slot = F.least(F.floor((F.col(key) - low) / step), F.lit(bins - 1))
        found = sorted(inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect(), key=lambda r: -r["slot"])
        for r in found:
            if above + r["n"] >= k:
                break
            above += r["n"]
        else:
            return df
        if (r["lo"], r["hi"]) == (low, high) or r["n"] <= few:
            low, high = r["lo"], r["hi"]
            break
        low, high = r["lo"], r["hi"]
    edge = df.where((F.col(key) >= low) & (F.col(key) <= high)).orderBy(F.desc(key), tie).limit(k - above)
    return df.where(F.col(key) > high).unionByName(edge)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1, max_rows: int = MAX_ROWS, span: float | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key of the documents drawn: round(share * rows) of them.

    ``share`` None: the share of good documents among the labelled ones. Null and empty texts have no
    n-grams and weight 0. Repeated rows are drawn one by one. An empty table gives no rows.
    """
    ratio, good = fit(docs, labels, max_rows)
    rows = with_row_id(docs, ["doc_id", "text"])
    scored = stored(weigh(rows, ratio, seed, span), "weights")
    k = round((good if share is None else share) * scored.count())
    return largest(scored, "gumbel_key", "rid", k).select("doc_id", "n_grams", "log_weight", "gumbel_key")
