"""Hard negatives by distributed radix selection over integer scores.

A vector's components become ``floor(256 * x)``, so a score, the inner product of two vectors, is a whole number. Anchors are taken in
blocks of ``BLOCK``, whatever their number; a block is what the driver and each task hold at a time. An anchor's positives are the
first of its label; each (anchor, positive) opens a window of scores, and its negatives are the first of other labels in it.

Both searches are one selection. A window counts the ranks below its top score in ``DIGIT`` bits at a time: tasks make histograms of the current digit
over the rows that share the digits found so far, Spark sums them by (window, digit), and the digit where the k-th row lies joins
the window's prefix. After the last digit the k-th score is exact, and only rows at that score or before it are gathered.
A task sends no counts past its own k-th row of a window, nor more than its own first k rows of it, since the k-th row of all lies at or
before that of any task. So ties, however many, cost k rows a task and window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import discard, scratch, stored

BLOCK, DIGIT = 1024, 8
#: Scores of vectors below this squared norm, and all their partial sums, are longs.
LARGEST = float(1 << 61)
CELLS = 1 << 21
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Anchors(NamedTuple):
    """A block of anchors of one vector length, and the largest norm that they are compared with."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Exact integer inner products (rows by anchors): in doubles where no sum can pass 2**53."""
        a, b = (np.abs(v).max(initial=0) for v in (x, self.x))
        if float(a) * float(b) * max(1, x.shape[1]) < 1 << 53:
            return (x.astype(np.float64) @ self.x.astype(np.float64).T).astype(np.int64)
        return x @ self.x.T


class Windows(NamedTuple):
    """Scores from ``top`` down to ``top - span`` (anchors by windows; a negative span holds nothing), among rows of the anchor's label or of others."""

    top: np.ndarray
    span: np.ndarray
    same: bool


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _parts(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows):
    """(ids, ranks below the top, rows that count) of each window of every anchor, for slices of a batch's rows."""
    for batch in batches:
        step = max(1, CELLS // max(1, len(anchors.ids)))
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            ids, labels = (part.column(c).to_numpy() for c in (0, 1))
            x = _matrix(part.column(2), anchors.x.shape[1])
            score = anchors.scores(x)
            fits = labels[:, None] == anchors.labels[None, :]
            if windows.same:  # not the anchor's own row
                own = np.argwhere(fits & (ids[:, None] == anchors.ids[None, :]))
                for r, a in own.tolist():
                    fits[r, a] = not np.array_equal(x[r], anchors.x[a])
            else:
                fits = ~fits
            for j in range(windows.top.shape[1]):
                depth = windows.top[:, j][None, :] - score
                yield j, ids, depth, fits & (depth >= 0) & (depth <= windows.span[:, j][None, :])


def _histograms(anchors: Anchors, windows: Windows, prefix: np.ndarray, left: np.ndarray, shift: int) -> Callable:
    """Counts of the digit at ``shift`` by (window, digit), up to a task's own k-th row."""
    n, many = windows.top.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * many << DIGIT, np.int64)
        for j, _, depth, fits in _parts(batches, anchors, windows):
            digits = depth >> shift
            row, a = np.nonzero(fits & (digits >> DIGIT == prefix[:, j][None, :]))
            counts += np.bincount(((a * many + j) << DIGIT) + (digits[row, a] & ((1 << DIGIT) - 1)), minlength=len(counts))
        counts = counts.reshape(n * many, -1)
        before = np.cumsum(counts, 1) - counts
        window, digit = np.nonzero((counts > 0) & (before < left.reshape(-1, 1)))
        columns = window, left.ravel()[window], digit, counts[window, digit]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["window", "need", "digit", "n"])

    return run


def _gathered(anchors: Anchors, windows: Windows, last: np.ndarray, k: int) -> Callable:
    """A task's first ``k`` rows of each window at the ranks up to ``last``."""
    many = windows.top.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def prune(parts):
            window, depth, ids = parts
            order = np.lexsort((ids, depth, window))
            window = window[order]
            place = np.arange(len(window)) - np.searchsorted(window, window)
            return [v[order][place < k] for v in parts]

        for j, ids, depth, fits in _parts(batches, anchors, windows):
            row, a = np.nonzero(fits & (depth <= last[:, j][None, :]))
            if len(row):
                held = prune([np.concatenate(v) for v in zip(held, prune([a * many + j, depth[row, a], ids[row]]))])
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in held], ["window", "depth", "id"])

    return run


def select(rows: DataFrame, anchors: Anchors, windows: Windows, k: int) -> DataFrame:
    """window, depth, id, rank: the first ``k`` rows of each window, by rank below its top, then by id; window = anchor * windows + j.

    ``rows``: vec_id, label, x. What reaches the driver is one digit a window and pass.
    """
    bits = int(windows.span.max(initial=0)).bit_length()
    prefix, left = np.zeros(windows.top.shape, np.int64), np.full(windows.top.shape, k, np.int64)
    full = windows.span >= 0  # of fewer than k rows all qualify
    upto = Window.partitionBy("window").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    for shift in range(-(-bits // DIGIT) * DIGIT - DIGIT, -1, -DIGIT):
        run = _histograms(anchors, windows, np.where(full, prefix, -1), left, shift)
        counts = rows.mapInArrow(run, "window long, need long, digit long, n long").groupBy("window", "need", "digit").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("upto", F.sum("n").over(upto))
        found = counts.where("upto >= need and upto - n < need").select("window", "digit", (F.col("upto") - F.col("n")).alias("before")).toArrow()
        window, digit, before = (found.column(c).to_numpy() for c in range(3))
        met = np.zeros(prefix.size, bool)
        met[window] = True
        full &= met.reshape(full.shape)
        prefix <<= DIGIT
        prefix.flat[window] += digit
        left.flat[window] -= before
    last = np.where(full, prefix, windows.span)
    found = rows.mapInArrow(_gathered(anchors, windows, last, k), "window long, depth long, id long")
    rank = F.row_number().over(Window.partitionBy("window").orderBy("depth", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(asked: DataFrame, size: int) -> Iterator[Anchors]:
    """Anchors of one vector length, ``size`` at a time; the driver holds one block."""
    held: list = []

    def made() -> Anchors:
        return Anchors(np.array([r["vec_id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64), np.array([r["x"] for r in held], np.int64).reshape(len(held), -1))

    for row in asked.orderBy(F.size("x"), "vec_id", "label", "x").toLocalIterator():
        if held and (len(held) == size or len(row["x"]) != len(held[0]["x"])):
            yield made()
            held = []
        held.append(row)
    if held:
        yield made()


def usable(vectors: DataFrame, label) -> DataFrame:
    """vec_id, label, x (components as whole numbers) of the rows that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    norm = F.aggregate(F.col("v"), F.lit(0.0), lambda total, c: total + F.floor(256 * c).cast("double") * F.floor(256 * c).cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(sound, v).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(norm < LARGEST)
    return rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(256 * c)).alias("x")).distinct()


def mine(vectors: DataFrame, anchors: F.Column | str, label: F.Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` selects the anchors, ``label`` gives each row's label. An anchor's positives are its first ``positives`` other rows of its label,
    and a pair's negatives the first ``negatives`` rows of other labels with low * p <= 100 * s <= high * p, where p is the
    positive's score and s the row's; all, where there are fewer. Higher scores come first, ties by smaller vec_id.

    Rows without a vec_id, label or vector, or with a null or non-finite component, take no part, nor do vectors whose
    squared norm reaches 2**61, whose scores might not be longs. Rows equal in id, label and components are one;
    others that repeat an id are rows by themselves. Only vectors of equal length have a score. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, label), "usable")
    path = scratch(spark, "mined")
    asked = stored(rows.where(anchors), "anchors")
    largest = {r["d"]: r["n"] for r in rows.groupBy(F.size("x").alias("d")).agg(F.max(F.aggregate("x", F.lit(0).cast("long"), lambda t, c: t + c * c)).alias("n")).collect()}
    spark.createDataFrame([], OUT).write.parquet(path)
    for some in _blocks(asked, block):
        same = rows.where(F.size("x") == some.x.shape[1])
        norms = np.sqrt((some.x.astype(np.float64) ** 2).sum(1) * float(largest[some.x.shape[1]]))
        reach = np.minimum(np.ceil(norms * (1 + 1e-9)) + 1, LARGEST).astype(np.int64)[:, None]
        first = select(same, some, Windows(reach, 2 * reach, True), positives).orderBy("window", "rank").toArrow()  # at most ``positives`` an anchor
        a, depth, pid, rank = (first.column(c).to_numpy() for c in ("window", "depth", "id", "rank"))
        score = np.full((len(some.ids), positives), -1, np.int64)
        partner = np.zeros(score.shape, np.int64)
        score[a, rank - 1], partner[a, rank - 1] = reach[a, 0] - depth, pid
        exact = score.astype(object)  # a multiple of a score may not be a long
        least, most = (-(-low * exact // 100)).astype(np.int64), (high * exact // 100).astype(np.int64)
        windows = Windows(most, np.where(score >= 0, most - least, -1), False)
        found = select(same, some, windows, negatives)
        # a block's windows by number: a literal table of the block's size
        facts = spark.createDataFrame(pa.table({"window": np.arange(score.size), "anchor_id": np.repeat(some.ids, positives), "positive_id": partner.ravel(), "positive_score": score.ravel(), "top": most.ravel()}))
        out = found.join(F.broadcast(facts), "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", (F.col("top") - F.col("depth")).alias("negative_score"))
        out.write.mode("append").parquet(path)
    discard(rows, asked)
    return spark.read.schema(OUT).parquet(path)


def shifted_label(label: str = "label") -> F.Column:
    """The registered query's labels: every seventh row's moves on by one."""
    known = F.col(label).cast("long")
    return F.when(F.col("vec_id") % 7 == 0, (known + 1) % 10).otherwise(known)


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * c::double) for c in embedding] as x
  from embeddings where label is not null and embedding is not null and list_count(embedding) = len(embedding) and coalesce(list_bool_and([isfinite(c) for c in embedding]), true)
), pairs as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positive as (
  select anchor_id, other as positive_id, score as positive_score from (select *, row_number() over (partition by anchor_id order by score desc, other) as r from pairs where same) where r <= 5
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from (
  select p.*, n.other as negative_id, n.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.other) as rank
  from positive p join pairs n on n.anchor_id = p.anchor_id and not n.same and 30 * positive_score <= 100 * n.score and 100 * n.score <= 90 * positive_score
) where rank <= 10
"""
