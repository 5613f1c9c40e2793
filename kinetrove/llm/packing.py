"""Packing of token sequences into fixed windows by Karmarkar-Karp multiway differencing.

A partial partition holds m window loads. Two partial partitions are merged by
adding the largest loads of one to the smallest of the other, always taking the
two with the widest spread, until one is left: near-equal windows. m begins with the
least count whose capacity holds the total and rises, by the windows that the excess
would fill, whenever a window exceeds its capacity.

Documents are cut into pieces of at most ``piece`` ids first, since near-equal windows of few
large pieces would leave a share of each window empty. Whole windows of a long document are windows by
themselves. ``cut`` is another way to the same end, not used by the query: m stays, and what a window
holds beyond its capacity is cut off and fills windows with room.

Each task packs its own documents in groups of about ``group`` pieces, so no
shuffle is needed, memory is bounded and a lost task is simply run again. The
price is at most one partly filled window a group.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .kernel import as_bytes, slices
from .tokencache import cache

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Indices of ``sizes`` in m windows of near-equal load."""
    left: list[int] = [-1] * len(sizes)
    right: list[int] = [-1] * len(sizes)
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, la, na = heapq.heappop(heap)
        _, _, lb, nb = heapq.heappop(heap)
        over = len(la) + len(lb) - m
        if over <= 0:
            loads, nodes = np.concatenate([la, lb]), np.concatenate([na, nb])
        else:  # the smallest of a meet the smallest of b that have no empty partner, in opposite order
            x, y = la[len(la) - over :], lb[len(lb) - over :][::-1]
            p, q = na[len(na) - over :], nb[len(nb) - over :][::-1]
            joined = np.arange(len(left), len(left) + over)
            left += p.tolist()
            right += q.tolist()
            loads = np.concatenate([la[: len(la) - over], lb[: len(lb) - over], x + y])
            nodes = np.concatenate([na[: len(na) - over], nb[: len(nb) - over], joined])
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        heapq.heappush(heap, (int(loads[-1] if len(loads) == m else 0) - int(loads[0]), turn, loads, nodes))
        turn += 1
    windows: list[list[int]] = []
    for node in heap[0][3].tolist() if heap else []:
        members, todo = [], [node]
        while todo:
            k = todo.pop()
            if k < len(sizes):
                members.append(k)
            else:
                todo += (left[k], right[k])
        windows.append(members)
    return windows + [[] for _ in range(m - len(windows))]


def pack(sizes: list[int], capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, first, length). Sizes lie from 1 to ``capacity``."""
    if not sizes:
        return []
    m = -(-sum(sizes) // capacity)
    windows = difference(sizes, m)
    while not cut and (excess := sum(max(0, sum(sizes[i] for i in w) - capacity) for w in windows)):
        m += -(-excess // capacity)
        windows = difference(sizes, m)
    out, spare = [], []
    for w in windows:
        room, kept = capacity, []
        for i in sorted(w, key=lambda i: -sizes[i]):
            n = min(room, sizes[i])
            if n:
                kept.append((i, 0, n))
            if n < sizes[i]:
                spare.append((i, n, sizes[i] - n))
            room -= n
        out.append([room, kept])
    for i, first, n in spare:
        while n:
            at = max(range(len(out)), key=lambda k: out[k][0])
            put = min(n, out[at][0])
            out[at][1].append((i, first, put))
            out[at][0] -= put
            first, n = first + put, n - put
    return [kept for _, kept in out if kept]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, group: int = 2048, piece: int = 512, cut: bool = False) -> DataFrame:
    """One row a piece: which ids of which document lie where in which sequence.

    A null or empty text has the end id alone. Every row is packed by itself, so
    repeated rows or ids are packed as often as they occur. A null doc_id stays
    null. Other columns are not read. An empty table gives no rows.
    ``padded_to`` is the sequence's stored length: the load if that is a power
    of two, else the capacity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = cache(tokenizer_path, spaced=False)
        base, serial = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple] = []
        rows: list[tuple] = []

        def place(pieces: list[tuple]) -> None:
            nonlocal serial
            load = sum(p[3] for p in pieces)
            padded = load if load & (load - 1) == 0 else capacity
            offset = 0
            for doc_id, total, start, n, ids in pieces:
                rows.append((doc_id, start, n, _crc(ids), total, base + serial, offset, padded))
                offset += n
            serial += 1

        def flush() -> None:
            for window in pack([len(x[3]) for x in waiting], capacity, cut):
                place([(waiting[i][0], waiting[i][1], waiting[i][2] + a, n, waiting[i][3][a : a + n]) for i, a, n in window])
            waiting.clear()

        def out() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
            rows.clear()
            return batch

        end = np.array([end_id], np.uint32)
        for batch in slices(batches):
            texts = as_bytes(batch.column(1))
            for first in range(0, len(texts), 512):
                for doc_id, ids in zip(batch.column(0).slice(first, 512).to_pylist(), tokens.encode(texts[first : first + 512])):
                    ids = np.concatenate([ids, end])
                    whole = len(ids) // capacity * capacity
                    for at in range(0, whole, capacity):
                        place([(doc_id, len(ids), at, capacity, ids[at : at + capacity])])
                    for at in range(whole, len(ids), piece):
                        waiting.append((doc_id, len(ids), at, ids[at : at + piece]))
                    if len(waiting) >= group:
                        flush()
                if len(rows) >= 20_000:
                    yield out()
        flush()
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
