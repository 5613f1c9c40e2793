"""Token ids in a bit-plane file format, and back.

A segment holds whole documents: their ids and lengths, and the ids in blocks of
``BLOCK``. A block is transposed into byte planes (``bits=False``) or bit planes,
each compressed with zstandard by itself; the planes of high bits are mostly
zeros and cost little. The chunk index of a segment gives each block's place in the segment, the
number of its first id there, its id count and its planes' sizes, so a range of ids is read
from the blocks that hold it alone (``read_range``).

Segment, little-endian: magic, flags, blocks, ids, documents; doc_id and length of
every document; then the index, an entry a block; then planes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import as_bytes, slices
from .tables import scratch
from .tokencache import cache

MAGIC = b"KTP2"
BLOCK = 1 << 16
HEAD = struct.Struct("<4sBIQQ")


def _planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [x.tobytes() for x in np.ascontiguousarray(raw)]
    return [x.tobytes() for plane in raw for x in np.packbits(np.unpackbits(plane.reshape(-1, 1), axis=1, bitorder="little").T, axis=1)]


def _join(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        rows = np.unpackbits(np.frombuffer(b"".join(planes), np.uint8).reshape(32, -1), axis=1, count=n)
        raw = np.packbits(rows.reshape(4, 8, n), axis=1, bitorder="little").reshape(4, n)
    else:
        raw = np.frombuffer(b"".join(planes), np.uint8).reshape(4, n)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def encode_segment(doc_ids: list[int], docs: list[np.ndarray], bits: bool = False, level: int = 3) -> bytes:
    import zstandard

    pack = zstandard.ZstdCompressor(level=level)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    entry = _entry(bits)
    place = HEAD.size + 16 * len(docs) + entry.size * len(blocks)
    index, body = [], []
    for k, block in enumerate(blocks):
        planes = [pack.compress(p) for p in _planes(block, bits)]
        index.append(entry.pack(place, k * BLOCK, len(block), *map(len, planes)))
        place += sum(map(len, planes))
        body += planes
    table = np.array(doc_ids, "<i8").tobytes() + np.array([len(d) for d in docs], "<u8").tobytes()
    return b"".join([HEAD.pack(MAGIC, bits, len(blocks), len(ids), len(docs)), table, *index, *body])


def _entry(bits: bool) -> struct.Struct:
    """Place in the segment, first id, ids, plane sizes of a block."""
    return struct.Struct(f"<QQI{32 if bits else 4}I")


def read_range(raw: bytes, first: int, last: int) -> np.ndarray:
    """Ids number ``first`` to ``last`` - 1 of a segment; only blocks that hold some of them are decompressed."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    magic, bits, n_blocks, n_ids, n_docs = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    first, last = max(first, 0), min(last, n_ids)
    entry, at, parts = _entry(bool(bits)), HEAD.size + 16 * n_docs, [np.zeros(0, np.uint32)]
    for k in range(first // BLOCK, -(-last // BLOCK) if first < last else 0):
        place, start, n, *sizes = entry.unpack_from(raw, at + k * entry.size)
        planes = []
        for s in sizes:
            planes.append(unpack.decompress(raw[place : place + s]))
            place += s
        parts.append(_join(planes, n, bool(bits))[max(first - start, 0) : last - start])
    return np.concatenate(parts)


def decode_segment(raw: bytes) -> tuple[list[int], list[np.ndarray]]:
    """doc_ids and ids of all documents of a segment."""
    _, _, _, n_ids, n_docs = HEAD.unpack_from(raw)
    ids = read_range(raw, 0, n_ids)
    doc_ids = np.frombuffer(raw, "<i8", n_docs, HEAD.size).tolist()
    lens = np.frombuffer(raw, "<u8", n_docs, HEAD.size + 8 * n_docs).astype(np.int64)
    return doc_ids, np.split(ids, np.cumsum(lens)[:-1]) if n_docs else []


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, segment_ids: int = 1 << 19, bits: bool = False) -> None:
    """Writes ``docs`` in ascending doc_id to ``path``: a row a segment, with its chunk index columns.

    Ranges of doc_id go to one task each, so a hot source or group of copies is
    spread like any other rows. Null text is empty: the end id alone. Rows without
    a doc_id come first; ``n_null`` counts them in each segment. Rows that repeat a doc_id
    are all kept, in order of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = cache(tokenizer_path, spaced=True)
        end = np.array([end_id], np.uint32)
        names, kept, size, serial = [], [], 0, 0

        def out() -> pa.RecordBatch:
            cols = [[names[0]], [names[-1]], [serial], [len(kept)], [size], [names.count(None)], [encode_segment([x or 0 for x in names], kept, bits)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.binary()])], ["first_doc", "last_doc", "segment", "n_docs", "n_ids", "n_null", "segment_bytes"])

        for batch in slices(batches):
            texts = as_bytes(batch.column(1))
            for first in range(0, len(texts), 512):
                for doc_id, ids in zip(batch.column(0).slice(first, 512).to_pylist(), tokens.encode(texts[first : first + 512])):
                    names.append(doc_id)
                    kept.append(np.concatenate([ids, end]))
                    size += len(kept[-1])
                    if size >= segment_ids:
                        yield out()
                        names, kept, size, serial = [], [], 0, serial + 1
        if kept:
            yield out()

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(run, "first_doc long, last_doc long, segment long, n_docs long, n_ids long, n_null long, segment_bytes binary")
    written.withColumn("part", F.spark_partition_id()).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.min("first_doc").alias("low"), F.sum("n_ids").alias("part_ids"))
    # One row a file, not a document.
    before = Window.orderBy("low", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    index = files.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    index = index.join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("inside")).alias("first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, nulls, raw in zip(*(c.to_pylist() for c in batch.columns)):
                names, docs = decode_segment(raw)
                lens = np.array([len(d) for d in docs], np.int64)
                crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
                columns = [pa.array(np.full(len(docs), part)), pa.array(np.full(len(docs), segment)), pa.array([None] * nulls + list(names)[nulls:], pa.int64()), pa.array(np.cumsum(lens) - lens), pa.array(lens), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.select(F.col("part").cast("long"), "segment", "n_null", "segment_bytes").mapInArrow(run, "part long, segment long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(index, ["part", "segment"]).select("doc_id", (F.col("first_id") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, **options)
    return read_tokens(spark, path)
