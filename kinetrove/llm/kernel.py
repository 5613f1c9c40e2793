"""Vectorised word and n-gram hashing over batches of texts (numpy only).

A batch of UTF-8 texts is one byte buffer; words are the maximal runs of bytes
outside ``0x20`` and ``0x09-0x0D``. A span's hash is a polynomial hash modulo
2**64 over random byte codes, finished by a bit mixer, so equal spans always
have equal hashes and different ones collide with a probability near 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np

U = np.uint64
MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    z = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator (published constants)."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


CODES = _splitmix(256, 7)
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
GRAM_BASE = 0x2545F4914F6CDD1D
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.ones(n, U)
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
            done += step
        return out

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            self.up, self.down = self._series(self.base, size), self._series(self.inverse, size)
        return self.up, self.down


_BYTES, _GRAMS = _Powers(BASE), _Powers(GRAM_BASE)


def chunks(texts: list[bytes], limit: int = 1 << 20):
    """(first, last) index pairs whose texts have about ``limit`` bytes together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def release() -> None:
    """Gives memory that is free back to the system: workers live on after a task, several to an executor, and keep what it used most."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def slices(batches: Iterator, rows: int = 1024) -> Iterator:
    """Record batches in parts of at most ``rows`` rows, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
        del batch
        release()


class Words:
    """The words of some texts. ``doc`` is the text of each word, ``bounds[i]:bounds[i+1]`` the words of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.bytes = joined.lower() if lower else joined
        self.buf = np.frombuffer(self.bytes, np.uint8)
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.doc_end = np.cumsum(lens + 1) - 1
        self.doc_start = self.doc_end - lens
        self.space = SPACE[self.buf]
        edge = np.flatnonzero(np.diff(self.space.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.bounds = np.searchsorted(self.start, np.append(self.doc_start, len(self.buf)))
        self._prefix = None

    def __len__(self) -> int:
        return len(self.start)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans of the buffer."""
        if self._prefix is None:
            up, _ = _BYTES.get(len(self.buf) + 1)
            self._prefix = np.zeros(len(self.buf) + 1, U)
            np.cumsum(CODES[self.buf] * up[: len(self.buf)], out=self._prefix[1:])
        _, down = _BYTES.get(len(self.buf) + 1)
        return mix((self._prefix[end] - self._prefix[start]) * down[start] + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_start)), np.diff(self.bounds))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; windows that cross texts are the caller's to drop."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    up, down = _GRAMS.get(n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum(hashes * up[:n], out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1] + U(k))


def gram_owner(bounds: np.ndarray, n_grams: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every k-gram that lies inside one text."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
    return first, doc


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow string column as bytes; a null is an empty text."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
