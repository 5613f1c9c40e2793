"""Exact tokenizer output at the price of distinct pieces.

Byte-level BPE encodes each pre-token by itself, so a text's ids are the
concatenated ids of its pre-tokens. Texts are cut at ASCII white space and at
changes between ASCII letters, digits and signs into units that no pre-token
crosses; only units not met before go to the ``tokenizers`` library's own BPE
model, and all others are table look-ups in numpy. Units are known by a 64-bit hash. Texts with white space that is not ASCII, or with control
characters, are encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import regex

from .kernel import U, Words, chunks

ODD = regex.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\xa0᠎  -‏ -  -⁤　﻿]")
#: Pre-token patterns of the two public vocabularies (fixed values).
SPACED = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
DROPPED = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
#: Bytes without which a UTF-8 text cannot hold any of the characters of ODD.
SUSPECT = bytes([*range(0, 9), 11, 12, *range(14, 32), 127, 0xC2, 0xCD, 0xE1, 0xE2, 0xE3, 0xEF, *range(0xF0, 0x100)])
#: 1 letter, 2 digit, 3 sign, 0 anything at whose edge a text must not be cut.
KIND = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 33 <= b < 127 and b != 39 else 0 for b in range(128)] + [0] * 128, np.uint8)
PLAIN = regex.compile(r"[ -~¡-ɏ]*")


def _byte_table() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenCache:
    """``spaced``: white space belongs to the ids (else it is dropped and letters are lower-cased).

    ``limit`` bounds the cached units; a full cache starts anew.
    """

    def __init__(self, path: str, spaced: bool, limit: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.spaced, self.limit = self.tokenizer.model, spaced, limit
        self.table = _byte_table()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at = np.zeros(0, U), np.zeros(0, np.int64)
        self.off, self.len, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _unit(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        if not self.spaced:
            if not text.isascii():
                if not PLAIN.fullmatch(text) or "İ" in text:
                    return self.tokenizer.encode(text, add_special_tokens=False).ids
                text = unicodedata.normalize("NFC", text)
            text = text.lower()
        body = text[1:] if self.spaced and text[0] == " " else text
        tokens = (text,) if body.isalpha() else (SPACED if self.spaced else DROPPED).findall(text)
        return [t.id for token in tokens for t in self.model.tokenize(token.replace(" ", self.table[32]) if token.isascii() and token.isprintable() else token.encode().decode("latin-1").translate(self.table))]

    def _spans(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units as byte spans in order, and their texts."""
        doc = w.doc_of()
        if not self.spaced:
            return w.start, w.end, doc
        before = np.maximum(np.concatenate([[0], w.end[:-1]]) if len(w) else w.end, w.doc_start[doc])
        blank = w.start > before
        spaced = blank & (w.buf[np.maximum(w.start - 1, 0)] == 32)
        run = blank & (w.start - before > 1)
        last = blank & ~spaced
        tail_doc = np.flatnonzero(w.doc_end > w.doc_start)
        last_word = w.bounds[tail_doc + 1] - 1
        tail = np.where(last_word >= w.bounds[tail_doc], w.end[last_word] if len(w) else 0, w.doc_start[tail_doc])
        keep = tail < w.doc_end[tail_doc]
        start = np.concatenate([before[run], w.start[last] - 1, w.start - spaced, tail[keep]])
        end = np.concatenate([w.start[run] - 1, w.start[last], w.end, w.doc_end[tail_doc][keep]])
        docs = np.concatenate([doc[run], doc[last], doc, tail_doc[keep]])
        order = np.argsort(start, kind="stable")
        return start[order], end[order], docs[order]

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        w = Words(texts)
        start, end, doc = self._spans(w)
        kind = KIND[w.buf]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        doc = np.repeat(doc, np.searchsorted(cut, end) - np.searchsorted(cut, start, "right") + 1)
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes, first, inverse = np.unique(w.spans(start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(hashes) > self.limit and len(self.keys):
            self._clear()
        place = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == hashes[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw, s, e = w.bytes, start[first[new]].tolist(), end[first[new]].tolist()
            found = [self._unit(raw[a:b]) for a, b in zip(s, e)]
            lens = np.fromiter(map(len, found), np.int32, len(found))
            n, base = len(self.off), len(self.ids)
            self.off = np.concatenate([self.off, base + np.cumsum(lens) - lens])
            self.len = np.concatenate([self.len, lens])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(lens.sum()))])
            self.keys = np.insert(self.keys, place[new], hashes[new])
            self.at = np.insert(self.at, place[new], n + np.arange(len(new)))
            place = np.searchsorted(self.keys, hashes)
        at = self.at[place][inverse]
        lens = self.len[at].astype(np.int64)
        ends = np.cumsum(lens)
        ids = self.ids[np.repeat(self.off[at] - (ends - lens), lens) + np.arange(ends[-1])]
        return ids, np.bincount(doc, lens, len(texts)).astype(np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids (uint32) of each UTF-8 text."""
        out: list[np.ndarray] = []
        for a, b in chunks(texts):
            part = texts[a:b]
            whole: dict[int, np.ndarray] = {}
            joined = b"\n".join(part)
            if len(joined.translate(None, SUSPECT)) < len(joined):
                whole = {i: t for i, t in enumerate(part) if ODD.search(t.decode("utf-8", "replace"))}
                for i, t in whole.items():
                    whole[i] = np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                part = [b"" if i in whole else t for i, t in enumerate(part)]
            ids, counts = self._chunk(part)
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            out += [whole.get(i, x) for i, x in enumerate(pieces)]
        return out


_CACHES: dict[tuple, TokenCache] = {}


def cache(path: str, spaced: bool) -> TokenCache:
    """One cache for each worker process and vocabulary."""
    key = (path, spaced)
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = TokenCache(path, spaced)
    return _CACHES[key]
