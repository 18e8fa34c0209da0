"""Exact token ids of the JSON tokenizers, through a cache of short chunks.

Both splitting patterns always break before a lone space between two other characters, and between a
letter and ASCII punctuation that follows it; a text is cut there and the pieces are encoded apart.
``tests/llm`` holds this against the library on whole texts. The library encodes each chunk that the
cache lacks once; a text is then a gather over cached ids. Chunks are known by a seeded 64-bit hash; the cache
has a fixed number of places and starts anew when they are used up.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .textkit import span_hashes

_PLACES = 1 << 21
_MOST = 1_500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII punctuation before which a cut is safe. The bar is left out: special tokens hold it.
_STOP = np.zeros(256, bool)
_STOP[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "|"]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


class _HashIndex:
    """64-bit key to int32, open addressing, whole arrays at a time."""

    def __init__(self):
        self.keys = np.zeros(_PLACES, np.uint64)
        self.vals = np.zeros(_PLACES, np.int32)
        self.size = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        rest = np.arange(len(h))
        slot = (h & np.uint64(_PLACES - 1)).astype(np.int64)
        while len(rest):
            at = slot[rest]
            key = self.keys[at]
            hit = key == h[rest]
            out[rest[hit]] = self.vals[at[hit]]
            go = ~hit & (key != 0)
            rest = rest[go]
            slot[rest] = (slot[rest] + 1) & (_PLACES - 1)
        return out

    def add(self, h: np.ndarray, first: int) -> None:
        """Puts distinct keys that aren't there yet; their values count up from ``first``."""
        rest = np.arange(len(h))
        slot = (h & np.uint64(_PLACES - 1)).astype(np.int64)
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.vals[slot[won]] = first + won
            done = np.zeros(len(h), bool)
            done[won] = True
            rest = rest[~done[rest]]
            slot[rest] = (slot[rest] + 1) & (_PLACES - 1)
        self.size += len(h)


class ChunkEncoder:
    """Encodes columns of texts. ``lead``: a chunk keeps the space before it; else white space is dropped
    and A-Z are lower-cased by the tokenizer itself."""

    def __init__(self, path: str, lead: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lead = lead
        #: Keys of the cache differ from process to process, so no text can be made to meet another's.
        self.seed = int.from_bytes(os.urandom(8), "little")
        self._reset()

    def _reset(self) -> None:
        self.index = _HashIndex()
        self.ids = np.zeros(1 << 16, np.uint16)
        self.begin = np.zeros(1 << 16, np.int64)
        self.known = 0

    def _learn(self, chunks: list[str]) -> None:
        got = [e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((x for ids in got for x in ids), np.uint16, int(n.sum()))
        base, end = int(self.begin[self.known]), self.known + len(got)
        while end + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        while base + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[base : base + len(flat)] = flat
        self.begin[self.known + 1 : end + 1] = base + np.cumsum(n)
        self.known = end

    def chunks(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cache places of all chunks of the texts, and where each text's chunks begin (n + 1)."""
        n = len(offs) - 1
        full = offs[:-1][np.diff(offs) > 0]
        if not len(full):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        # Bytes of two-byte characters U+00C0 to U+02AF; no white space and no combining mark is among them.
        two = (data >= 0xC3) & (data <= 0xCA)
        two[1:] |= two[:-1]
        solid = (~_BLANK[data] & (data < 0x80)) | two
        alpha = _ALPHA[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-2] = (data[1:-1] == 0x20) & solid[:-2] & solid[2:]
        cut[1:-1] |= alpha[:-1] & _STOP[data[1:]]
        cut[full] = True
        starts = np.flatnonzero(cut[:-1])
        bounds = np.append(starts, len(data))
        at = np.searchsorted(starts, offs)
        # The chunk's own bytes: without the space where it is no part of a token.
        own = bounds[:-1].copy()
        special = not self.lead and b"<|" in data.tobytes()
        if not self.lead:
            lone = data[starts] == 0x20
            first = np.zeros(len(data) + 1, bool)
            first[full] = True
            own += lone & ~first[starts]
        body = data if self.lead or special else _LOWER[data]
        h = span_hashes(body, own, bounds[1:], self.seed)
        h[h == 0] = 1
        if self.index.size > _MOST:
            self._reset()
        place = self.index.find(h)
        gone = np.flatnonzero(place < 0)
        if len(gone):
            new, first_at, back = np.unique(h[gone], return_index=True, return_inverse=True)
            raw = body.tobytes()
            where = gone[first_at]
            start = self.known
            self._learn([raw[a:b].decode() for a, b in zip(own[where].tolist(), bounds[1:][where].tolist(), strict=True)])
            self.index.add(new, start)
            place[gone] = start + back
        return place, at

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        place, at = self.chunks(data, offs)
        sums = np.append(0, np.cumsum(self.begin[place + 1] - self.begin[place]))
        return sums[at[1:]] - sums[at[:-1]]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint16), and where each text's ids begin (n + 1)."""
        place, at = self.chunks(data, offs)
        width = self.begin[place + 1] - self.begin[place]
        sums = np.append(0, np.cumsum(width))
        rows = np.arange(sums[-1]) + np.repeat(self.begin[place] - sums[:-1], width)
        return self.ids[rows], sums[at]


@lru_cache(maxsize=2)
def encoder(path: str, lead: bool) -> ChunkEncoder:
    """One encoder for each worker process."""
    return ChunkEncoder(path, lead)


@lru_cache(maxsize=8)
def version(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
