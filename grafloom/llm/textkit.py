"""Words, shingle sets and bitmap signatures of texts, computed over Arrow buffers with numpy.

A word is a run of bytes outside space and 0x09-0x0D; A-Z are lower-cased. Word and shingle hashes have
64 bits. Texts are taken whole; batches are cut by bytes so that memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans up to this many bytes are hashed eight bytes at a time, longer ones by BLAKE2b.
MIXED_BYTES = 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): the length, then every eight bytes, through ``mix``."""
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * _GOLDEN + np.uint64(seed))
    eights = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    for at in range(0, MIXED_BYTES, 8):
        live = np.flatnonzero((size > at) & (size <= MIXED_BYTES))
        if not len(live):
            break
        part = eights[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] ^ mix(part + _ODD))
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > MIXED_BYTES).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null has no bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def byte_slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices of about ``most`` bytes and at most
    ``rows`` texts; a longer text is alone."""
    data, offs = text_buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text where its words begin (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offs[:-1][offs[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    leaves = inside.copy()
    leaves[:-1] &= ~inside[1:]
    last = offs[1:][(offs[1:] > 0)] - 1
    leaves[last] = inside[last]
    return span_hashes(_LOWER[data], starts, np.flatnonzero(leaves) + 1), np.searchsorted(starts, offs)


def shingle_hashes(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the k-word runs that begin at each word of a batch; the last k - 1 of a text cross its end."""
    n = max(0, len(words) - k + 1)
    acc = words[:n].copy()
    for j in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) * _GOLDEN + words[j : n + j]
    return mix(acc)


def _short(words: np.ndarray) -> np.ndarray:
    acc = np.uint64(0xA5A5 + len(words))
    with np.errstate(over="ignore"):
        for w in words:
            acc = (acc ^ (acc >> np.uint64(29))) * _GOLDEN + w
    return mix(np.array([acc], np.uint64))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its k-word shingles; one hash of the whole
    sequence if it has fewer words; none without words."""
    words, at = word_hashes(data, offs)
    runs = shingle_hashes(words, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(_short(words[a:b]) if b > a else words[:0])
    return out


def bitmap_width(n: int) -> int:
    """Bits of the signature of a set of n: a power of two over 3n, from 64 to 65,536."""
    return min(1 << 16, max(64, 1 << (3 * n).bit_length()))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap: bit p tells whether an odd number of hashes falls on p. The bits in which two
    bitmaps differ never outnumber the elements in which the sets differ."""
    w = bitmap_width(len(hashes))
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (w - 1), minlength=w) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(bits: np.ndarray, nbytes: int) -> np.ndarray:
    """A bitmap as it would be with fewer bytes: parities of the halves add up."""
    while bits.shape[-1] > nbytes:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def overlap_bound(n1: int, n2: int, b1: np.ndarray, b2: np.ndarray) -> int:
    """No fewer than the elements that two sets share, from sizes and bit counts alone."""
    w = min(len(b1), len(b2))
    return (n1 + n2 - int(np.bitwise_count(fold(b1, w) ^ fold(b2, w)).sum())) // 2


def linked(shared: int, n1: int, n2: int, percent: int) -> bool:
    return n1 > 0 and n2 > 0 and 100 * shared >= percent * (n1 + n2 - shared)
