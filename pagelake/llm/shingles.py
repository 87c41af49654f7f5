"""Digests of word shingles over whole Arrow batches of texts, by arrays.

Words are runs of bytes that aren't ASCII white space, A-Z in lower case. A word's digest is a polynomial of its bytes modulo 2^64: with
prefix sums over the batch, each is the difference of two of them times a power. Words beyond LONG bytes get XXH64 in its place, so no
word is long enough for the pairs that collide under every base. Texts beyond CHUNK bytes are cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
LONG, CHUNK = 64, 1 << 18
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64, for i below n."""
    ones = np.ones(n, dtype=np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def word_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words, and each text's place among them (as offsets). `offsets`: the texts' places in the bytes."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    word = ~SPACE[low]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    starts, ends = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    first[starts], last[ends] = word[starts], word[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(1 << max(19, int(n).bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[end] - sums[begin]) * down[begin]
    for i in np.flatnonzero(end - begin > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(low[begin[i] : end[i]].tobytes())
    return mixed(h), np.searchsorted(begin, offsets)


def next_space(data: np.ndarray, at: int) -> int:
    while at < len(data):
        found = np.flatnonzero(SPACE[data[at : at + 65536]])
        if len(found):
            return at + int(found[0])
        at += 65536
    return len(data)


def long_text(data: np.ndarray) -> np.ndarray:
    """The digests of a text's words, chunk by chunk."""
    parts, at, n = [], 0, len(data)
    while at < n:
        stop = next_space(data, at + CHUNK) if n - at > CHUNK else n
        if stop - at > 2 * CHUNK:  # a word beyond a chunk
            spaces = np.flatnonzero(SPACE[data[at : at + CHUNK]])
            begin = at + int(spaces[-1]) + 1 if len(spaces) else at
            parts.append(word_digests(data[at:begin], np.array([0, begin - at]))[0])
            parts.append(mixed(np.array([xxhash.xxh64_intdigest(LOWER[data[begin:stop]].tobytes())], dtype=np.uint64)))
        else:
            parts.append(word_digests(data[at:stop], np.array([0, stop - at]))[0])
        at = stop
    return np.concatenate(parts)


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle digests of each text; a text of fewer words than `size` has one, the whole."""
    texts = texts.fill_null("") if texts.null_count else texts
    _, places, raw = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    d = 0
    while d < len(texts):
        k = int(np.searchsorted(offsets, offsets[d] + CHUNK, side="right")) - 1
        if k > d:
            own = offsets[d : k + 1]
            h, at = word_digests(data[own[0] : own[-1]], own - own[0])
        else:
            k = d + 1
            h = long_text(data[offsets[d] : offsets[k]])
            at = np.array([0, len(h)])
        yield from shingles(h, at, size)
        d = k


def shingles(h: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    whole = chained(h, size) if len(h) >= size else None
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if a == b:
            yield np.empty(0, np.uint64)
        elif b - a <= size:
            yield chained(h[a:b], b - a)
        else:
            own = np.sort(whole[a : b - size + 1])
            fresh = np.empty(len(own), dtype=bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]


def chained(h: np.ndarray, width: int) -> np.ndarray:
    """A digest of each `width` consecutive words."""
    n = len(h) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : n + k]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out
