"""Word hashes of whole texts, vectorised over the bytes of an Arrow batch.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D), which is
the same as the run of characters in UTF-8.  Its 64-bit hash is a polynomial over its bytes,
mixed; sequences of words are hashed by combining the word hashes in order.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are hashed at a time.
BLOCK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n, _P, np.uint64), np.full(n, _P_INVERSE, np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_words(data: np.ndarray, cuts: np.ndarray, lower: bool):
    """(start, end, hash) of the words in ``data``; words also end at ``cuts``."""
    if lower:
        data = data + (((data >= 65) & (data <= 90)) << 5).astype(np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = cuts[(cuts > 0) & (cuts < len(data))]
    first[at] |= inside[at]
    last[at - 1] |= inside[at - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << max(20, (len(data) + 1).bit_length())
    p, q = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:len(data)], out=total[1:])
    h = (total[end] - total[start]) * q[start]
    return start, end, mix(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def _long_words(data: np.ndarray, lower: bool):
    """As above for one text longer than a block, cut at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data):
            near = data[end:end + 4096]
            sep = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))
            if len(sep):
                end += int(sep[0])
                break
            end += len(near)
        s, e, h = _block_words(data[at:end], np.empty(0, np.int64), lower)
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(c) for c in zip(*parts))


def batch_words(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Goes through a string array in groups of rows of about BLOCK_BYTES; yields
    (first row, end row, bytes, first word of each row and the end, start, end, hash)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    whole = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1)
        b = min(b, len(texts))
        data = whole[offsets[a]:offsets[b]]
        cuts = offsets[a:b + 1] - offsets[a]
        if b == a + 1 and len(data) > BLOCK_BYTES:
            start, end, h = _long_words(data, lower)
        elif len(data):
            start, end, h = _block_words(data, cuts, lower)
        else:
            start, end, h = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        yield a, b, data, np.searchsorted(start, cuts), start, end, h
        a = b


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two parts (order matters)."""
    x = a * _P + b
    return x ^ (x >> np.uint64(29))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words (row boundaries are the caller's concern), joined
    from spans of 1, 2, 4, ... words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at, span, size = None, 0, h, 1
    while size <= k:
        if k & size:
            part = span[at:at + n]
            out = part + np.uint64(size) if out is None else _join(out, part)
            at += size
        if size * 2 <= k:
            span = _join(span[:-size], span[size:])
        size *= 2
    return mix(out)


def shingles(h: np.ndarray, k: int, rolled: np.ndarray | None = None) -> np.ndarray:
    """The sorted distinct k-word shingles of one text's words as 63-bit hashes (so that
    signed and unsigned order agree); fewer words than ``k`` make one shingle of the whole
    sequence, no words none."""
    if len(h) == 0:
        return np.empty(0, np.uint64)
    if len(h) < k:
        return rolling(h, len(h)) >> np.uint64(1)
    s = np.sort((rolling(h, k) if rolled is None else rolled) >> np.uint64(1))
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    return s[keep]
