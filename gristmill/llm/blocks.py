"""NumPy kernels over blocks of texts: words and hashes of many documents at once, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel works on at a time; one longer text is a block of its own.
BLOCK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base ** i mod 2**64 for i < n, or of the base's inverse; kept for the next block."""
    name = "inverse" if inverse else "base"
    if len(_POWERS.get(name, ())) < n:
        base = pow(int(_BASE), -1, 1 << 64) if inverse else int(_BASE)
        size = max(n, BLOCK_BYTES + 4096)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _POWERS[name] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows; a null is an empty text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s] = hash of data[s:e] times base ** s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, the same wherever it stands."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), True)[starts] + (ends - starts).astype(np.uint64))


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of words without white space; first[i]: number of words before document i."""
    word = ~_GAP[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word
    inner = offsets[:-1]
    before[inner] = False
    starts = np.flatnonzero(word & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = word
    after[offsets] = False
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingles of each document in order, with repeats; a shorter text is one shingle of all its words."""
    data = lower(data)
    starts, ends, first = plain_words(data, offsets)
    words = span_hash(prefix_hash(data), starts, ends)
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=out_first[1:])
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1] - first[:-1], counts)
    acc = np.zeros(len(at), np.uint64)
    have = np.repeat(np.minimum(n, width), counts)
    for j in range(width):
        use = np.minimum(at + j, max(len(words) - 1, 0))
        part = mix(words[use] + np.uint64((j + 1) * 0xA24BAED4963EE407 & (2**64 - 1))) if len(words) else acc
        acc = acc * np.uint64(0x9FB21C651E98DF25) + np.where(j < have, part, np.uint64(0))
    return mix(acc + have.astype(np.uint64)), out_first
