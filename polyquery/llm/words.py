"""Words of many texts at once: numpy over the bytes of an Arrow column, without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 512 << 10  # bytes of text handled at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit moves each output bit (xor-shifts and odd multipliers)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEED, ODD = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
SHORT = 64  # bytes; longer spans are hashed one by one


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes data[start:end].

    Eight bytes at a time are put into a state that starts from the length and is mixed after each, so that
    no arrangement of letters cancels out as it does in a polynomial; spans beyond SHORT bytes get BLAKE2b.
    """
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(eight[starts] & MASKS[np.minimum(size, 8)] ^ mix(size.astype(U64) * ODD + SEED))
    more = np.flatnonzero((size > 8) & (size <= SHORT))
    done = 8
    while len(more):
        h[more] = mix(eight[starts[more] + done] & MASKS[np.minimum(size[more] - done, 8)] ^ h[more])
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    if not large and not pa.types.is_string(column.type):
        column, large = column.cast(pa.large_string()), True
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes; a longer document is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and the number of words before each document (n+1)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) and the number of words before each document (n+1)."""
    starts, ends, first = find_words(data, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), first


def step(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The next state of a hash over a sequence of word hashes."""
    return (h ^ h >> U64(32)) * ODD + word


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles, ascending within each document, and how many come before it (n+1).

    A document of fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    before = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(first[:-1] - before[:-1], n) + np.arange(before[-1])
    doc = np.repeat(np.arange(len(n)), n)
    hashed = np.zeros(len(at), U64)
    windows = len(words) - k + 1
    if windows > 0:  # of all windows, those across documents play no part
        h = words[:windows].copy()
        for j in range(1, k):
            h = step(h, words[j : j + windows])
        whole = (count >= k)[doc]
        hashed[whole] = mix(h[at[whole]])
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        h, at = words[first[few]].copy(), first[few]
        for j in range(1, k - 1):
            inside = np.flatnonzero(count[few] > j)
            h[inside] = step(h[inside], words[at[inside] + j])
        hashed[before[few]] = mix(h + count[few].astype(U64) * SEED)
    order = np.lexsort((hashed, doc))
    hashed, doc = hashed[order], doc[order]
    keep = np.ones(len(hashed), bool)
    keep[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
    return hashed[keep], np.concatenate(([0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))))
