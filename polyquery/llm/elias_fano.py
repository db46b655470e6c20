"""Elias-Fano sequences over numpy memory: monotone integers with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

from polyquery.llm.words import U64

WORDS = 4  # 64-bit words of the unary part for each entry of its directory
BLOCK = 1 << 15  # positions that are looked up at once
_1, _5, _3, _F, _8 = (U64(int(x * (16 // len(x)), 16)) for x in ("01", "5", "3", "0f", "80"))
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).ravel()


def select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the rank-th set bit (from 0) in each 64-bit word: by byte sums within the word, then a table."""
    s = words - (words >> U64(1) & _5)
    s = (s & _3) + (s >> U64(2) & _3)
    sums = (s + (s >> U64(4)) & _F) * _1
    shift = np.bitwise_count((rank * _1 | _8) - sums & _8).astype(U64) << U64(3)
    left = rank - ((sums << U64(8)) >> shift & U64(255))
    return (shift + IN_BYTE[((words >> shift & U64(255)) << U64(3) | left).astype(np.int64)]).astype(np.int64)


def pick(bits: np.ndarray, count: np.ndarray, rank: np.ndarray, zeros: bool) -> np.ndarray:
    """Position of the rank-th set (or clear) bit. bits: rows of WORDS words; count: set (or clear) bits before each row."""
    out = np.empty(len(rank), np.int64)
    for s in range(0, len(rank), BLOCK):
        r = rank[s : s + BLOCK]
        row = np.searchsorted(count, r, "right") - 1
        words = ~bits[row] if zeros else bits[row]
        left = r - count[row]
        ones = np.bitwise_count(words)
        at, before = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        upto = np.zeros(len(r), np.int64)
        for j in range(WORDS - 1):
            upto = upto + ones[:, j]
            past = upto <= left
            at += past
            before[past] = upto[past]
        word = words[np.arange(len(r)), at]
        out[s : s + BLOCK] = row * (64 * WORDS) + at * 64 + select(word, (left - before).astype(U64))
    return out


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest `width` bits of each value, one after another, and eight bytes more so that any can be read at once."""
    rows = -(-len(values) // 8)
    v = np.zeros(8 * rows, U64)
    v[: len(values)] = values & U64((1 << width) - 1)
    v, out = v.reshape(rows, 8), np.zeros((rows, width), np.uint8)
    for k in range(width):  # eight values fill `width` bytes
        for j in range(8):
            s = j * width - 8 * k
            if -width < s < 8:
                out[:, k] |= (v[:, j] << U64(s) if s >= 0 else v[:, j] >> U64(-s)).astype(np.uint8)
    return np.concatenate((out.ravel(), np.zeros(8 + -out.size % 8, np.uint8)))


class EliasFano:
    """n ascending integers below `universe`: the lowest `low` bits of each, and the rest in unary, at most about two bits each.

    How many ones come before each WORDS words of the unary part stands beside it, an eighth of its size.
    """

    def __init__(self, n: int, universe: int, low: int, lows: np.ndarray, bits: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.universe, self.low, self.lows, self.bits = n, universe, low, lows, bits.reshape(-1, WORDS)
        self.packed_ones, self.ones = ones, ones.astype(np.int64)
        self.zeros = np.arange(len(ones)) * (64 * WORDS) - self.ones
        self.eight = np.ndarray((max(len(lows) - 7, 1),), "<u8", lows, strides=(1,))
        self.mask = U64((1 << low) - 1)

    @classmethod
    def of(cls, values: np.ndarray, universe: int, low: int | None = None) -> EliasFano:
        """values: ascending uint64 (repeats allowed). low: at most 56; by default what takes the least memory."""
        n = len(values)
        if low is None:
            low = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        low = max(low, min(56, (universe // max(8 * n, 64)).bit_length() - 1))  # the unary part stays in proportion
        high = (values >> U64(low)).astype(np.int64)
        size = n + ((universe - 1) >> low) + 2
        flags = np.zeros(-(-size // (64 * WORDS)) * 64 * WORDS, np.uint8)
        flags[high + np.arange(n)] = 1
        bits = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(bits).reshape(-1, WORDS).sum(axis=1, dtype=np.int64))))
        if n >> 32:
            raise ValueError("over 2**32 values in one sequence")
        return cls(n, universe, low, packed(values, low), bits, ones.astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.universe & (1 << 64) - 1, self.universe >> 64, self.low, len(self.lows), len(self.bits)], U64)
        return head.tobytes() + self.lows.tobytes() + self.bits.tobytes() + self.packed_ones.tobytes() + b"\0" * (-self.packed_ones.nbytes % 8)

    @classmethod
    def at(cls, memory, offset: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at an offset of mapped memory (its directory alone is copied), and where it ends."""
        n, universe, more, low, lows, rows = (int(x) for x in np.frombuffer(memory, U64, 6, offset))
        parts = np.frombuffer(memory, np.uint8, lows, offset := offset + 48)
        bits = np.frombuffer(memory, U64, rows * WORDS, offset := offset + lows)
        ones = np.frombuffer(memory, "<u4", rows + 1, offset := offset + 8 * WORDS * rows)
        return cls(n, universe | more << 64, low, parts, bits, ones), offset + -(-4 * (rows + 1) // 8) * 8

    def low_parts(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        return self.eight[at >> 3] >> (at & 7).astype(U64) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (pick(self.bits, self.ones, i, False) - i).astype(U64)
        return high << U64(self.low) | self.low_parts(i)

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(self[i], self[i + 1]): the second one's bit is looked for right after the first one's."""
        at = pick(self.bits, self.ones, i, False)
        flat = self.bits.ravel()
        rest = flat[at >> 6] & (~U64(1) << (at & 63).astype(U64))
        nxt = (at & ~63) + np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        if len(far):
            nxt[far] = pick(self.bits, self.ones, i[far] + 1, False)
        return (at - i).astype(U64) << U64(self.low) | self.low_parts(i), (nxt - i - 1).astype(U64) << U64(self.low) | self.low_parts(i + 1)

    def values(self) -> np.ndarray:
        high = (np.flatnonzero(np.unpackbits(self.bits.ravel().view(np.uint8), bitorder="little")) - np.arange(self.n)).astype(U64)
        return high << U64(self.low) | self.low_parts(np.arange(self.n))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The least i with self[i] >= x, else n: a search among the values that share x's high part."""
        x = x.astype(U64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        high = (x >> U64(self.low)).astype(np.int64)
        beyond = high > (self.universe - 1) >> self.low
        high = np.where(beyond, 0, high)
        hi = pick(self.bits, self.zeros, high, True) - high
        lo = np.where(high > 0, pick(self.bits, self.zeros, np.maximum(high - 1, 0), True) - high + 1, 0)
        return np.where(beyond, self.n, self.search(lo, hi, np.zeros(len(x), U64), x & self.mask))

    def search(self, lo: np.ndarray, hi: np.ndarray, base: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The least i in [lo, hi) with self[i] - base >= want, else hi, where these differences lie within the low part
        of the range: then low parts tell them without the unary part."""
        lo, hi = lo.copy(), hi.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = (self.low_parts(mid) - base[active] & self.mask) < want[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
            active = active[lo[active] < hi[active]]
        return lo
