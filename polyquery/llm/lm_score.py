"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 maps words (64-bit hashes, an Elias-Fano sequence whose ranks are the word numbers) to exact
counts. A level above holds, for each n-gram below, the words that follow it: an Elias-Fano sequence of
(rank of the n-gram) * words + word, and monotone pointers, also Elias-Fano, from an n-gram to the start
of its range. A query takes the range from the pointers and asks for the successor of its word in it;
relative to the context, the low parts alone tell the words apart.

Beside the sequences lie 16-bit quantised log10 values: of each n-gram its absolutely discounted
probability, of each context the share that it leaves to the next lower level, down to add-one unigrams.
Levels 2 and 3 share files: a file holds the bigrams of a range, and the trigrams that they begin. Ranges
are cut by the word counts, and within a frequent word by what follows it, so that no file grows with one
word. Files are written to the shared folder by the tasks that build them and memory-mapped by those that
score; the driver holds a row for each file.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquery.llm.elias_fano import EliasFano
from polyquery.llm.shared import documents, map_file, put_file, ready, remove, shared_dir
from polyquery.llm.words import U64, chunks, text_bytes, word_hashes

END = U64(0x9E3779B97F4A7C15)  # stands for the end of a text, and before its first word
STEP = 4096  # quantised steps in a factor of ten
TOKENS_A_FILE = 6_000_000
TEXT = 4 << 20  # bytes of text handled at once
TOKENS = 1 << 20  # tokens handled at once
OPEN = 256  # files that a worker keeps mapped
SPREAD = 16  # a word with this part of a file's tokens is placed on its own when ranges are cut


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(p) * STEP), 65535).astype("<u2")


POWERS = 10.0 ** (np.arange(65536) / -STEP)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = runs(keys)
    return keys[first], np.add.reduceat(counts, first)


# arrays in bytes: ascending keys as differences, byte by byte; counts in a byte where they fit


def keys_to_bytes(keys: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=U64(0))
    wide = 8 if len(steps) and int(steps.max()) >> 32 else 4
    head = np.array([len(keys), wide], U64).tobytes()
    return head + steps.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes()


def keys_from(blob: bytes, at: int) -> tuple[np.ndarray, int]:
    n, wide = (int(x) for x in np.frombuffer(blob, U64, 2, at))
    planes = np.frombuffer(blob, np.uint8, n * wide, at + 16).reshape(wide, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{wide}").ravel(), dtype=U64), at + 16 + n * wide


def counts_to_bytes(counts: np.ndarray) -> bytes:
    many = np.flatnonzero(counts > 254)
    return np.array([len(many)], U64).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[many].astype("<i8").tobytes()


def counts_from(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    many = int(np.frombuffer(blob, U64, 1, at)[0])
    counts = np.frombuffer(blob, np.uint8, n, at + 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, np.uint8, 8 * many, at + 8 + n).view("<i8")
    return counts, at + 8 + n + 8 * many


class Files:
    """Files of one kind by number, mapped when first asked for; the OPEN last used stay mapped."""

    def __init__(self, paths: list[str], read) -> None:
        self.paths, self.read, self.held = paths, read, OrderedDict()

    def __getitem__(self, i: int):
        if i in self.held:
            self.held.move_to_end(i)
        else:
            self.held[i] = self.read(self.paths[i])
            if len(self.held) > OPEN:
                self.held.popitem(last=False)
        return self.held[i]


def read_words(path: str):
    memory = map_file(path)
    keys, at = EliasFano.at(memory)
    return keys, np.frombuffer(memory, "<u8", keys.n, at)


def read_grams(path: str):
    """(first context, bigrams, their pointers, trigrams, their pointers)."""
    memory = map_file(path)
    first, out, at = int(np.frombuffer(memory, U64, 1, 0)[0]), [], 8
    for _ in range(4):
        part, at = EliasFano.at(memory, at)
        out.append(part)
    return first, *out


def read_codes(path: str) -> list[np.ndarray]:
    """Arrays of 16-bit codes, each after its length."""
    memory, out, at = map_file(path), [], 0
    while at < len(memory):
        n = int(np.frombuffer(memory, U64, 1, at)[0])
        out.append(np.frombuffer(memory, "<u2", n, at + 8))
        at += 8 + -(-2 * n // 8) * 8
    return out


def codes_to_bytes(*arrays: np.ndarray) -> bytes:
    return b"".join(np.array([len(a)], U64).tobytes() + a.tobytes() + b"\0" * (-2 * len(a) % 8) for a in arrays)


def find(keys: EliasFano, pointers: EliasFano, row: np.ndarray, words: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The successor of each word among those that follow the row-th context (rows ascend), and whether it is the word."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    first = runs(row)
    begin, stop = pointers.pairs(row[first])
    where = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
    begin, stop = begin.astype(np.int64)[where], stop.astype(np.int64)[where]
    base = row.astype(U64) * U64(words) & keys.mask
    at = keys.search(begin, stop, base, word.astype(U64))
    safe = np.minimum(at, max(keys.n - 1, 0))
    return at, (at < stop) & ((keys.low_parts(safe) - base & keys.mask) == word.astype(U64))


class Trie:
    """words, grams: (path, ...) of each file. cuts: the first bigram key of each file of grams but the first."""

    def __init__(self, words: tuple, cuts: tuple, grams: tuple, tokens: int) -> None:
        self.first = np.array([w[0] for w in words], U64)
        self.base = np.cumsum([0, *(w[1] for w in words)])
        self.tokens, self.vocabulary = tokens, int(self.base[-1])
        self.words, self.shares = Files([w[2] for w in words], read_words), Files([w[2] + ".p" for w in words], read_codes)
        self.cuts = np.array(cuts, U64)
        self.grams, self.codes = Files(list(grams), read_grams), Files([f"{g}.p" for g in grams], read_codes)

    def known(self, hashes: np.ndarray, shares: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers (-1: unknown), counts, and the shares that they leave as contexts (1 where unknown), of ascending hashes."""
        number, count, share = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.ones(len(hashes))
        if len(self.first):
            for i, s, e in parts(np.maximum(np.searchsorted(self.first, hashes, "right") - 1, 0)):
                keys, counts = self.words[i]
                at = keys.successor(hashes[s:e])
                hit = np.flatnonzero((at < keys.n) & (keys[np.minimum(at, keys.n - 1)] == hashes[s:e]))
                number[s:e][hit] = self.base[i] + at[hit]
                count[s:e][hit] = counts[at[hit]]
                if shares:
                    share[s:e][hit] = POWERS[self.shares[i][0][at[hit]]]
        return number, count, share

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of ascending word numbers."""
        out = np.zeros(len(numbers), np.int64)
        for i, s, e in parts(np.searchsorted(self.base, numbers, "right") - 1):
            out[s:e] = self.words[i][1][numbers[s:e] - self.base[i]]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.tokens + self.vocabulary + 1)


def parts(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of the runs of equal values."""
    first = runs(of).tolist()
    for s, e in zip(first, [*first[1:], len(of)][: len(first)], strict=True):
        yield int(of[s]), s, e


@lru_cache(maxsize=4)
def opened(*model) -> Trie:
    return Trie(*model)


def tokens_of(column: pa.Array):
    """(tokens' hashes, tokens before each text) of a column of texts; an end closes each text."""
    data, offsets = text_bytes(column)
    hashes, first, before = [], [np.zeros(1, np.int64)], 0
    for a, b in chunks(offsets):
        words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes.append(np.insert(words, at[1:], END))
        first.append(at[1:] + np.arange(1, b - a + 1) + before)
        before += len(hashes[-1])
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.concatenate(first)


def pieces(batches, most: int = TEXT):
    """Record batches of about `most` bytes from smaller and larger ones."""
    held, size = [], 0
    for b in batches:
        data, offsets = text_bytes(b.column(b.num_columns - 1))
        for s, e in chunks(offsets, most):
            held.append(b.slice(s, e - s))
            size += int(offsets[e] - offsets[s])
            if size >= most // 2:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Block:
    """Up to TOKENS tokens in a row as numbers among the distinct words of their texts, and their distinct bigrams.

    The block begins with the token before it, where that is in the same text, so that trigrams across
    blocks are whole: `lead` is 1 then, else 0.
    """

    def __init__(self, local: np.ndarray, start: np.ndarray, end: int, distinct: int, a: int, b: int) -> None:
        self.lead = int(a > 0 and not start[a])
        at = slice(a - self.lead, b)
        self.word, self.start = local[at], start[at]
        context = np.empty_like(self.word)
        context[1:] = self.word[:-1]
        context[:1] = local[a - self.lead - 1] if a - self.lead > 0 else end
        context[self.start] = end
        self.width = max(1, int(distinct - 1).bit_length())
        key = context.astype(U64) << U64(self.width) | self.word.astype(U64)
        room = max(1, int(len(key)).bit_length())
        if 2 * self.width + room <= 64:  # sorted together with their places
            both = np.sort(key << U64(room) | np.arange(len(key), dtype=U64))
            self.order, key = (both & U64((1 << room) - 1)).astype(np.int64), both >> U64(room)
        else:
            self.order = np.argsort(key, kind="stable")
            key = key[self.order]
        self.first = runs(key)
        key = key[self.first]
        self.left, self.right = (key >> U64(self.width)).astype(np.int64), (key & U64((1 << self.width) - 1)).astype(np.int64)
        self.rank = np.repeat(np.arange(len(key)), np.diff(np.append(self.first, len(self.order))))  # in self.order


def blocks(local: np.ndarray, first: np.ndarray, end: int, distinct: int, size: int):
    start = np.zeros(len(local), bool)
    start[first[:-1]] = True
    for a in range(0, len(local), size):
        yield Block(local, start, end, distinct, a, min(a + size, len(local))), a


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(each token's place among the distinct hashes, these ascending, the end's place)."""
    codes, distinct = pd.factorize(hashes)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    distinct = distinct[order]
    return place[codes], distinct, int(np.searchsorted(distinct, END))


def vocabulary(docs: DataFrame, folder: str, shards: int, often: int) -> list:
    """Writes level 1; a row for each file: (first hash, words, path, tokens, [places and counts of words met over `often` times])."""
    def count(batches):
        held = []
        for b in pieces(batches):
            h, _ = tokens_of(b.column(0))
            codes, distinct = pd.factorize(h)
            order = np.argsort(distinct)
            held.append((distinct[order], np.bincount(codes, minlength=len(distinct))[order]))
            if sum(len(k) for k, _ in held) > 2 * TOKENS:
                yield from dealt(held)
                held = []
        if held:
            yield from dealt(held)

    def dealt(held):
        k, c = summed(*map(np.concatenate, zip(*held, strict=True)))
        for i, s, e in parts((k >> U64(32)).astype(np.int64) * shards >> 32):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([keys_to_bytes(k[s:e]) + counts_to_bytes(c[s:e])], pa.binary())], ["shard", "blob"])

    def build(batches):
        held: dict[int, list] = {}
        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k, at = keys_from(blob, 0)
                parts_of = held.setdefault(shard, [])
                parts_of.append((k, counts_from(blob, at, len(k))[0]))
                if sum(len(x[0]) for x in parts_of) > 4 * TOKENS and len(parts_of) > 8:
                    held[shard] = [summed(*map(np.concatenate, zip(*parts_of, strict=True)))]
        for shard, parts_of in held.items():
            k, c = summed(*map(np.concatenate, zip(*parts_of, strict=True)))
            put_file(path := f"{folder}/1-{shard}", EliasFano.of(k, 1 << 64).to_bytes() + c.astype("<u8").tobytes())
            many = np.flatnonzero(c > often)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (str(int(k[0])), len(k), path, int(c.sum()), many.tolist(), c[many].tolist())], ["first", "n", "path", "total", "places", "often"])

    rows = docs.mapInArrow(count, "shard int, blob binary").repartitionById(shards, F.col("shard"))
    rows = rows.mapInArrow(build, "first string, n bigint, path string, total bigint, places array<bigint>, often array<bigint>").collect()
    return sorted(rows, key=lambda r: int(r.first))


def cut_points(rows: list, words: int, files: int) -> tuple[int, ...]:
    """Bigram keys that cut the tokens into about equal files: by word, and within a frequent word by what follows it."""
    ends, mass, base = [0], [0.0], 0
    for r in rows:
        plain = (r.total - sum(r.often)) / max(r.n - len(r.places), 1)
        at = base
        for place, often in zip(r.places, r.often, strict=True):
            ends += [(base + place) * words, (base + place + 1) * words]
            mass += [mass[-1] + plain * (base + place - at), mass[-1] + plain * (base + place - at) + often]
            at = base + place + 1
        base += r.n
        ends.append(base * words)
        mass.append(mass[-1] + plain * (base - at))
    return tuple(sorted({int(x) for x in np.interp(np.arange(1, files) * (mass[-1] / files), mass, [float(e) for e in ends])} - {0}))


def train(docs: DataFrame, a_file: int = TOKENS_A_FILE, block_size: int = TOKENS) -> tuple:
    """Builds the trie of docs (text), every n-gram up to three words, and returns what `opened` takes.

    Null and empty texts count as an end alone. Repeated rows count each time; an empty table gives a
    model in which every probability is 1. Two passes over the texts: words, then bigrams and trigrams.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select("text")
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = vocabulary(docs, folder, max(1, size // 7 // a_file + 1), a_file // SPREAD)  # some seven bytes a token
    words, tokens = tuple((int(r.first), r.n, r.path) for r in rows), sum(r.total for r in rows)
    total = sum(r.n for r in rows)
    if not total:
        return (), (), (), 0
    if total >> 32:
        raise ValueError("over 2**32 words: bigram keys pass 64 bits")
    cuts = cut_points(rows, total, -(-tokens // a_file))
    below = (words, cuts, (), tokens)

    def count(batches):
        trie = opened(*below)
        limits = trie.cuts
        for b in pieces(batches):
            hashes, first = tokens_of(b.column(0))
            local, distinct, end = numbered(hashes)
            number = trie.known(distinct, shares=False)[0].astype(U64)
            for block, _ in blocks(local, first, end, len(distinct), block_size):
                yield from counted(block, number, limits)

    def counted(block: Block, number: np.ndarray, limits: np.ndarray):
        n = len(block.left)
        place = np.empty(len(block.word), np.int64)
        place[block.order] = block.rank
        own = np.ones(len(block.word), np.int64)
        own[: block.lead] = 0  # it was counted in the block before
        times = np.add.reduceat(own[block.order], block.first)
        at = np.flatnonzero(~block.start[1:]) + 1
        third = np.sort(place[at - 1].astype(U64) << U64(block.width) | block.word[at].astype(U64))
        first = runs(third)
        third, times3 = third[first], np.diff(np.append(first, len(third)))
        second = number[block.left] * U64(total) + number[block.right]
        rank = (third >> U64(block.width)).astype(np.int64)
        third_word = number[(third & U64((1 << block.width) - 1)).astype(np.int64)]
        for i, s, e in parts(np.searchsorted(limits, second, "right")):
            s3, e3 = np.searchsorted(rank, (s, e))
            blob = keys_to_bytes(second[s:e]) + counts_to_bytes(times[s:e]) + keys_to_bytes((rank[s3:e3] - s).astype(U64) * U64(total) + third_word[s3:e3]) + counts_to_bytes(times3[s3:e3])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

    def merged(blobs: list) -> tuple:
        """(bigram keys, counts, trigram keys by the bigram's place, counts) of several such parts."""
        keys = np.concatenate([b[0] for b in blobs])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = runs(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        counts = np.add.reduceat(np.concatenate([b[1] for b in blobs])[order], first)
        del order
        third, before = [], 0
        for b in blobs:
            row = (b[2] // U64(total)).astype(np.int64)
            third.append(place[before + row].astype(U64) * U64(total) + (b[2] - row.astype(U64) * U64(total)))
            before += len(b[0])
        return keys[first], counts, *summed(np.concatenate(third), np.concatenate([b[3] for b in blobs]))

    def unpacked(blob: bytes) -> tuple:
        keys, at = keys_from(blob, 0)
        counts, at = counts_from(blob, at, len(keys))
        third, at = keys_from(blob, at)
        return keys, counts, third, counts_from(blob, at, len(third))[0]

    def build(batches):
        held: dict[int, list] = {}
        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blobs = held.setdefault(shard, [])
                blobs.append(unpacked(blob))
                if len(blobs) > 1 and sum(len(x[2]) for x in blobs[1:]) > a_file // 2:
                    held[shard] = [merged(blobs)]
        while held:
            shard, blobs = held.popitem()
            second, n2, third, n3 = merged(blobs)
            del blobs
            context = (second // U64(total)).astype(np.int64)
            first, span = int(context[0]), int(context[-1] - context[0]) + 1
            low = (total - 1).bit_length()
            ids = EliasFano.of(second - U64(first * total), span * total, low).to_bytes()
            pointers = EliasFano.of(np.concatenate(([0], np.cumsum(np.bincount(context - first, minlength=span)))).astype(U64), len(second) + 1).to_bytes()
            follow = np.bincount((third // U64(total)).astype(np.int64), minlength=len(second))
            ids3 = EliasFano.of(third, len(second) * total, low).to_bytes()
            pointers3 = EliasFano.of(np.concatenate(([0], np.cumsum(follow))).astype(U64), len(third) + 1).to_bytes()
            put_file(path := f"{folder}/2-{shard}", np.array([first], U64).tobytes() + ids + pointers + ids3 + pointers3)
            put_file(f"{folder}/counts/2-{shard}", counts_to_bytes(n2) + counts_to_bytes(n3))
            tally = [int((n == k).sum()) for n in (n2, n3) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, path, first, first + span, tally)], ["shard", "path", "first", "after", "tally"])

    made = docs.mapInArrow(count, "shard int, blob binary").repartitionById(len(cuts) + 1, F.col("shard"))
    made = sorted(made.mapInArrow(build, "shard bigint, path string, first bigint, after bigint, tally array<bigint>").collect())
    keep = [r.shard for r in made]  # a range without bigrams has no file
    model = (words, tuple(cuts[i - 1] for i in keep[1:]), tuple(r.path for r in made), tokens)
    tally = np.array([r.tally for r in made]).sum(axis=0)
    off = [once / (once + 2 * twice) if once and twice else 0.5 for once, twice in tally.reshape(2, 2).tolist()]
    bounds = np.cumsum([0, *(w[1] for w in words)]).tolist()
    tasks = [(w[2], b, e, [r.path for r in made if r.first < e and r.after > b]) for w, b, e in zip(words, bounds[:-1], bounds[1:], strict=True)]
    tasks += [(r.path, -1, -1, []) for r in made]

    def smooth(batches):
        trie = opened(*model)
        for b in batches:
            for path, begin, end, others in zip(*(c.to_pylist() for c in b.columns), strict=True):
                put_file(f"{path}.p", word_shares(path, begin, end, others) if begin >= 0 else gram_codes(path, trie))
            yield b.slice(0, 0).select(["path"])

    def word_shares(path: str, begin: int, end: int, others: list[str]) -> bytes:
        follow = np.zeros(end - begin)
        for other in others:
            first, _, pointers, _, _ = read_grams(other)
            own = np.diff(pointers.values().astype(np.int64))
            a, z = max(begin, first), min(end, first + len(own))
            follow[a - begin : z - begin] += own[a - first : z - first]
        return codes_to_bytes(quantised(np.where(follow > 0, off[0] * follow / read_words(path)[1], 1)))

    def gram_codes(path: str, trie: Trie) -> bytes:
        first, ids, pointers, ids3, pointers3 = read_grams(path)
        memory = map_file(path.replace("/2-", "/counts/2-"))
        n2, at = counts_from(memory, 0, ids.n)
        n3, _ = counts_from(memory, at, ids3.n)
        every = lambda of, each: np.repeat(of, each)
        follow, follow3 = (np.diff(p.values().astype(np.int64)) for p in (pointers, pointers3))
        whole = trie.counts(first + np.arange(len(follow)))  # each word but the end is followed by something, and the end begins each text
        own = quantised((n2 - off[0]) / every(whole, follow))
        share = quantised(np.where(follow3 > 0, off[1] * follow3 / n2, 1))
        return codes_to_bytes(own, share, quantised((n3 - off[1]) / every(n2, follow3)))

    jobs = spark.createDataFrame(list(enumerate(tasks)), "i int, t struct<path:string,begin:bigint,end:bigint,others:array<string>>")
    jobs.select("i", "t.*").repartitionById(len(tasks), F.col("i")).drop("i").mapInArrow(smooth, "path string").collect()
    remove(spark, f"{folder}/counts")
    return model


def probabilities(trie: Trie, block: Block, number: np.ndarray, share: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The model's probability of each of the block's tokens; number, share, lower: of the distinct words."""
    left, right, words = block.left, block.right, trie.vocabulary
    own, share3, place = np.zeros(len(left)), np.ones(len(left)), np.full(len(left), -1, np.int64)
    asked = np.flatnonzero((number[left] >= 0) & (number[right] >= 0))
    key = number[left[asked]].astype(U64) * U64(words) + number[right[asked]].astype(U64)
    file = np.searchsorted(trie.cuts, key, "right") if len(trie.grams.paths) else np.zeros(len(key), np.int64)
    for i, s, e in parts(file):
        first, ids, pointers, _, _ = trie.grams[i]
        codes, shares, _ = trie.codes[i]
        row = number[left[asked[s:e]]] - first
        inside = np.flatnonzero((row >= 0) & (row < pointers.n - 1))
        at, hit = find(ids, pointers, row[inside], words, number[right[asked[s:e][inside]]])
        at, which = at[hit], asked[s:e][inside[hit]]
        own[which], share3[which], place[which] = POWERS[codes[at]], POWERS[shares[at]], at
    p = np.empty(len(block.word))
    second = own + share[left] * lower[right]
    p[block.order] = second[block.rank]
    # trigrams in the order of the bigrams that they begin with: file by file, contexts ascending
    of = np.full(len(left), -1, np.int64)
    of[asked] = file
    follows = block.order + 1
    rank = block.rank
    fine = np.flatnonzero((follows < len(block.word)) & (place[rank] >= 0))
    fine = fine[~block.start[follows[fine]]]
    follows, rank = follows[fine], rank[fine]
    own = np.zeros(len(follows))
    word = number[block.word[follows]]
    for i, s, e in parts(of[rank]):
        _, _, _, ids, pointers = trie.grams[i]
        codes = trie.codes[i][2]
        some = np.flatnonzero(word[s:e] >= 0)
        at, hit = find(ids, pointers, place[rank[s:e][some]], words, word[s:e][some])
        own[s + some[hit]] = POWERS[codes[at[hit]]]
    p[follows] = own + share3[rank] * p[follows]
    return p


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), block_size: int = TOKENS) -> DataFrame:
    """(id, kept columns, n_tokens, n_known, train_tokens, base_score, score) of each row, repeated rows included.

    A null or empty text is one token, the end. With a model of no tokens at all every probability is 1
    (score 0). Null ids stay null; other columns play no part; an empty table gives an empty table.
    """
    ready(docs.sparkSession)
    kept = [f"_keep{i}" for i in range(len(keep))]  # whatever names the kept columns have
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = ", ".join([f"id {kind}", *(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep, strict=True))])
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(k) for k, c in zip(kept, keep, strict=True)], F.col(text_col).alias("text"))
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        trie = opened(*model)
        for b in pieces(batches):
            hashes, first = tokens_of(b.column(b.num_columns - 1))
            local, distinct, end = numbered(hashes)
            number, count, share = trie.known(distinct)
            lower = trie.unigram(count)
            p = np.empty(len(local))
            for block, a in blocks(local, first, end, len(distinct), block_size):
                p[a : a + len(block.word) - block.lead] = probabilities(trie, block, number, share, lower)[block.lead :]
            add = lambda x: pa.array(np.add.reduceat(x, first[:-1]))
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n), add((count > 0)[local].astype(np.int64)), pa.array(np.full(len(n), trie.tokens)), add(np.log10(lower)[local]), add(np.log10(p))], [*b.schema.names[:-1], *names])

    out = rows.mapInArrow(run, f"{kinds}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], *names)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from rows whose crc32 of the id leaves 0, 1, 3, 4, 5 or 6 (null ids too) and scores all."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
    ready(spark)
    return score(docs, train(docs.where(~F.col("held_out"))), keep=("held_out",))
