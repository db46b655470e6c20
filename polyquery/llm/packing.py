"""Packing by cutting-stock column generation.

Documents are cut into full sequences and one remainder each. The histogram of remainders (at most
`size` lengths, whatever the corpus) is the demand of a cutting-stock problem: a linear program over
patterns (multisets of lengths that fit one sequence), whose columns are priced by a knapsack dynamic
program under the duals. Rounded-down pattern counts and a best-fit of what is left become intervals
of ranks; each piece finds its sequence and offset from its rank among the pieces of its length.
Where documents have positions in a curriculum, their order is cut into parts that are packed one after
another, and ranks follow the positions, so that sequences come in the order of the documents they hold.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from polyquery.llm.pieces import IdEncoder
from polyquery.llm.shared import documents, ready, running, staged

PARTS = 8  # parts of a curriculum that are packed one after another
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


@lru_cache
def encoder(tokenizer: str) -> IdEncoder:
    return IdEncoder(tokenizer)


def cut(docs: DataFrame, tokenizer: str, size: int, end: int, id_col: str, text_col: str, position: Column) -> DataFrame:
    """Pieces of the id sequences: full ones of `size` ids, then the remainder, each with its document's position."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), position.cast("bigint").alias("position"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            which, rows = [], []
            for i, ids in enumerate(enc.ids(b.column(1).to_pylist())):
                whole = np.append(ids, end).astype("<u4")
                n, raw = len(whole), memoryview(whole).cast("B")
                for s in range(0, n, size):
                    m = min(size, n - s)
                    which.append(i)
                    rows.append((s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), n))
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(at := pa.array(which, pa.int64())), *map(pa.array, np.ascontiguousarray(cols)), b.column(2).take(at)], ["id", "start", "length", "ids_crc32", "doc_tokens", "position"])

    return docs.mapInArrow(run, f"id {kind}, {PIECE}, position bigint")


def knapsack(lengths: np.ndarray, worth: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most worth that fits `size`, each length as often as wanted, and how often each is taken."""
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    usable = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c], pick[c] = best[c - 1], -1
        if k := usable[c]:
            total = best[c - lengths[:k]] + worth[:k]
            j = int(np.argmax(total))
            if total[j] > best[c] + 1e-12:
                best[c], pick[c] = total[j], j
    took, c = np.zeros(len(lengths)), size
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            took[pick[c]] += 1
            c -= lengths[pick[c]]
    return best[size], took


def solved(square: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps on numpy rows (a threaded LAPACK can stall in a process that forks)."""
    m = len(square)
    both = np.hstack((square, np.eye(m)))
    for i in range(m):
        j = i + int(np.argmax(np.abs(both[i:, i])))
        both[[i, j]] = both[[j, i]]
        both[i] /= both[i, i]
        rest = both[:, i].copy()
        rest[i] = 0
        both -= rest[:, None] * both[i]
    return both[:, m:]


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def patterns(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 1e-3, most: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Column generation by the revised simplex method: (copies of each length, times) of the patterns used, rounded down.

    It stops when no pattern prices in, or within `gap` of the least number of sequences that the
    summed lengths allow, or after `most` columns (any stop leaves valid patterns, only more for the best fit).
    """
    m, b = len(lengths), demand.astype(float)
    basis = np.diag((size // lengths).astype(float))
    for i, j in zip(range(m), np.searchsorted(lengths, size - lengths).tolist(), strict=True):  # to begin with, pairs that fill a sequence
        if i < j < m and lengths[i] + lengths[j] == size:
            few, many = (i, j) if b[i] <= b[j] else (j, i)
            basis[[few, many], few] = 1
    inverse = solved(basis)
    x = np.maximum(times(inverse, b), 0)
    least = float((lengths * b).sum()) / size
    for step in range(most):
        if x.sum() <= least * (1 + gap):
            break
        dual = inverse.sum(axis=0)
        value, column = knapsack(lengths, dual, size)
        if value <= 1 + 1e-7:
            break
        move = times(inverse, column)
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * move, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        if step % 200 == 199:
            inverse = solved(basis)
            x = np.maximum(times(inverse, b), 0)
        else:
            row = inverse[out] / move[out]
            inverse -= move[:, None] * row
            inverse[out] = row
    copies = basis.astype(np.int64)
    used = np.floor(x + 1e-6).astype(np.int64)
    while ((over := times(copies, used) - demand) > 0).any():  # rounding noise only
        used[int(np.argmax(used * (copies[int(np.argmax(over))] > 0)))] -= 1
    return [(copies[:, j], int(used[j])) for j in range(m) if used[j]]


def best_fit(lengths: np.ndarray, left: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """What is left, into sequences: the longest first, each then filled with the longest that still fits."""
    out, left = [], left.copy()
    while left.any():
        room, took = size, np.zeros(len(lengths), np.int64)
        while len(fit := np.flatnonzero((left - took > 0) & (lengths <= room))):
            j = fit[-1]
            n = min(left[j] - took[j], room // lengths[j])
            took[j] += n
            room -= n * lengths[j]
        times = int(min(left[took > 0] // took[took > 0]))
        left -= took * times
        out.append((took, times))
    return out


def intervals(histogram: dict[int, int], size: int) -> tuple[dict[str, np.ndarray], int]:
    """Rank intervals: pieces of `length` with ranks from `first` on go to sequences from `sequence` on, in place `offset`;
    and the number of sequences.

    At most one row for each slot of each pattern; their number depends on `size`, not on the corpus.
    """
    lengths = np.array(sorted(n for n in histogram if n < size), np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    used = patterns(lengths, demand, size) if len(lengths) else []
    left = demand - sum((c * t for c, t in used), np.zeros(len(lengths), np.int64))
    used += best_fit(lengths, left, size)
    rows, rank, sequence = [(size, 0, 0, 0)], np.zeros(len(lengths), np.int64), histogram.get(size, 0)
    for copies, times in used:
        offset = 0
        for j in np.flatnonzero(copies):
            for _ in range(copies[j]):
                rows.append((int(lengths[j]), int(rank[j]), sequence, offset))
                rank[j] += times
                offset += int(lengths[j])
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "sequence", "offset"), np.array(rows, np.int64).T, strict=True)), sequence


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 0, grain: int = 4, id_col: str = "doc_id", text_col: str = "text", position: Column | None = None, rows: int = 0, parts: int = PARTS) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    A null or empty text is one piece that holds the end id alone. Repeated rows are packed each on its
    own; ties in rank are broken by id, start and checksum. A null id stays null. Other columns play no
    part. An empty table gives an empty table. Sequences are numbered from 0; pieces tile each from offset 0.
    Patterns are made of lengths rounded up to `grain`, which keeps the linear program small and costs
    less than `grain` ids of padding for each piece; offsets are of the true lengths.

    position: whole numbers from 0 to rows - 1 in the documents' order of training, if they have one; it is
    cut into `parts` equal ranges, and every sequence of a range comes before those of the next.
    """
    spark = docs.sparkSession
    ready(spark)
    pieces = staged(cut(docs, tokenizer, size, end, id_col, text_col, F.lit(0) if position is None else position), "pieces")
    parts = 1 if position is None else max(1, min(parts, rows // 1000))
    part = F.lit(0) if position is None else F.least(F.floor(F.col("position") * parts / max(rows, 1)), F.lit(parts - 1)).cast("int")
    pieces = pieces.withColumn("units", part * F.lit(size + 1) + F.ceil(F.col("length") / grain).cast("int"))
    histogram: dict[int, dict[int, int]] = {}
    for r in pieces.groupBy("units").count().collect():  # at most size / grain rows for each part
        histogram.setdefault(r[0] // (size + 1), {})[r[0] % (size + 1)] = r[1]
    table, before = {k: [] for k in ("length", "first", "sequence", "offset")}, 0
    for p in sorted(histogram):
        one, sequences = intervals(histogram[p], size // grain)
        for k, more in zip(table, (one["length"] + p * (size + 1), one["first"], one["sequence"] + before, one["offset"]), strict=True):
            table[k].append(more)
        before += sequences
    table = {k: np.concatenate(x) if x else np.zeros(0, np.int64) for k, x in table.items()}
    total = sum(n for h in histogram.values() for n in h.values())
    shift = 40
    keys = table["length"] << shift | table["first"]
    if total >> shift:
        raise ValueError(f"over 2**{shift} pieces")
    # equal rows share a hash: pieces of one document differ in start, and copies of a row are dealt by the tie order
    by, ties = F.xxhash64("id", "start", "ids_crc32"), [F.col("id"), F.col("start"), F.col("ids_crc32")]
    if position is None:
        ranked = running(pieces, ["units"], by, ties, F.lit(1), "rank", rows=total)
    else:
        ranked = running(pieces, ["units"], F.col("position"), [F.col("position"), *ties], F.lit(1), "rank", rows=rows, ordered=True)

    def place(batches):
        for b in batches:
            units, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            at = np.searchsorted(keys, units << shift | rank, "right") - 1
            more = [pa.array(table["sequence"][at] + rank - table["first"][at]), pa.array(table["offset"][at])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *more], [*b.schema.names[:5], "sequence_id", "slot"])

    kind = pieces.schema["id"].dataType.simpleString()
    placed = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", F.col("units").cast("bigint"), "rank").mapInArrow(place, f"id {kind}, {PIECE}, sequence_id bigint, slot bigint")
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)  # at most `size` rows
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot").withColumnRenamed("id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
