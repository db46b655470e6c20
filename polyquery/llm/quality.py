"""Text quality by a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees over the bins of one feature are boosted in turn,
feature after feature, and add up to a lookup table for each feature; then trees over the bins of two
features do the same for the pairs that explain most of what is left. A score is the sum of the tables'
entries at a text's bins, through the logistic function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquery.llm.shared import documents, ready
from polyquery.llm.words import LOWER, chunks, find_words, span_hashes, text_bytes

TRAIN_ROWS = 20_000  # the bounded sample of labelled rows that a model is fitted to

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "sign", "stop", "line", "new_words", "same_as_last", "same_as_second", "bang", "bar", "beyond_ascii", "sign_ended")


def class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGITS, SIGN, STOP = class_table(bytes(range(65, 91))), class_table(b"0123456789"), class_table(b"#$%&*+/<=>@\\^_`{|}~[]!"), class_table(b".,;:?")
BEYOND = class_table(bytes(range(128, 256)))


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; an empty or null text has zeros."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for a, b in chunks(offsets):
        out[a:b] = some_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def some_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)

    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    starts, ends, first = find_words(data, offsets)
    words = np.diff(first)
    hashes = span_hashes(LOWER[data], starts, ends)
    doc = np.repeat(np.arange(n), words)
    last, second = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    last[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    second[2:] = (hashes[2:] == hashes[:-2]) & (doc[2:] == doc[:-2])
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    signed = SIGN[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    return np.stack(
        (
            np.log1p(size),
            np.log1p(words),
            (size - total(data == 0x20, offsets)) / per_word,
            total(UPPER[data], offsets) / per_byte,
            total(DIGITS[data], offsets) / per_byte,
            total(SIGN[data], offsets) / per_byte,
            total(STOP[data], offsets) / per_byte,
            total(data == 0x0A, offsets) / per_word,
            total(new, first) / per_word,
            total(last, first) / per_word,
            total(second, first) / per_word,
            total(data == 0x21, offsets) / per_byte,
            total(data == 0x7C, offsets) / per_byte,
            total(BEYOND[data], offsets) / per_byte,
            total(signed, first) / per_word,
        ),
        axis=1,
    )


@dataclass
class AdditiveModel:
    cuts: list[np.ndarray]  # bin bounds of each feature
    coarse: list[np.ndarray]  # the pairs' bin of each bin
    start: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        at = self.bins(x)
        margin = self.start + sum((t[b] for t, b in zip(self.tables, at, strict=True)), np.zeros(len(x)))
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            margin = margin + grid[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return 1 / (1 + np.exp(-margin))


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bin) of the best cut of ordered bins; bins below it go left."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def line_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A tree over one feature's bins: its value at each bin."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    while len(parts) < leaves:
        options = [(*best_split(g[s:e], h[s:e]), s, e) for s, e in parts if e - s > 1]
        if not options or max(options)[0] <= 1e-9:
            break
        _, k, s, e = max(options)
        parts.remove((s, e))
        parts += [(s, s + k), (s + k, e)]
    for s, e in parts:
        out[s:e] = g[s:e].sum() / (h[s:e].sum() + 1)
    return out


def grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of two levels over a pair's bins, the first cut along either feature: its values and its gain."""
    best, gain = np.zeros_like(g), 0.0
    for axis in (0, 1):
        if g.shape[axis] < 2:
            continue
        gain1, k = best_split(g.sum(axis=1 - axis), h.sum(axis=1 - axis))
        total, values = gain1, np.zeros_like(g)
        for part in (slice(0, k), slice(k, None)):
            where = (part, slice(None)) if axis == 0 else (slice(None), part)
            line_g, line_h = g[where].sum(axis=axis), h[where].sum(axis=axis)
            if len(line_g) > 1:
                gain2, c = best_split(line_g, line_h)
                total += gain2
                for sub in (slice(0, c), slice(c, None)):
                    cell = (part, sub) if axis == 0 else (sub, part)
                    values[cell] = line_g[sub].sum() / (line_h[sub].sum() + 1)
            else:
                values[where] = line_g.sum() / (line_h.sum() + 1)
        if total > gain:
            best, gain = values, total
    return best, gain


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, grid: int = 8, rounds: int = 200, pairs: int = 6, pair_rounds: int = 60, rate: float = 0.1) -> AdditiveModel:
    """Cyclic boosting of line trees for each feature, then of grid trees for the best pairs. Without rows every score is 1/2."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    coarse = [np.arange(len(c) + 1) * grid // max(len(c) + 1, grid) for c in cuts]
    rate_1 = (y.sum() + 0.5) / (n + 1)
    model = AdditiveModel(cuts, coarse, float(np.log(rate_1 / (1 - rate_1))), [np.zeros(len(c) + 1) for c in cuts], [], [])
    if not n or y.min() == y.max():
        return model
    at = model.bins(x)
    margin = np.full(n, model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * line_tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size))
            model.tables[j] += step
            margin += step[at[j]]
    g, h = slopes()
    shape = [int(c.max()) + 1 for c in coarse]
    cell = lambda i, j: coarse[i][at[i]] * shape[j] + coarse[j][at[j]]
    sums = lambda i, j, v: np.bincount(cell(i, j), v, shape[i] * shape[j]).reshape(shape[i], shape[j])
    gains = sorted(((grid_tree(sums(i, j, g), sums(i, j, h))[1], i, j) for i in range(k) for j in range(i + 1, k)), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:pairs]]
    model.grids = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    cells = [cell(i, j) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for m, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * grid_tree(sums(i, j, g), sums(i, j, h))[0]
            model.grids[m] += step
            margin += step.ravel()[cells[m]]
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """Fits to at most `most` labelled rows, those whose ids hash lowest. Null labels, and labels of no document, teach nothing.

    Of an id that is labelled twice the lowest label counts, of an id that documents repeat the row whose text
    hashes lowest, so that the sample stays within its bound. Empty tables give a model that scores 1/2.
    """
    ready(docs.sparkSession)
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sample = sample.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most `most` ids

    def run(batches):
        for b in batches:
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), b.column(1), b.column(3)], ["id", "x", "label", "mark"])

    rows = found.select("id", "label", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, x array<double>, label int, mark bigint")
    rows = rows.groupBy("id").agg(F.min(F.struct("mark", "x", "label")).alias("r")).select("r.x", "r.label").toPandas()
    x = np.array(rows["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows["label"].to_numpy()))  # the fit doesn't depend on the order in which tasks end
    return fit(x[order], rows["label"].to_numpy(float)[order])


def score(docs: DataFrame, model: AdditiveModel, least: float, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, score, predicted) of each row, repeated rows included; null and empty texts score too.

    Null ids stay null; other columns play no part, whatever their names; an empty table gives an empty table.
    """
    ready(docs.sparkSession)
    kept = [f"_keep{i}" for i in range(len(keep) + 1)]
    rows = docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(k) for k, c in zip(kept, (id_col, *keep), strict=True)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches):
        for b in batches:
            p = model.score(features(b.column(0)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p, pa.float64()), pa.array((p >= least).astype(np.int32))], [*b.schema.names[1:], "score", "predicted"])

    out = rows.mapInArrow(run, f"{kinds}, score double, predicted int")
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, (id_col, *keep), strict=True)], "score", "predicted")


def good(docs: DataFrame, model: AdditiveModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score `least` or more, with all their columns as they are."""
    ready(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32 of the id modulo 5 isn't 0 and scores all documents, each row by itself; a null id isn't held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = documents(spark, sf_dir)
    model = train(docs, documents(spark, sf_dir, "labels").where(~held))
    return score(docs.select("doc_id", "text", held.alias("held_out")), model, 0.3, keep=("held_out",))
