"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are rounded to integers. The top of the tree lies over the table: centres from a bounded sample,
every vector with its nearest one, each such part with its covering radius. A query's k-th best score
among some vectors of its own part bounds what it can still need; it goes on only to the parts whose
centre and radius allow a score that high. Parts are cut into blocks, every vector is in one block, and
only queries travel.

In a block the vectors form a cover tree, in which a node's children have centres that are spread apart
by half its radius and cover its rows within that (or as far as CHILDREN centres reach); the covering
radius of each node is measured. The queries that come to a block form trees of the same kind, and both
are descended together: a pair of nodes is left when centres, norms and covering radii bound every score
between them below the worst k-th score of the query node's queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from polyquery.llm.shared import documents, ready, staged

LEAF, CHILDREN = 128, 16
LEAST = -(1 << 62)  # below every score
BLOCK = 2048  # vectors of a block
QUERIES = 1024  # queries that a task holds at once
SAMPLE, PARTS = 4096, 1024  # vectors that centres are chosen from, and the most centres


class CoverTree:
    """Nodes in arrays, parents before children. A node covers the rows order[begin:end] within radius of its centre."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        n = len(points)
        self.order = np.arange(n)
        self.centre, self.radius, self.begin, self.end, self.children = [], [], [], [], []
        if n:
            self.grow(0, n)
        self.radius = np.array(self.radius)
        self.norm = np.sqrt((points.astype(float) ** 2).sum(axis=1)) if n else np.zeros(0)

    def grow(self, begin: int, end: int) -> int:
        rows = self.order[begin:end]
        own = self.points[rows].astype(float)
        middle = int(np.argmin(((own - own.mean(axis=0)) ** 2).sum(axis=1)))
        far = np.sqrt(((own - own[middle]) ** 2).sum(axis=1))
        here = len(self.centre)
        self.centre.append(int(rows[middle]))
        self.radius.append(float(far.max()))
        self.begin.append(begin)
        self.end.append(end)
        self.children.append([])
        if end - begin <= LEAF or far.max() == 0:
            return here
        # centres more than half the radius apart, each row with its nearest: the next level of the cover
        apart, nearest, of = far.max() / 2, far.copy(), np.zeros(len(rows), np.int64)
        count = 1
        while nearest.max() > apart and count < CHILDREN:
            far_one = int(np.argmax(nearest))
            d = np.sqrt(((own - own[far_one]) ** 2).sum(axis=1))
            closer = d < nearest
            of[closer], nearest[closer] = count, d[closer]
            count += 1
        if count == 1:
            return here
        sort = np.argsort(of, kind="stable")
        self.order[begin:end] = rows[sort]
        sizes = np.bincount(of, minlength=count)
        at = begin
        for size in sizes[sizes > 0].tolist():
            self.children[here].append(self.grow(at, at + size))
            at += size
        return here


def largest(points: np.ndarray) -> int:
    return max(int(points.max()), -int(points.min())) if points.size else 0


def dual_search(queries: CoverTree, data: CoverTree, ids: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), at most k for each query, best first and ties by id, filled up with (LEAST, -1).

    own: each query's id, which isn't among its answers. bound: a score that each query's k-th is known to
    reach. Products are exact: in double where no sum can pass 2**53, else in 64-bit whole numbers; scores
    that could pass 2**62 are an error.
    """
    nq, n = len(queries.points), len(data.points)
    best, found = np.full((nq, k), LEAST), np.full((nq, k), -1, np.int64)
    if not nq or not n:
        return best, found
    most = largest(queries.points) * largest(data.points) * queries.points.shape[1]
    if most >> 62:
        raise ValueError("scores could pass 62 bits: use a smaller scale")
    kind = float if most < 1 << 53 else np.int64
    exact_q, exact_x = queries.points.astype(kind), data.points.astype(kind)
    q, x = exact_q.astype(float), exact_x.astype(float)
    kth = bound.copy()
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        group = queries.order[queries.begin[a] : queries.end[a]]
        ca, cb = queries.centre[a], data.centre[b]
        reach = queries.radius[a] * data.norm[cb] + data.radius[b] * (queries.norm[ca] + queries.radius[a])
        above = q[ca] @ x[cb] + reach
        if above + 1 + 1e-9 * (reach + queries.norm[ca] * data.norm[cb]) < kth[group].min():
            continue
        left, right = queries.children[a], data.children[b]
        if not left and not right:
            rows = data.order[data.begin[b] : data.end[b]]
            scores = (exact_q[group] @ exact_x[rows].T).astype(np.int64)
            hit = (scores >= kth[group][:, None]) & (own[group][:, None] != ids[rows][None, :])
            r, c = np.nonzero(hit)
            if len(r):
                at = group[r]
                those = np.unique(at)
                who = np.concatenate((np.repeat(those, k), at))
                score, which = np.concatenate((best[those].ravel(), scores[r, c])), np.concatenate((found[those].ravel(), ids[rows[c]]))
                order = np.lexsort((which, -score, who))
                first = np.searchsorted(who[order], those)[:, None] + np.arange(k)
                best[those], found[those] = score[order][first], which[order][first]
                kth[those] = np.maximum(kth[those], best[those, k - 1])
        elif right and (not left or data.radius[b] >= queries.radius[a]):
            # the most promising part is looked at first: pushed last
            promise = x[[data.centre[c] for c in right]] @ q[ca] + data.radius[right] * queries.norm[ca]
            stack += [(a, right[i]) for i in np.argsort(promise)]
        else:
            stack += [(c, b) for c in left]
    return best, np.where(best > LEAST, found, -1)


def whole(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): vectors as whole numbers floor(scale * x); without null vectors and null, NaN or infinite components."""
    x = F.col(vector_col)
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))
    return df.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def centres_of(sample: np.ndarray, count: int, rounds: int = 3) -> np.ndarray:
    """`count` centres: rows of the sample, moved to the mean of those nearest to them."""
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)].astype(float)
    for _ in range(rounds):
        of, _ = nearest(sample.astype(float), centres)
        size = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        centres[size > 0] = sums[size > 0] / size[size > 0][:, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre of each point, its distance rounded up a little)."""
    of = np.empty(len(points), np.int64)
    for s in range(0, len(points), QUERIES):
        of[s : s + QUERIES] = ((centres**2).sum(axis=1) - 2 * points[s : s + QUERIES] @ centres.T).argmin(axis=1)
    far = np.sqrt(((points - centres[of]) ** 2).sum(axis=1)) if len(points) else np.zeros(0)
    return of, far * (1 + 1e-9)


def dims(batch: pa.RecordBatch, at: int):
    """(dimension, rows, points) for each dimension of a batch."""
    size = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield d, rows, matrix(batch.column(at).take(pa.array(rows)), d)


ASKED = "id bigint, copy bigint, v array<bigint>, dim int, part int, sub int, bound bigint"


def dealt(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows (id, copy, v) with dimension, part, and distance from the part's centre (the origin where the sample has none)."""

    def run(batches):
        for b in batches:
            part, dim, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for d, at, points in dims(b, 2):
                part[at], far[at] = nearest(points.astype(float), centres.get(d, np.zeros((1, d))))
                dim[at] = d
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dim), pa.array(part), pa.array(far)], ["id", "copy", "v", "dim", "part", "far"])

    return rows.select("id", "copy", "v").mapInArrow(run, "id bigint, copy bigint, v array<bigint>, dim int, part int, far double")


def met(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, copy, id, score): the best k that each block of vectors has for each query that comes to it."""
    key = ["dim", "part", "sub", "side"]
    rows = vectors.select("id", F.lit(0).cast("bigint").alias("copy"), "v", "dim", "part", "sub", F.lit(None).cast("bigint").alias("bound"), F.lit(0).alias("side"))
    rows = rows.unionByName(asked.select("id", "copy", "v", "dim", "part", "sub", "bound", F.lit(1).alias("side")))
    rows = rows.repartition(*key[:3]).sortWithinPartitions(*key)

    def answers(held: list, tree: CoverTree, ids: np.ndarray, dim: int):
        t = pa.Table.from_batches(held).combine_chunks()
        own, copy = t.column("id").to_numpy(), t.column("copy").to_numpy()
        bound = t.column("bound").fill_null(LEAST).to_numpy()
        scores, found = dual_search(CoverTree(matrix(t.column("v").combine_chunks(), dim)), tree, ids, own, k, bound)
        row, col = np.nonzero(scores > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(copy[row]), pa.array(found[row, col]), pa.array(scores[row, col])], ["query", "copy", "id", "score"])

    def run(batches):
        block, held, tree, ids = None, [], None, None  # held: the block's vectors, then queries that wait
        for b in batches:
            cols = np.stack([b.column(b.schema.names.index(c)).to_numpy() for c in key])
            cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e == s:
                    continue
                *at, side = cols[:, s].tolist()
                if at != block:
                    if tree is not None and held:
                        yield from answers(held, tree, ids, block[0])
                    block, held, tree = at, [], None
                if side == 1 and tree is None:
                    t = pa.Table.from_batches(held, b.schema).combine_chunks()
                    ids = t.column("id").to_numpy()
                    tree, held = CoverTree(matrix(t.column("v").combine_chunks(), at[0]) if len(t) else np.zeros((0, at[0]), np.int64)), []
                for i in range(s, e, QUERIES):
                    held.append(b.slice(i, min(QUERIES, e - i)))
                    if side == 1 and sum(x.num_rows for x in held) >= QUERIES:
                        yield from answers(held, tree, ids, at[0])
                        held = []
        if tree is not None and held:
            yield from answers(held, tree, ids, block[0])

    return rows.mapInArrow(run, "query bigint, copy bigint, id bigint, score bigint")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to the smaller id; a row's own id is not among them.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids; a query
    meets the vectors of its own dimension only. Of rows with equal ids each counts on its own. Fewer than
    k candidates give all; empty tables give an empty table; other columns play no part. Scores are exact
    up to 62 bits and an error beyond. Centres come from SAMPLE vectors at most, those with the lowest hashed ids; they
    decide how much is looked at, never what is found.
    """
    spark = vectors.sparkSession
    ready(spark)
    data = whole(vectors, id_col, vector_col, scale).withColumn("copy", F.lit(0).cast("bigint"))
    asked = whole(queries, id_col, vector_col, scale).withColumn("copy", F.row_number().over(W.partitionBy("id").orderBy("v")).cast("bigint"))
    sample = [np.array(r[0], np.int64) for r in data.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").collect()]
    count = min(PARTS, -(-data.count() // BLOCK))
    centres = {}
    for d in {len(v) for v in sample}:
        own = np.array([v for v in sample if len(v) == d])
        centres[d] = centres_of(own, max(1, count * len(own) // len(sample)))
    data = staged(dealt(data, centres), "vectors")
    stats = {(r.dim, r.part): r for r in data.groupBy("dim", "part").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # PARTS rows, and one for each dimension that the sample lacks
    subs = {p: -(-r.n // BLOCK) for p, r in stats.items()}
    sizes = spark.createDataFrame([(*p, n) for p, n in subs.items()], "dim int, part int, subs int")
    data = data.join(F.broadcast(sizes), ["dim", "part"]).withColumn("sub", F.pmod(F.xxhash64("id", "v"), F.col("subs")).cast("int"))
    asked = staged(dealt(asked, centres), "asked")

    def routed(batches):
        """Each query for each block of each part that may hold a score of its bound, but the one it has met."""
        for b in batches:
            v, own = b.column(2), b.column(4).to_numpy()
            bound = b.column(5).fill_null(LEAST).to_numpy()
            for d, at, points in dims(b, 2):
                mine = sorted(p for p in stats if p[0] == d)
                if not mine:
                    continue
                c = centres.get(d, np.zeros((1, d)))[[p[1] for p in mine]]
                far, norms = np.array([stats[p].far for p in mine]), np.sqrt((points.astype(float) ** 2).sum(axis=1))
                most = points.astype(float) @ c.T + norms[:, None] * far
                slack = 1 + 1e-9 * norms[:, None] * (far + np.sqrt((c**2).sum(axis=1)))
                row, col = np.nonzero(most + slack >= bound[at][:, None])
                blocks = np.array([subs[p] for p in mine])[col]
                row, col, sub = np.repeat(row, blocks), np.repeat(col, blocks), np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                part = np.array([p[1] for p in mine])[col]
                new = (sub > 0) | (part != own[at][row])
                row, part, sub = at[row[new]], part[new], sub[new]
                for s in range(0, len(row), 4 * QUERIES):
                    r = pa.array(row[s : s + 4 * QUERIES])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(r), b.column(1).take(r), v.take(r), pa.array(np.full(len(r), d, np.int32)), pa.array(part[s : s + 4 * QUERIES].astype(np.int32)), pa.array(sub[s : s + 4 * QUERIES].astype(np.int32)), b.column(5).take(r)], ["id", "copy", "v", "dim", "part", "sub", "bound"])

    best = W.partitionBy("query", "copy").orderBy(F.col("score").desc(), "id")
    start = staged(met(data.where("sub = 0"), asked.select("id", "copy", "v", "dim", "part", F.lit(0).alias("sub"), F.lit(None).cast("bigint").alias("bound")), k), "first")
    kth = start.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query").alias("id"), "copy", F.col("score").alias("bound"))
    bounded = asked.select("id", "copy", "v", "dim", "part").join(kth, ["id", "copy"], "left").select("id", "copy", "v", "dim", "part", "bound")
    more = met(data, bounded.mapInArrow(routed, ASKED), k)
    ranked = start.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


#: For DuckDB.
SQL = """
WITH v AS (
    SELECT vec_id::BIGINT AS vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


def op5_cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
