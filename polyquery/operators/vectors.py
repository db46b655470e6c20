"""Exact and approximate nearest vectors."""

from __future__ import annotations

import base64
import hashlib
import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyquery.operators.cut import cut

BROADCAST_QUERIES, BLOCK_BYTES = 10_000, 1 << 19


def metric_of(name: str | None) -> str:
    """dot, l2 or, by default, cosine."""
    return {"dot": "dot", "dot_product": "dot", "dotproduct": "dot", "l2": "l2", "euclidean": "l2"}.get((name or "").lower(), "cosine")


def summed(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return summed(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def shortest(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def distance(a: Column, b: Column, metric: str = "cosine", checked: bool = True) -> Column:
    """Ascending: 1 - cosine (a zero vector has cosine 0), minus the inner product, or the Euclidean distance.
    Vectors of unequal length are compared up to the shorter one unless checked."""
    if not checked:
        a, b = shortest(a, b)
    kind = metric_of(metric)
    if kind == "dot":
        return -dot(a, b)
    if kind == "l2":
        return F.sqrt(summed(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))


def constant(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def top_k(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """rows (id, vector, ...) with distance and score, the k nearest; ties by id. The filter runs before any distance."""
    if k <= 0:
        return rows.withColumns({"distance": F.lit(0.0), "score": F.lit(0.0)}).limit(0)
    d = distance(F.col("vector"), constant(query), metric)
    if where is not None:
        rows = rows.where(where)
    near = rows.where(F.size("vector") == len(query)).withColumn("distance", d)
    score = 1 - F.col("distance") if metric_of(metric) == "cosine" else -F.col("distance")
    return near.withColumn("score", score).orderBy("distance", "id").limit(k)


def tame(v: Column) -> Column:
    """Vectors whose sums of products neither overflow nor vanish, without null or non-finite components."""
    size = lambda x: F.abs(x.cast("double"))
    inside = F.forall(v, lambda x: x.isNotNull() & (size(x) <= 1e100))
    return F.coalesce((F.size(v) > 0) & inside & (F.exists(v, lambda x: size(x) >= 1e-100) | F.forall(v, lambda x: size(x) == 0)), F.lit(False))


def blocks(rows: DataFrame, vector: str) -> DataFrame:
    """(seq, dim, vectors, rest): up to BLOCK_BYTES of equally long vectors as doubles, and the rows' other columns as an Arrow
    stream. Row i of a block has the number seq + i, which ascends with the partition and the place in it."""
    import pyarrow as pa

    rows = rows.withColumn(vector, F.col(vector).cast("array<double>"))
    at = rows.columns.index(vector)

    def run(batches):
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 40
        for b in batches:
            lists = b.column(at)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            rest = b.select([n for n in b.schema.names if n != vector])
            for dim in np.unique(dims).tolist():
                which = np.flatnonzero(dims == dim)
                step = max(1, BLOCK_BYTES // (8 * dim))
                for i in range(0, len(which), step):
                    some = pa.array(which[i : i + step])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rest.schema) as out:
                        out.write_batch(rest.take(some))
                    data = lists.take(some).flatten().to_numpy(zero_copy_only=False).astype(float).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([dim], pa.int32()), pa.array([data], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["seq", "dim", "vectors", "rest"])
                    seq += len(some)

    return rows.mapInArrow(run, "seq bigint, dim int, vectors binary, rest binary")


def in_turn(products) -> np.ndarray:
    """The sum of arrays one after another, rounded as `summed` rounds."""
    total = 0.0
    for p in products:
        total = total + p
    return total


class Nearest:
    """The k nearest rows so far of each query of a block: a matrix product rules rows out with room for its rounding, and
    distances of those left are summed component by component as `distance` does. Ties go to the lower number."""

    def __init__(self, queries: np.ndarray, names, k: int, kind: str) -> None:
        self.q, self.names, self.k, self.kind = queries, names, k, kind
        self.turned = np.ascontiguousarray(queries.T)
        self.square = in_turn(x * x for x in self.turned)
        self.of, self.far, self.seq, self.rest = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), None
        self.worst = np.full(len(queries), np.inf)

    def meet(self, seq: int, x: np.ndarray, rest) -> None:
        import pyarrow as pa

        turned = np.ascontiguousarray(x.T)
        square = in_turn(v * v for v in turned)
        about, room = self.about(x, square)
        limit = (self.worst**2 if self.kind == "l2" else self.worst) + room
        if len(x) > self.k and (fresh := np.flatnonzero(np.isinf(limit))).size:
            limit[fresh] = np.partition(about[fresh], self.k - 1, axis=1)[:, self.k - 1] + 2 * room[fresh]
        near = about <= limit[:, None]
        if len(x) > self.k and np.count_nonzero(near) > 16 * self.k * len(self.q):
            near &= about <= (np.partition(about, self.k - 1, axis=1)[:, self.k - 1] + 2 * room)[:, None]
        of, at = np.nonzero(near)
        if not len(of):
            return
        far = np.concatenate([self.exact(turned, square, of[i : i + 65_536], at[i : i + 65_536]) for i in range(0, len(of), 65_536)])
        fine = far <= self.worst[of]
        of, at, far = of[fine], at[fine], far[fine]
        if not len(of):
            return
        of, far, seqs = np.concatenate((self.of, of)), np.concatenate((self.far, far)), np.concatenate((self.seq, seq + at))
        order = np.lexsort((seqs, far, of))
        first = np.searchsorted(of[order], np.arange(len(self.q)))
        kept = order[np.arange(len(order)) - first[of[order]] < self.k]
        held = len(self.of)
        old, new = kept[kept < held], kept[kept >= held]
        kept = np.concatenate((old, new))
        parts = ([self.rest.take(pa.array(old))] if len(old) else []) + ([pa.Table.from_batches([rest.take(pa.array(at[new - held]))])] if len(new) else [])
        self.rest = pa.concat_tables(parts).combine_chunks()
        self.of, self.far, self.seq = of[kept], far[kept], seqs[kept]
        count = np.bincount(self.of, minlength=len(self.q))
        most = np.full(len(self.q), -np.inf)
        np.maximum.at(most, self.of, self.far)
        self.worst = np.where(count == self.k, most, np.inf)

    def about(self, x: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances but for rounding, squared for l2, and for each query more than that rounding can make)."""
        product, error = self.q @ x.T, 16 * (x.shape[1] + 8) * np.finfo(float).eps
        if self.kind == "l2":
            product *= -2
            product += square
            product += self.square[:, None]
            return product, error * (self.square + square.max()) + error * np.where(np.isinf(self.worst), 0, self.worst**2)
        if self.kind == "dot":
            return np.negative(product, out=product), error * np.sqrt(self.square) * np.sqrt(square.max())
        norms = np.sqrt(self.square)[:, None] * np.sqrt(square)
        return 1 - np.divide(product, norms, out=np.zeros_like(product), where=norms != 0), np.full(len(self.q), 2 * error)

    def exact(self, turned: np.ndarray, square: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        pairs = list(zip(turned, self.turned, strict=True))
        if self.kind == "l2":
            return np.sqrt(in_turn((d := x[at] - q[of]) * d for x, q in pairs))
        product = in_turn(x[at] * q[of] for x, q in pairs)
        if self.kind == "dot":
            return -product
        norms = np.sqrt(square[at]) * np.sqrt(self.square[of])
        return 1 - np.divide(product, norms, out=np.zeros_like(product), where=norms != 0)


def nearest_of_blocks(pairs: DataFrame, k: int, kind: str, schema: T.StructType) -> DataFrame:
    """Rows of `schema` (_q, distance, the rows' other columns): for each pair of blocks met in a task, its queries' k nearest."""
    import pyarrow as pa

    def run(batches):
        held: dict[int, Nearest] = {}
        read = lambda blob: pa.ipc.open_stream(blob).read_next_batch()
        for batch in batches:
            q_seq, q_dim, q_vectors, q_rest, seq, dim, vectors, rest = batch.columns
            for i in range(len(batch)):
                d = dim[i].as_py()
                if q_dim[i].as_py() != d:
                    continue
                key = q_seq[i].as_py()
                if key not in held:
                    names = read(q_rest[i].as_buffer().to_pybytes()).column(0)
                    held[key] = Nearest(np.frombuffer(q_vectors[i].as_buffer(), float).reshape(-1, d).copy(), names, k, kind)
                held[key].meet(seq[i].as_py(), np.frombuffer(vectors[i].as_buffer(), float).reshape(-1, d), read(rest[i].as_buffer().to_pybytes()))
        for one in held.values():
            if one.rest is not None:
                for b in one.rest.add_column(0, "distance", pa.array(one.far)).add_column(0, "_q", one.names.take(pa.array(one.of))).to_batches(10_000):
                    yield b

    return pairs.mapInArrow(run, schema)


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Rows' other columns and (query_id, distance, score, rank) for a stated table of queries (query_id, query): blocks of rows,
    in the order of their ids, meet blocks of queries, and each task gives its rows' best k of each query. Up to BROADCAST_QUERIES
    queries are broadcast. Vectors with null, non-finite or extreme components meet the others one by one."""
    spark, kind = rows.sparkSession, metric_of(metric)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    names = [c for c in rows.columns if c != "vector"] + [c for c in queries.columns if c != "query"] + ["distance"]
    asked = cut(queries.where(F.size("query") >= 0).withColumn("_q", F.monotonically_increasing_id()))
    plain = lambda x, q: x.crossJoin(q).where(F.size("vector") == F.size("query")).withColumn("distance", distance(F.col("vector"), F.col("query"), metric)).select(names)
    if k <= 0:
        met = plain(rows, asked).limit(0)
    else:
        sorted_rows = rows.where(tame(F.col("vector"))).repartitionByRange("id").sortWithinPartitions("id")
        count, tasks = asked.count(), 2 * spark.sparkContext.defaultParallelism
        some = blocks(asked.where(tame(F.col("query"))).select("query", "_q"), "query").select(*[F.col(c).alias(f"q_{c}") for c in ("seq", "dim", "vectors", "rest")])
        some = F.broadcast(some) if count <= BROADCAST_QUERIES else some.repartition(-(-count // BROADCAST_QUERIES), "q_seq")
        pairs = some.crossJoin(blocks(sorted_rows, "vector").repartition(tasks, "seq"))
        rest = [f for f in rows.schema.fields if f.name != "vector"]
        schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField("distance", T.DoubleType()), *[T.StructField(f.name, f.dataType) for f in rest]])
        met = nearest_of_blocks(pairs, k, kind, schema).join(asked.drop("query"), "_q").select(names)
        odd_rows, odd_asked = rows.where(~tame(F.col("vector"))), asked.where(~tame(F.col("query")))
        if not odd_rows.isEmpty():
            met = met.unionByName(plain(odd_rows, asked))
        if not odd_asked.isEmpty():
            met = met.unionByName(plain(rows.where(tame(F.col("vector"))), odd_asked))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    score = 1 - F.col("distance") if kind == "cosine" else -F.col("distance")
    return met.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", score)


def merge_top_k(fragments: list[DataFrame], k: int) -> DataFrame:
    """The k nearest of several results (collection, id, distance); one hit for each (collection, id), the nearest."""
    every = fragments[0]
    for f in fragments[1:]:
        every = every.unionByName(f)
    return every.groupBy("collection", "id").agg(F.min("distance").alias("distance")).orderBy("distance", "collection", "id").limit(k)


def rerank(candidates: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    return top_k(candidates.drop("distance", "score"), query, k, metric)


def latest(base: DataFrame, delta: DataFrame) -> DataFrame:
    """A base segment under a delta (id, vector, node_id, tombstone): the delta's rows hide and replace the base's."""
    kept = base.join(delta.select("id"), "id", "left_anti")
    return kept.unionByName(delta.where(~F.col("tombstone")).drop("tombstone"))


def vector_ids(rows: DataFrame) -> DataFrame:
    """Adds vector_id: unpadded URL-safe base64 of the first 16 bytes of the SHA-256 over the little-endian float32 values."""

    @F.pandas_udf("string")
    def name(v: pd.Series) -> pd.Series:
        return v.map(lambda x: base64.urlsafe_b64encode(hashlib.sha256(np.asarray(x, "<f4").tobytes()).digest()[:16]).rstrip(b"=").decode())

    return rows.withColumn("vector_id", name("vector"))


def put(rows: DataFrame, new: DataFrame, dimensions: int) -> DataFrame:
    """rows (vector_id, vector, ...) with new vectors: ids from the values, equal vectors are one and the new row counts.

    A null vector or one of another length is an error.
    """
    if not new.where(F.col("vector").isNull() | (F.size("vector") != dimensions)).isEmpty():
        raise ValueError(f"vectors must have {dimensions} components")
    new = vector_ids(new).dropDuplicates(["vector_id"])
    return rows.join(new.select("vector_id"), "vector_id", "left_anti").unionByName(new, allowMissingColumns=True)


def removed(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (vector_id, ...) without the vectors (vector) given by value."""
    return rows.join(vector_ids(gone.select("vector")).select("vector_id").distinct(), "vector_id", "left_anti")


def stored(rows: DataFrame, index, path: str) -> DataFrame:
    """rows written by bucket (`cell`), so that a search reads the buckets it probes alone."""
    index.assigned(rows).write.mode("overwrite").partitionBy("cell").parquet(path)
    return rows.sparkSession.read.parquet(path)


def compacted(base: str, rows: DataFrame, delta: DataFrame, index, path: str) -> DataFrame:
    """A stored segment with a delta (see latest) folded in, written as a new segment at path; rows is what lies at base."""
    if path == base:
        raise ValueError("write the new segment beside the old one")
    return stored(latest(rows.drop("cell"), delta), index, path)


def with_cells(rows: DataFrame, bucket) -> DataFrame:
    """rows with `cell`: bucket(points) of each Arrow batch at once; -1 for null vectors and other lengths."""
    import pyarrow as pa

    at, schema = rows.columns.index("vector"), rows.schema

    def run(batches):
        for b in batches:
            vectors = b.column(at).to_pylist()
            size = max((len(v) for v in vectors if v is not None), default=0)
            fine = [i for i, v in enumerate(vectors) if v is not None and len(v) == size]
            cell = np.full(len(vectors), -1, np.int32)
            if fine:
                cell[fine] = bucket(np.array([vectors[i] for i in fine], float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*schema.fields, T.StructField("cell", T.IntegerType())]))


@dataclass(frozen=True)
class Hyperplanes:
    """Sign buckets of random hyperplanes; the planes are data, drawn once from a seed."""

    planes: tuple[tuple[float, ...], ...]

    @classmethod
    def drawn(cls, dimensions: int, bits: int, seed: int) -> Hyperplanes:
        if not 1 <= bits <= 24:
            raise ValueError("1 to 24 bits")
        return cls(tuple(map(tuple, np.random.default_rng(seed).standard_normal((bits, dimensions)).tolist())))

    def bucket(self, vector: Column) -> Column:
        out = F.lit(0)
        for i, plane in enumerate(self.planes):
            out = out + F.when(dot(vector, constant(list(plane))) >= 0, 1 << i).otherwise(0)
        return out.cast("int")

    def probes(self, query: list[float], n: int) -> list[int]:
        """The query's bucket, then those a bit away by ascending margin, then two, three and more bits away by summed margins."""
        margins = np.array(self.planes) @ np.asarray(query, float)
        own = int(sum(1 << i for i, m in enumerate(margins) if m >= 0))
        order = np.argsort(np.abs(margins), kind="stable").tolist()
        out = [own]
        for flips in range(1, len(order) + 1):
            if len(out) >= n:
                break
            sets = sorted(itertools.combinations(order, flips), key=lambda bits: sum(abs(margins[i]) for i in bits))
            out += [own ^ sum(1 << i for i in bits) for bits in sets]
        return out[:n]

    def assigned(self, rows: DataFrame) -> DataFrame:
        planes = np.array(self.planes)
        return with_cells(rows, lambda x: ((x @ planes.T >= 0) << np.arange(len(planes))).sum(axis=1))

    def candidates(self, rows: DataFrame, query: list[float], ef: int | None = None) -> DataFrame:
        if "cell" in rows.columns:
            return rows.where(F.col("cell").isin(self.probes(query, ef or 2 * len(self.planes))))
        return rows.where(self.bucket(F.col("vector")).isin(self.probes(query, ef or 2 * len(self.planes))))


@dataclass(frozen=True)
class Cells:
    """Inverted-file cells: each vector belongs to its nearest centroid, and a query looks into the nearest few."""

    centroids: tuple[tuple[float, ...], ...]
    probes: int = 8

    @classmethod
    def trained(cls, rows: DataFrame, cells: int, sample: int = 10_000, rounds: int = 8, seed: int = 0, probes: int = 8) -> Cells:
        """k-means++ and Lloyd rounds over a sample of at most `sample` vectors, those with the lowest seeded hash of the id."""
        some = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("vector").toPandas()
        x = np.array([np.asarray(v, float) for v in some["vector"]])
        if len(x) <= cells:
            return cls(tuple(map(tuple, x.tolist())), probes)
        rng = np.random.default_rng(seed)
        centres = x[[int(rng.integers(len(x)))]]
        while len(centres) < cells:
            d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack((centres, x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[int(rng.integers(len(x)))]))
        for _ in range(rounds):
            of = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            for c in range(cells):
                if (of == c).any():  # an empty cell keeps its centre
                    centres[c] = x[of == c].mean(axis=0)
        return cls(tuple(map(tuple, centres.tolist())), probes)

    def cell(self, vector: Column) -> Column:
        far = F.array(*[F.struct(distance(vector, constant(list(c)), "l2").alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centroids)])
        return F.array_min(far)["i"]

    def assigned(self, rows: DataFrame) -> DataFrame:
        centres = np.array(self.centroids)
        return with_cells(rows, lambda x: ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1))

    def candidates(self, rows: DataFrame, query: list[float], ef: int | None = None) -> DataFrame:
        """Rows of the cells nearest the query; with a stored `cell` column the filter prunes partitions or row groups."""
        d = ((np.array(self.centroids) - np.asarray(query, float)) ** 2).sum(axis=1)
        near = np.argsort(d, kind="stable")[: ef or self.probes].tolist()
        return rows.where((F.col("cell") if "cell" in rows.columns else self.cell(F.col("vector"))).isin(near))
