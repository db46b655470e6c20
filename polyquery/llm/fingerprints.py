"""Bottom-k sketches of shingle hashes: mergeable fingerprints of documents and of groups of documents.

A sketch is the k smallest distinct 48-bit hashes of a text's word shingles, ascending. The k smallest
of two sketches' union are the sketch of both texts together, which is what makes sketches mergeable.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquery.llm.near_dedup import document_sets
from polyquery.llm.shared import documents, ready
from polyquery.llm.words import U64

K, SHINGLE, BITS = 128, 5, 48


def sketches(column: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text of a column; a null text or one without words has an empty sketch."""
    out: list[np.ndarray] = []
    for _, _, sets, bounds in document_sets(column, shingle):
        small = sets >> U64(64 - BITS)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = small[s : min(e, s + k + 8)]  # hashes ascend; a few more in case that two are equal in 48 bits
            out.append(np.unique(part)[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two texts (or groups) together."""
    return np.union1d(a, b)[:k]


def shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """(elements of the merged sketch that both have, its size)."""
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return (int(np.searchsorted(both, union[-1], "right")) if len(union) else 0), len(union)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """|A and B| / |A or B|: exact while the union has at most k shingles. Two empty sketches are alike (1)."""
    both, union = shared(a, b, k)
    return both / union if union else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles: exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / float(a[k - 1] + U64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """|A and B| / |A|: the share of A's shingles that B has; 1 for an empty A."""
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k)) if len(a) else 1.0


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, BITS // 8)
    return np.hstack((np.zeros((len(raw), 8 - BITS // 8), np.uint8), raw)).view(">u8").ravel().astype(U64)


def fingerprint(docs: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, n_shingles): a row for each row. Null and empty texts have the empty fingerprint."""
    ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = sketches(b.column(1), k, shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_text(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())], ["id", "fingerprint", "n_shingles"])

    return docs.mapInArrow(run, f"id {kind}, fingerprint string, n_shingles double").withColumnRenamed("id", id_col)


def fingerprint_groups(docs: DataFrame, group_col: str, k: int = K, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """(group, fingerprint, n_shingles): the sketch of each group's texts together, nulls a group of their own.

    Each task merges what it reads into one sketch for each group and passes on that alone, so a group
    that holds most rows sends as many sketches as there are tasks.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col(group_col).alias("grp"), F.col(text_col).alias("text"))
    kind = docs.schema["grp"].dataType.simpleString()
    schema = f"grp {kind}, fingerprint string, n_shingles double"

    def rows(held: dict, like: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), like), pa.array([to_text(x) for x in held.values()], pa.string()), pa.array([distinct(x, k) for x in held.values()], pa.float64())], ["grp", "fingerprint", "n_shingles"])

    def partial(batches):
        held: dict = {}
        like = None
        for b in batches:
            like = b.column(0).type
            for g, x in zip(b.column(0).to_pylist(), sketches(b.column(1), k, shingle), strict=True):
                held[g] = merge(held[g], x, k) if g in held else x
            if len(held) > 20_000:
                yield rows(held, like)
                held = {}
        if held:
            yield rows(held, like)

    def final(table):
        all_of = [from_text(s) for s in table.column("fingerprint").to_pylist()]
        whole = np.unique(np.concatenate(all_of))[:k]
        return pa.table({"grp": table.column("grp").slice(0, 1), "fingerprint": pa.array([to_text(whole)]), "n_shingles": pa.array([distinct(whole, k)])})

    return docs.mapInArrow(partial, schema).groupBy("grp").applyInArrow(final, schema).withColumnRenamed("grp", group_col)


def followed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (id, text) dealt into ranges of (id, hash of the text), with each range's next row as one more row (more = 1).

    A range begins at an id; an id (or null) that holds the rows of several ranges is split further by its
    texts' hashes. The ranges' bounds and first rows are the only things on the driver: a few numbers each.
    """
    spark = docs.sparkSession
    rows, nulls = docs.select(F.count("*"), F.count_if(F.col("id").isNull())).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 100_000)
    bounds = docs.approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n) if rows > nulls else []
    cuts, times = np.unique(np.array([min(int(b), (1 << 63) - 1) for b in bounds], np.int64), return_counts=True)
    slots = np.concatenate(([max(1, n * nulls // max(rows, 1))], [1], np.where(times > 1, times, 0) + 1))  # of nulls, of ids below the cuts, of each cut's range
    cut_at, slots_of, first_of = (F.lit(x.astype(np.int64)) for x in (cuts, slots, np.cumsum(slots) - slots))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))]) if len(cuts) else F.array(F.lit(1))
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cut_at, at + step - 1) <= F.col("id"), at + step).otherwise(at))  # binary search
    dealt = docs.withColumn("place", F.when(F.col("id").isNull(), 0).otherwise(below + 1)).withColumn("slots", F.get(slots_of, "place"))
    at_cut = F.coalesce(F.col("id") == F.get(cut_at, F.greatest(F.col("place") - 2, F.lit(0))), F.lit(False))
    split = F.lit(bool((slots > 1).any())) & (F.col("slots") > 1) & ((F.col("place") == 0) | at_cut)
    dealt = dealt.withColumn("hash", F.when(split, F.xxhash64("text")).otherwise(F.lit(0).cast("bigint")))
    share = F.shiftright((F.shiftright("hash", 32) + (1 << 31)) * (F.col("slots") - (F.col("place") != 0).cast("int")), 32)
    dealt = dealt.withColumn("part", (F.get(first_of, "place") + F.when(split, share).otherwise(F.col("slots") - 1)).cast("int"))
    firsts = sorted((r.part, r.x.id, r.x.hash) for r in dealt.groupBy("part").agg(F.min(F.struct("id", "hash")).alias("x")).collect())
    before = [(i, h, firsts[j - 1][0]) for j, (_, i, h) in enumerate(firsts)]
    small = spark.createDataFrame(before, "first bigint, first_hash bigint, helper int")  # a row for each range
    dealt = dealt.join(F.broadcast(small), F.col("id").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("first_hash")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("more"))
    extra = F.struct(F.col("helper").alias("part"), F.lit(1).alias("more"))
    dealt = dealt.select("id", "text", F.explode(F.when(F.col("helper").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("x"))
    dealt = dealt.select("id", "text", F.col("x.part").alias("part"), F.col("x.more").alias("more"))
    return dealt.repartitionById(int(slots.sum()), F.col("part")).sortWithinPartitions("part", "more", F.col("id").asc_nulls_first(), F.xxhash64("text"), "text"), int(slots.sum())


def compare_next(docs: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the next document's beginning replaces the second half.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The next row is
    that of the next larger id (bigint), ties by the text's hash and then text, null ids first; after the last row comes the first;
    a single row is followed by itself. A null text is empty. Other columns play no part; an empty table
    gives an empty table. Texts pass one shuffle by ranges of id, whose sorted rows stream through each task.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, _ = followed(docs)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def block(ids: list, texts: list[str]) -> pa.RecordBatch:
        """A row for each text but the last, which is only the one that follows."""
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:], strict=False)]
        one, two = sketches(pa.array(texts, pa.string()), k, shingle), sketches(pa.array(edited, pa.string()), k, shingle)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[: len(edited)], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([to_text(x) for x in one[:-1]], pa.string()),
                pa.array([to_text(x) for x in two], pa.string()),
                pa.array([resemblance(a, b, k) for a, b in zip(one, two, strict=False)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(one, one[1:], strict=False)], pa.float64()),
            ],
            names,
        )

    def run(batches):
        ids, texts, size, done = [], [], 0, None
        for b in batches:
            for i, t, part, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == done:
                    continue  # a repeated row with the first id: the one before it has served
                ids.append(i)
                texts.append(t)
                size += len(t)
                if more:
                    done = part
                if more or size > 2 << 20:
                    if len(texts) > 1:
                        yield block(ids, texts)
                    ids, texts, size = ([], [], 0) if more else (ids[-1:], texts[-1:], len(t))

    return rows.mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(documents(spark, sf_dir))
