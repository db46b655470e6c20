"""The operators as steps over the columns of documents.

Each step takes documents with doc_id, text, source and any other columns, whatever their names, and
returns the same columns. Null ids, texts and sources, empty and very long texts, equal rows and empty
tables are fine; what becomes of them stands with each step.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquery.llm import mixing, near_dedup, packing, quality, secrets
from polyquery.llm.shared import dropped, ready, staged

BROADCAST_ROWS = 500_000


def without(docs: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs without the ids, or ids and other keys, listed: broadcast up to BROADCAST_ROWS of them, beyond that joined by a shuffle."""
    ids = staged(ids.select(*keys).where("doc_id is not null").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, list(keys), "left_anti").select(docs.columns)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Drops documents that score below `least` under a model of the labels whose id's crc32 modulo 5 isn't 0.

    Each row is judged by its text alone, a null or empty one too; equal texts go or stay together. Without
    labels every row stays (all score 1/2).
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return quality.good(docs, quality.train(docs, labels.where(~held)), least)


def drop_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; rows without an id all stay.

    Rows go by id and text: a row isn't dropped for another text under its id. Texts without words are
    near copies of nothing and stay; equal rows under one id become one row.
    """
    mark = "_mark"
    while mark in docs.columns:
        mark += "_"
    found = staged(near_dedup.near_duplicates(docs, shingle, percent, mark=mark), "groups")
    left = without(docs.withColumn(mark, F.xxhash64("text")), found.where(~F.col("kept")), ("doc_id", mark)).select(docs.columns)
    twice = staged(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "ids")
    if twice.isEmpty():
        dropped(found, twice)
        return left
    return without(left, twice).unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in texts give way to a mark; every row stays, null and empty texts as they are."""
    return secrets.redacted(docs)


def mix_sources(docs: DataFrame) -> DataFrame:
    """A row for each whole repeat that the mix takes of a document, in the order of training positions.

    A repeat that is cut short counts when at least half of the document is taken. Rows that are the same
    in id, source and text are repeated alike. Texts without words are never taken; a null source is one
    of its own. Rows come out sorted by position: so they are written, and so later steps find them.
    """
    plan = mixing.mix(docs, extra={"mark": F.xxhash64("text")})
    whole = F.size(F.filter("parts", lambda p: (p > 0) & (2 * p >= F.col("size"))))
    plan = plan.select(F.col("doc_id").alias("id"), "source", "mark", F.slice("positions", F.lit(1), whole).alias("spots"))
    plan = plan.groupBy("id", "source", "mark").agg(F.max("spots").alias("spots")).where(F.size("spots") > 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.xxhash64("row.text") == F.col("mark"))
    return rows.join(plan, same).select("row", F.explode("spots").alias("spot")).orderBy("spot", "row.doc_id").select("row.*")


def written_order(docs: DataFrame) -> tuple[Column | None, int, DataFrame]:
    """(each row's number, how many there are, docs with what the number is made of) in the order in which docs were written
    to Parquet; no number where docs aren't read from files. The driver holds a row for each file."""
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return None, 0, docs
    before, total = [], 0
    for r in sorted(rows.groupBy("_file").count().collect()):
        before.append((r[0], total))
        total += r[1]
    small = docs.sparkSession.createDataFrame(before, "_file string, _before bigint")
    return F.col("_before") + F.col("_row"), total, rows.join(F.broadcast(small), "_file")


def pack_sequences(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Packs documents in the order in which the mix wrote them, so that sequences follow the curriculum (see packing.pack)."""
    ready(docs.sparkSession)
    position, rows, docs = written_order(docs.select("doc_id", "text"))
    return packing.pack(docs, tokenizer, position=position, rows=rows)
