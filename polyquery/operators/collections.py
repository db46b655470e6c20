"""Sets, hashes and sorted sets as state frames, folded from ordered logs of commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLACE = ("ns", "coll")


class WrongType(ValueError):
    """A command of one kind of collection on another kind."""


class NotANumber(ValueError):
    """An increment of text that isn't a number."""


def once(log: DataFrame) -> DataFrame:
    """Commands (log_index, idem_key, ...) without repeats of an idempotency key: the first counts; null keys always do."""
    first = W.partitionBy("idem_key").orderBy("log_index")
    ranked = log.where("idem_key is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return log.where("idem_key is null").unionByName(ranked)


def state(log: DataFrame, now: int | None = None) -> DataFrame:
    """(ns, coll, item, value, score, expiry) after a log (log_index, op, ns, coll, item, value, score, expiry): each item's last
    command decides; add and set keep it, remove drops it. With `now`, expired items are gone."""
    rest = ("op", "value", "score", "expiry")
    last = log.groupBy(*PLACE, "item").agg(F.max(F.struct("log_index", *rest)).alias("x"))
    rows = last.where(F.col("x.op") != "remove").select(*PLACE, "item", *[F.col(f"x.{c}").alias(c) for c in rest[1:]])
    return rows if now is None else rows.where(F.col("expiry").isNull() | (F.col("expiry") > now))


def newly_added(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(ns, coll, n): how many of the items to add are new."""
    return items.select(*PLACE, "item").distinct().join(rows, [*PLACE, "item"], "left_anti").groupBy(*PLACE).agg(F.count("*").alias("n"))


def removed(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(ns, coll, n): how many of the items to remove are there."""
    return rows.join(items.select(*PLACE, "item").distinct(), [*PLACE, "item"], "left_semi").groupBy(*PLACE).agg(F.count("*").alias("n"))


def cardinality(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*PLACE).agg(F.count("*").alias("n"))


def contains(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ns, coll, item) with found."""
    have = rows.select(*PLACE, "item", F.lit(True).alias("found"))
    return asked.join(have, [*PLACE, "item"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def members(rows: DataFrame, ns: str, coll: str, limit: int = 0) -> DataFrame:
    """Items in byte order; limit 0 is all."""
    out = rows.where((F.col("ns") == ns) & (F.col("coll") == coll)).orderBy("item")
    return out.limit(limit) if limit else out


def ranged(rows: DataFrame, ns: str, coll: str, limit: int = 0) -> DataFrame:
    """Sorted-set items by ascending score, then item."""
    out = rows.where((F.col("ns") == ns) & (F.col("coll") == coll)).orderBy("score", "item")
    return out.limit(limit) if limit else out


def incremented(log: DataFrame, fractional: bool = False) -> DataFrame:
    """(ns, coll, item, value): numbers after a log of set (value), incr (delta in value) and remove commands: the sum
    of increments after the last set or remove, on what was set. Values are decimal text; other text is an error."""
    number = F.col("value").cast("double" if fractional else "bigint")
    base = F.max(F.when(F.col("op") != "incr", F.struct("log_index", "op", "value"))).over(W.partitionBy(*PLACE, "item"))
    rows = log.withColumn("_base", base).where(F.col("_base").isNull() | (F.col("log_index") >= F.col("_base.log_index")))
    out = rows.groupBy(*PLACE, "item").agg(F.sum(F.when(F.col("op") != "remove", number).otherwise(0)).alias("value"), F.max((F.col("op") != "remove").cast("int")).alias("_has"))
    return out.where("_has = 1").select(*PLACE, "item", F.col("value").cast("string").alias("value"))


def not_numbers(log: DataFrame, fractional: bool = False) -> DataFrame:
    """Increments and what they would start from whose text isn't a number of the kind."""
    return log.where("op <> 'remove' and value is not null").where(F.col("value").try_cast("double" if fractional else "bigint").isNull())


def numeric(log: DataFrame, fractional: bool = False) -> DataFrame:
    if not not_numbers(log, fractional).isEmpty():
        raise NotANumber("an increment of text that isn't a number")
    return log


def bulk_remove(rows: DataFrame, items: DataFrame, colls: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, (ns, coll, n) removed): the items go from the listed collections, or all, whatever their kind."""
    at = F.lit(True) if colls is None else F.col("coll").isin(colls)
    gone = rows.where(at).join(items.select("item").distinct(), "item", "left_semi")
    return rows.join(gone.select(*PLACE, "item"), [*PLACE, "item"], "left_anti"), gone.groupBy(*PLACE).agg(F.count("*").alias("n"))


def collections(log: DataFrame) -> DataFrame:
    """(ns, coll, kind): every collection ever written to; the first command's kind stays."""
    return log.groupBy(*PLACE).agg(F.min_by("kind", "log_index").alias("kind"))


def wrong_types(log: DataFrame) -> DataFrame:
    """Commands whose kind isn't their collection's."""
    return log.join(collections(log).withColumnRenamed("kind", "_kind"), list(PLACE)).where(F.col("kind") != F.col("_kind")).drop("_kind")


def checked(log: DataFrame) -> DataFrame:
    if not wrong_types(log).isEmpty():
        raise WrongType("a command of another kind than its collection")
    return log


def card_check(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(ns, coll, counted, stored): collections whose stored cardinality isn't what is counted."""
    n = cardinality(rows).withColumnRenamed("n", "counted")
    both = n.join(stored.select(*PLACE, F.col("n").alias("stored")), list(PLACE), "full").fillna(0, ["counted", "stored"])
    return both.where(F.col("counted") != F.col("stored"))


def sweep(rows: DataFrame, now: int) -> DataFrame:
    """Items whose expiry is at `now` or before."""
    return rows.where(F.col("expiry") <= now)
