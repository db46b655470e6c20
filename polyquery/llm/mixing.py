"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations alone.

Each source has a target of words and a weight schedule over training time 0..1. The schedule's integral
is the source's cumulative demand; a document stands where the demand, inverted, reaches the words laid
out before it, and documents are range-sorted by that position. A source whose target passes its size
is laid out again (at most `repeats` times in all); one whose target is smaller ends within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from polyquery.llm.shared import documents, running, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: Rates at the start and the end of training for the sources of each weight: the light ones early, the heavy ones late.
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(source, source_size, turn, target) from (source, source_size), a row for each source.

    Weights repeat along the sources by code point, null last. Targets share the words of all sources by
    weight and stop at `repeats` times a source's size; what that leaves is reshared among the others
    until none is above. In the order of size over weight, the share of a unit of weight if exactly
    the sources before were full is largest at the right number of full sources.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())  # one row for each source, pre-aggregated
    rows = sizes.withColumn("turn", ((F.row_number().over(every) - 1) % len(weights)).cast("int"))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1))
    rows = rows.withColumn("most", (repeats * F.col("source_size")).cast("double"))
    fill = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    taken = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("unit", (F.sum("source_size").over(whole) - full) / (F.sum("weight").over(whole) - taken))
    return rows.select("source", "source_size", "turn", F.least("most", F.col("weight") * F.max("unit").over(whole)).alias("target"))


def when(share: Column, turn: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a source's demand, the integral of a rate that goes from a to b, has met `share` of its target."""
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in schedule])
    at = F.element_at(pairs, turn % len(schedule) + 1)
    a, b = at["a"], at["b"]
    share = F.least(share, F.lit(1.0))
    root = (F.sqrt(a * a + (b - a) * (a + b) * share) - a) / F.when(b == a, 1.0).otherwise(b - a)
    return F.when(b == a, share).otherwise(root)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, schedule=SCHEDULE, repeats: int = 3, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, size, source, source_size, target, taken, positions, extra columns): a row for each row.

    taken is the words that the mix takes of the document, repeats counted; over a source they sum to its
    target, rounded. positions has the training time of each repeat, the last of which may be cut short.
    A null text has size 0 and is never taken; a null source is a source, after all others. Rows with
    equal ids count each on its own. The order within a source is that of a hash of id and text, so
    reruns agree; rows that are equal in both are laid out next to each other. An empty table gives an empty table.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("spread"), *[c.alias(k) for k, c in (extra or {}).items()]), "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    laid = running(rows, ["source"], F.col("spread"), [F.col("spread"), F.col("id"), F.col("size")], F.col("size"), "before", rows=rows.count())
    laid = laid.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goal = F.round("target").cast("bigint")
    repeat = F.sequence(F.lit(0), F.lit(repeats - 1))
    part = lambda e: F.least(F.greatest(goal - e * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    laid = laid.withColumn("parts", F.transform(repeat, part))
    laid = laid.withColumn("taken", F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, x: s + x))
    spot = lambda e: when((e * F.col("source_size") + F.col("before")) / F.greatest(goal, F.lit(1)), F.col("turn"), schedule)
    laid = laid.withColumn("positions", F.transform(F.filter(repeat, lambda e: F.element_at("parts", e + 1) > 0), spot))
    return laid.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "taken", "parts", "positions", *(extra or {}))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir)).withColumn("position", F.element_at(F.concat("positions", F.array(F.lit(None).cast("double"))), 1))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")
