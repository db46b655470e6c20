"""Sketches, digests and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUB = 8  # sub-buckets of each power of two
EXPIRY_MS = 30_000
#: Weights of round trip, its 95th percentile, loss, topology, load and queue in an edge's score.
WEIGHTS = (0.55, 0.15, 0.10, 0.10, 0.05, 0.05)


def key_sketches(rows: DataFrame, by: list[str], key: str, bits: int = 14) -> DataFrame:
    """(by..., sketch): mergeable distinct-count sketches."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(key, bits).alias("sketch"))


def distinct_keys(sketches: DataFrame) -> DataFrame:
    """(n): the estimated distinct keys of all sketches together."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def may_hold(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among `keys`: an exact semi-join; Spark adds its own Bloom filters where they pay."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def smoothed(samples: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.2, rows_per_part: int = 100_000) -> DataFrame:
    """(by..., ewma): exponentially weighted means in the order of (order, value); the first sample seeds. Null samples are left out.

    A mean over consecutive samples is a weight for what came before plus a sum of its own, so each group is cut into
    stretches of `order` (a number, date or time) that are summed apart and put together: no group meets in one task.
    """
    old = 1 - alpha
    timed = isinstance(samples.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    at = (F.col(order).cast("timestamp") if timed else F.col(order)).cast("double")
    rows = samples.where(F.col(value).isNotNull()).select(*by, F.col(order).alias("_o"), F.col(value).cast("double").alias("_x"), at.alias("_at"))
    low, high, n = rows.agg(F.min("_at"), F.max("_at"), F.count("*")).first()
    parts = n // rows_per_part + 1
    part = F.floor((F.col("_at") - low) / ((high - low) / parts)) if low is not None and low < high and parts > 1 else F.lit(0)
    rows = rows.withColumn("_p", F.when(F.col("_at").isNull(), -1).otherwise(F.least(part.cast("bigint"), F.lit(parts - 1))))
    rank = F.row_number().over(W.partitionBy(*by, "_p").orderBy(F.col("_o").desc(), F.col("_x").desc()))
    first = F.min(F.struct("_o", "_x")).alias("_f")
    sums = rows.withColumn("_r", rank).groupBy(*by, "_p").agg(F.sum(F.pow(F.lit(old), F.col("_r") - 1) * F.col("_x")).alias("_s"), F.count("*").alias("_n"), first)
    later = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(F.col("_p").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = sums.withColumn("_l", later).groupBy(*by).agg(F.sum(F.pow(F.lit(old), F.col("_l")) * F.col("_s")).alias("_s"), F.sum("_n").alias("_n"), F.min("_f")["_x"].alias("_f"))
    return total.select(*by, (F.lit(alpha) * F.col("_s") + F.pow(F.lit(old), F.col("_n")) * F.col("_f")).alias("ewma"))


def last_quantile(samples: DataFrame, by: list[str], order: list[str], value: str, q: float = 0.95, last: int = 64) -> DataFrame:
    """(by..., value): the sorted last `last` samples at index int(q * (n - 1))."""
    recent = W.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    rows = samples.withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= last)
    x = F.sort_array(F.collect_list(value))
    return rows.groupBy(*by).agg(x.alias("x")).select(*by, F.element_at("x", (F.floor(F.lit(q) * (F.size("x") - 1)) + 1).cast("int")).alias(value))


def edge_score(rtt: Column, p95: Column, loss: Column, topology: Column, load: Column, queue: Column, age_ms: Column, worst: float = 1.0) -> Column:
    """Weighted sum of factors from 0 to 1; unknown and expired ones count as the worst."""
    old = age_ms > EXPIRY_MS
    parts = [F.when(old, worst).otherwise(F.coalesce(c, F.lit(worst))) for c in (rtt, p95, loss)] + [F.coalesce(c, F.lit(worst)) for c in (topology, load, queue)]
    total = F.lit(0.0)
    for w, c in zip(WEIGHTS, parts, strict=True):
        total = total + F.lit(w) * c
    return total


def topology_penalty(known: Column, same_geo: Column, same_region: Column, same_zone: Column) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), 0.5).when(~same_geo, 1.0).when(~same_region, 0.4).when(~same_zone, 0.2).otherwise(0.0)


def place(members: DataFrame, n: int, allowed: Column, home: Column) -> DataFrame:
    """The n best allowed members (id, score): those at home first, others as spill-over, by score then id."""
    return members.where(allowed).withColumn("spill", ~home).orderBy("spill", "score", "id").limit(n)


def bucket(value: Column) -> Column:
    """Log-linear bucket of a whole number from 0 on: exact below SUB, then SUB buckets for each power of two."""
    power = F.floor(F.log2(F.greatest(value, F.lit(1)))).cast("int")
    step = F.pow(F.lit(2.0), power - 3)
    return F.when(value < SUB, value).otherwise((power - 2) * SUB + F.floor(value / step).cast("int") - SUB).cast("int")


def bucket_floor(b: Column) -> Column:
    return F.when(b < SUB, b.cast("double")).otherwise((F.pmod(b, F.lit(SUB)) + SUB) * F.pow(F.lit(2.0), F.floor(b / SUB) - 1))


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., bucket, n): mergeable; sum n to merge."""
    return rows.groupBy(*by, bucket(F.col(value).cast("bigint")).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_quantile(counts: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by..., value): the floor of the first bucket at which the cumulative count reaches q of all."""
    every = W.partitionBy(*by)
    rows = counts.withColumn("_c", F.sum("n").over(every.orderBy("bucket"))).withColumn("_t", F.sum("n").over(every))
    return rows.where(F.col("_c") >= F.lit(q) * F.col("_t")).groupBy(*by).agg(F.min("bucket").alias("bucket")).select(*by, bucket_floor(F.col("bucket")).alias("value"))


def per_second(rows: DataFrame, ts: str, by: list[str], value: str, failed: Column, width: str = "1 second") -> DataFrame:
    """(by..., start, n, errors, p50, p99) over tumbling windows."""
    w = F.window(ts, width)
    return rows.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.expr(f"percentile({value}, 0.5)").alias("p50"), F.expr(f"percentile({value}, 0.99)").alias("p99")).select(*by, F.col("w.start").alias("start"), "n", "errors", "p50", "p99")


def window_quantiles(rows: DataFrame, ts: str, by: list[str], value: str, width: str = "1 second") -> DataFrame:
    """(by..., start, n, p50, p95, p99) over tumbling windows, from mergeable histograms: floors of buckets, no values kept."""
    counts = histogram(rows.withColumn("start", F.window(ts, width)["start"]), [*by, "start"], value)
    every = W.partitionBy(*by, "start")
    rows = counts.withColumn("_c", F.sum("n").over(every.orderBy("bucket"))).withColumn("_t", F.sum("n").over(every))
    least = [bucket_floor(F.min(F.when(F.col("_c") >= F.lit(q) * F.col("_t"), F.col("bucket")))).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return rows.groupBy(*by, "start").agg(F.sum("n").alias("n"), *least)
