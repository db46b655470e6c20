"""Checks over an operation history: each returns the violations, none when all is well.

History: (kind, key, value, request_id, session, start_ms, end_ms, ack, policy, observed, written, tombstone,
expires_at_ms, completeness, valid_until_ms); observed and written are comparable versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def healed(history: DataFrame, faults: DataFrame) -> DataFrame:
    """Reads that start after the last fault (start_ms, end_ms) ended; with a fault still open, none."""
    end = faults.agg(F.coalesce(F.max("end_ms"), F.lit(-1)).alias("_end"), F.coalesce(F.bool_or(F.col("end_ms").isNull()), F.lit(False)).alias("_open"))
    return history.where("kind = 'read'").crossJoin(F.broadcast(end)).where((F.col("start_ms") > F.col("_end")) & ~F.col("_open")).drop("_end", "_open")


def convergence(reads: DataFrame) -> DataFrame:
    """Keys whose healed reads differ."""
    return reads.groupBy("key").agg(F.count_distinct(F.coalesce("value", F.lit("\0"))).alias("n")).where("n > 1")


def acked(history: DataFrame) -> DataFrame:
    return history.where("kind = 'write' and ack").groupBy("key").agg(F.max("written").alias("newest"))


def lww_determinism(history: DataFrame, reads: DataFrame) -> DataFrame:
    """Healed reads of last-write-wins keys that don't show the newest acknowledged write."""
    return reads.where("policy <> 'keep-siblings'").join(acked(history), "key").where(F.col("observed") != F.col("newest"))


def durability(history: DataFrame, reads: DataFrame, lost_holders: Column | None = None) -> DataFrame:
    """Keys that were read after healing, but never at their newest acknowledged write or above."""
    best = reads.groupBy("key").agg(F.max("observed").alias("best"))
    out = acked(history).join(best, "key").where(F.col("best").isNull() | (F.col("best") < F.col("newest")))
    return out if lost_holders is None else out.where(~lost_holders)


def completeness(history: DataFrame) -> DataFrame:
    """Scans that call themselves complete without a certificate that outlasts their start."""
    return history.where("kind = 'scan' and completeness = 'COMPLETE' and (valid_until_ms is null or valid_until_ms <= start_ms)")


def idempotency(history: DataFrame) -> DataFrame:
    """Requests with more than one written version."""
    return history.where("kind = 'write' and request_id is not null and written is not null").groupBy("request_id").agg(F.count_distinct("written").alias("n")).where("n > 1")


def lost_updates(history: DataFrame, reads: DataFrame) -> DataFrame:
    """Acknowledged keep-siblings writes (writer, written) that no read shows among its siblings and the writer didn't supersede."""
    w = history.where("kind = 'write' and ack and policy = 'keep-siblings'")
    last = w.groupBy("key", "writer").agg(F.max("written").alias("written"))
    seen = reads.select("key", F.explode("siblings").alias("written")).distinct()
    return last.join(seen, ["key", "written"], "left_anti")


def session_monotonicity(history: DataFrame) -> DataFrame:
    """Reads below what their session has read of the key before."""
    before = W.partitionBy("session", "key").orderBy("start_ms", "end_ms").rowsBetween(W.unboundedPreceding, -1)
    return history.where("kind = 'read'").withColumn("best", F.max("observed").over(before)).where(F.col("observed") < F.col("best"))


def ttl_bound(history: DataFrame, slack_ms: int = 120_000) -> DataFrame:
    """Reads that show a value later than the key's earliest expiry and the slack."""
    due = history.where("kind = 'write' and expires_at_ms is not null").groupBy("key").agg(F.min("expires_at_ms").alias("due"))
    return history.where("kind = 'read' and value is not null and value <> ''").join(due, "key").where(F.col("start_ms") > F.col("due") + slack_ms)


def budget_cap(spends: DataFrame, by: list[str], at: list[str], units: str, cap: Column) -> DataFrame:
    """The first spend of each budget at which the running sum of positive units passes the cap."""
    order = W.partitionBy(*by).orderBy(*at)
    run = F.sum(F.greatest(F.col(units), F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0))
    over = spends.withColumn("running", run).where(F.col("running") > cap)
    return over.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def lease_disjointness(spends: DataFrame) -> DataFrame:
    """Spends at or after their lease's reclaim time."""
    return spends.where("reclaim_ms is not null and at_ms >= reclaim_ms")
