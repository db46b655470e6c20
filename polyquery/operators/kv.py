"""Versioned key-value records: winners, siblings, expiry, scans and time travel over an append-only log.

A log has (namespace, key, value, version, expires_at, tombstone); version is a struct whose field order is
its comparison order (physical, logical, cluster, member, sequence), so that a greater struct is newer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VERSION = ("physical", "logical", "cluster", "member", "sequence")
KEY = ("namespace", "key")


@dataclass
class Scan:
    rows: DataFrame
    completeness: str


def version(physical: Column, logical: Column, cluster: Column, member: Column, sequence: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in zip(VERSION, (physical, logical, cluster, member, sequence), strict=True)])


def mutation_id(v: str = "version") -> Column:
    return F.concat_ws("\x1f", F.col(f"{v}.cluster"), F.col(f"{v}.member"), F.col(f"{v}.sequence").cast("string"))


def winners(log: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """The newest record of each key, tombstones included. Pre-aggregated before the shuffle; order and replays don't matter."""
    rest = [c for c in log.columns if c not in (*by, "version")]
    best = log.groupBy(*by).agg(F.max(F.struct("version", *rest)).alias("_w"))
    return best.select(*by, *[F.col(f"_w.{c}").alias(c) for c in log.columns if c not in by]).select(log.columns)


def live(rows: DataFrame, now: int) -> DataFrame:
    """Without tombstones and what expires at `now` or before."""
    return rows.where(~F.col("tombstone") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def siblings(log: DataFrame) -> DataFrame:
    """(namespace, key, n, siblings): each writer's newest record, oldest first; a writer is a cluster and member."""
    writer = log.withColumns({"_c": F.col("version.cluster"), "_m": F.col("version.member")})
    newest = writer.groupBy(*KEY, "_c", "_m").agg(F.max(F.struct("version", "tombstone", "value")).alias("_w"))
    return newest.groupBy(*KEY).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("_w")).alias("siblings"))


def resolve(log: DataFrame, policy: str = "lww") -> DataFrame:
    """keep-siblings by that name; anything else is last-write-wins."""
    return siblings(log) if policy == "keep-siblings" else winners(log)


def get(log: DataFrame, namespace: str, key: str, now: int) -> DataFrame:
    """The winner with found = not deleted and not expired; a deleted key still shows its version."""
    row = winners(log.where((F.col("namespace") == namespace) & (F.col("key") == key)))
    fresh = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return row.where(fresh).withColumn("found", ~F.col("tombstone")).withColumn("value", F.when(F.col("found"), F.col("value")))


def multi_get(log: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """wanted (pos, namespace, key) in request order, repeats kept: (pos, namespace, key, value, found)."""
    have = live(winners(log.join(wanted.select(*KEY).distinct(), list(KEY), "left_semi")), now).select(*KEY, "value", F.lit(True).alias("found"))
    return wanted.join(have, list(KEY), "left").select("pos", *KEY, "value", F.coalesce("found", F.lit(False)).alias("found")).orderBy("pos")


def prefix_end(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with the prefix; None: there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def in_range(rows: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("key") >= F.lit(start))
    return rows if end is None else rows.where(F.col("key") < F.lit(end))


def scan(log: DataFrame, namespace: str, now: int, start=None, end=None, limit: int | None = None, mode: str = "CACHE_FAST", certificates: DataFrame | None = None) -> Scan:
    """Live records of [start, end) in key order. What a mode may promise stays as it is: complete is said only under a
    certificate that covers the range, partial where holders are asked one by one, best effort otherwise."""
    rows = live(winners(in_range(log.where(F.col("namespace") == namespace), start, end)), now).orderBy("key")
    kind = "BEST_EFFORT"
    if mode == "ROUTED_EVENTUAL":
        kind = "PARTIAL"
    elif mode == "CACHE_COMPLETE" and certificates is not None and not covering(certificates, namespace, start, end, now).isEmpty():
        kind = "COMPLETE"
    return Scan(rows if limit is None else rows.limit(limit), kind)


def covering(certificates: DataFrame, namespace: str, start, end, now: int) -> DataFrame:
    """Certificates (namespace, start_key, end_key, valid_until) that hold the whole range and still hold at `now`."""
    c = certificates.where((F.col("namespace") == namespace) & (F.col("valid_until") > now))
    c = c.where(F.col("start_key").isNull() if start is None else F.col("start_key").isNull() | (F.col("start_key") <= F.lit(start)))
    return c.where(F.col("end_key").isNull() if end is None else F.col("end_key").isNull() | (F.col("end_key") >= F.lit(end)))


def page(log: DataFrame, namespace: str, now: int, cursor=None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(a page, the next page's first key if there is one)."""
    rows = scan(log, namespace, now, start=cursor, limit=limit + 1).rows
    return rows.limit(limit), rows.orderBy(F.col("key").desc()).limit(1).join(rows.agg(F.count("*").alias("n")), F.col("n") > limit).select("key")


def routed(holders: DataFrame, now: int, limit: int) -> DataFrame:
    """Rows of several holders merged: newest of each key, live, in key order."""
    return live(winners(holders.drop("holder")), now).orderBy("namespace", "key").limit(limit)


def holders_of(rows: DataFrame) -> DataFrame:
    """(namespace, key, newest, holders): the newest version and each holder's newest."""
    each = rows.groupBy(*KEY, "holder").agg(F.max("version").alias("version"))
    return each.groupBy(*KEY).agg(F.max("version").alias("newest"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("holder", "version")))).alias("holders"))


def across_clusters(rows: DataFrame) -> DataFrame:
    """(namespace, key, cluster, member, version, newest): each place's newest and whether it is the newest of all."""
    each = rows.groupBy(*KEY, "cluster", "member").agg(F.max("version").alias("version"))
    return each.withColumn("newest", F.col("version") == F.max("version").over(W.partitionBy(*KEY)))


def travel(log: DataFrame, cut: int) -> DataFrame:
    """Winners as they were when the clock showed `cut`."""
    return winners(log.where(F.col("version.physical") <= cut))


def live_keys(log: DataFrame) -> DataFrame:
    """(namespace, n): keys whose winner isn't a tombstone; expiry plays no part."""
    return winners(log).where(~F.col("tombstone")).groupBy("namespace").agg(F.count("*").alias("n"))


def sweep(log: DataFrame, now: int, due: DataFrame | None = None) -> DataFrame:
    """Tombstones for keys (of `due`, if given) whose current winner has expired."""
    old = winners(log if due is None else log.join(due, list(KEY), "left_semi")).where(~F.col("tombstone") & (F.col("expires_at") <= now))
    return old.withColumns({"tombstone": F.lit(True), "value": F.lit(None).cast(old.schema["value"].dataType)})


def delete_namespace(log: DataFrame, namespace: str) -> DataFrame:
    """Tombstones for all keys of a namespace that aren't deleted."""
    return winners(log.where(F.col("namespace") == namespace)).where(~F.col("tombstone")).withColumn("tombstone", F.lit(True))


def append_once(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with records not seen before: one for each mutation id."""
    new = new.withColumn("_id", mutation_id()).dropDuplicates(["_id"])
    return log.unionByName(new.join(log.select(mutation_id().alias("_id")), "_id", "left_anti").drop("_id"))


def put(log: DataFrame, rows: DataFrame, idempotency: str | None = None) -> DataFrame:
    """Appends rows; of those with one idempotency key only the first (by version) counts."""
    if idempotency:
        first = W.partitionBy(idempotency).orderBy("version")
        rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", idempotency)
    return log.unionByName(rows)


def diverged(mine: DataFrame, theirs: DataFrame, ranges: int = 64) -> DataFrame:
    """(part): key ranges whose digests differ between two sides of winners."""
    return digests(mine, ranges).toDF("part", "a").join(digests(theirs, ranges).toDF("part", "b"), "part", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("part")


def digests(rows: DataFrame, ranges: int) -> DataFrame:
    """(part, digest): per range of key hashes, an order-free digest (count, and the sum and xor of record hashes)."""
    h = F.xxhash64("namespace", "key", "version.physical", "version.logical", "version.cluster", "version.member", "version.sequence")
    part = F.pmod(F.xxhash64(*KEY), F.lit(ranges)).cast("int").alias("part")
    summed = rows.groupBy(part).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return summed.select("part", F.sha2(F.concat_ws("|", "n", "s", "x"), 256).alias("digest"))


def anti_entropy(mine: DataFrame, theirs: DataFrame, only_held: bool = False) -> DataFrame:
    """Records of theirs to take over: newer than mine, or (unless only_held) not held."""
    own = mine.select(*KEY, F.col("version").alias("_v"))
    joined = theirs.join(own, list(KEY), "inner" if only_held else "left")
    return joined.where(F.col("_v").isNull() | (F.col("version") > F.col("_v"))).drop("_v")


def under_replicated(holders: DataFrame, alive: list[str], target: int) -> DataFrame:
    """(namespace, key, n): keys that fewer than `target` living holders have."""
    count = F.count_distinct(F.when(F.col("holder").isin(alive), F.col("holder"))).alias("n")
    return holders.groupBy(*KEY).agg(count).where(F.col("n") < target)


def with_siblings(log: DataFrame) -> DataFrame:
    """(namespace, key, winner, others): the newest of the writers' newest records, and the rest, oldest first."""
    every = siblings(log)
    return every.select(*KEY, F.element_at("siblings", -1).alias("winner"), F.slice("siblings", F.lit(1), F.col("n").cast("int") - 1).alias("others"))


def put_once(log: DataFrame, rows: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(the log after, answers (idem_key, version)) of puts (namespace, key, value, version, idem_key, ttl_ms).

    log has idem_key as well. A put whose idempotency key the log or an earlier put (by version) has is not
    stored; its answer is the stored version. Null keys always store. A time to live sets expires_at.
    """
    first = W.partitionBy("idem_key").orderBy("version")
    named = rows.where("idem_key is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    fresh = named.join(log.select("idem_key").where("idem_key is not null").distinct(), "idem_key", "left_anti").unionByName(rows.where("idem_key is null"))
    stored = fresh.withColumns({"expires_at": F.lit(now) + F.col("ttl_ms"), "tombstone": F.lit(False)}).drop("ttl_ms")
    after = log.unionByName(stored, allowMissingColumns=True)
    known = after.where("idem_key is not null").groupBy("idem_key").agg(F.min("version").alias("version"))
    return after, rows.where("idem_key is not null").select("idem_key").distinct().join(known, "idem_key")


def deleted(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log with a tombstone for each of keys (namespace, key, version)."""
    return log.unionByName(keys.withColumn("tombstone", F.lit(True)), allowMissingColumns=True)


def ticked(events: DataFrame, node: str, order: str, wall: str) -> DataFrame:
    """events with physical and logical: each node's hybrid clock, which never runs back and counts on where the wall clock stands.
    Events of one place in the order show one physical time, the latest so far with all of theirs; those without a place come last."""
    place = F.col(order).asc_nulls_last()
    so_far = W.partitionBy(node).orderBy(place).rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = events.withColumn("physical", F.max(wall).over(so_far))
    return rows.withColumn("logical", F.row_number().over(W.partitionBy(node, "physical").orderBy(place)) - 1)


def range_digests(rows: DataFrame, part: Column) -> DataFrame:
    """(part, n, digest): of each range of winners its count and the sum of 60-bit hashes of key and version, whatever their order."""
    text = F.concat_ws("|", "namespace", "key", *[F.col(f"version.{c}").cast("string") for c in VERSION])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))


def replicas(members: DataFrame, by: str = "member") -> DataFrame:
    """(namespace, replicas, members): keys that all members together say they hold, and which members do, in order."""
    return members.groupBy("namespace").agg(F.sum("keys").alias("replicas"), F.array_join(F.array_sort(F.collect_set(by)), ",").alias("members"))
