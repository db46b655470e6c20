"""Change streams of versioned records with Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polyquery.operators import kv


def changes(spark: SparkSession, path: str, schema, keys: list[str] | None = None) -> DataFrame:
    """A stream of the log files that appear in a folder, filtered by key."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.where(F.col("key").isin(keys)) if keys else rows


VERSION = ("physical", "logical", "cluster", "member", "sequence")
FANOUT = 4  # runs of one size that become one run of the next


def runs(batches: int) -> list[tuple[int, int]]:
    """The runs (from, to) of batches that hold the state after so many batches: at most FANOUT - 1 of each power of FANOUT."""
    out, at, size = [], 0, 1
    while size * FANOUT <= batches:
        size *= FANOUT
    while size:
        while at + size <= batches:
            out.append((at, at + size))
            at += size
        size //= FANOUT
    return out


def keep_latest(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the winners of a stream as sorted-out runs under target, to be read by latest().

    A batch writes its own winners, and every FANOUT-th merges the runs before it into a longer one, so that a record is
    rewritten as often as the logarithm of the number of batches and not with each batch. What a batch writes depends on
    its number alone and is kept until the next batch runs, so a replayed batch writes its run again. A record's version
    decides, not its arrival: late, repeated and reordered records end in the same state.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        held = runs(number)
        for lo, hi in set(runs(number - 1)) - set(held) if number else ():
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{lo}-{hi}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        lo, hi = runs(number + 1)[-1]
        rows = kv.winners(batch)
        if inside := [f"{target}/{a}-{b}" for a, b in held if a >= lo]:
            rows = kv.winners(spark.read.schema(batch.schema).parquet(*inside).unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{target}/{lo}-{hi}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, target: str, schema) -> DataFrame:
    """The newest record of each key that keep_latest wrote, tombstones included."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    written = [f.getPath().getParent().getName() for f in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*/_SUCCESS"))]
    held = runs(max((int(name.split("-")[1]) for name in written), default=0))
    if not held:
        return spark.createDataFrame([], schema)
    return kv.winners(spark.read.schema(schema).parquet(*[f"{target}/{a}-{b}" for a, b in held]))


def expired(stream: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(namespace, key, version, expires_at) of records whose time ran out while they were their key's newest, once the watermark of event time passes.

    The stream holds (namespace, key, version, expires_at, tombstone); a record's physical time is its event time. Each
    key's newest record waits with a timer and is forgotten when that rings; tombstones and records that never expire
    stay as long as a late record could still lose against them.
    """
    rows = stream.select("namespace", "key", "version", "expires_at", "tombstone", F.timestamp_millis("version.physical").alias("at")).withWatermark("at", late)

    def newest(key, frames, state):
        if state.hasTimedOut:
            physical, logical, cluster, member, sequence, expires, dead = state.get
            state.remove()
            if not dead and expires is not None:
                version = {"physical": physical, "logical": logical, "cluster": cluster, "member": member, "sequence": sequence}
                yield pd.DataFrame({"namespace": [key[0]], "key": [key[1]], "version": [version], "expires_at": [expires]})
            return
        best = state.get if state.exists else None
        for frame in frames:
            for v, expires, dead in zip(frame["version"], frame["expires_at"], frame["tombstone"], strict=True):
                v = v if isinstance(v, dict) else v.asDict()
                one = (*(v[c] for c in VERSION), None if pd.isna(expires) else int(expires), bool(dead))
                best = one if best is None or one[:5] > best[:5] else best
        state.update(best)
        ends = best[0] if best[5] is None or best[6] else max(best[0], best[5])
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))

    version = "version struct<physical:bigint,logical:bigint,cluster:string,member:string,sequence:bigint>"
    held = "physical bigint, logical bigint, cluster string, member string, sequence bigint, expires_at bigint, tombstone boolean"
    return rows.groupBy("namespace", "key").applyInPandasWithState(newest, f"namespace string, key string, {version}, expires_at bigint", held, "append", "EventTimeTimeout")


def windowed(stream: DataFrame, ts: str, by: list[str], failed, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(by..., start, n, errors) over tumbling windows of event time, closed once the watermark passes."""
    rows = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.count_if(failed).alias("errors")).select(*by, F.col("w.start").alias("start"), "n", "errors")


def drained(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """What a stream holds by now, appended to target in one go and read again; a second call takes only what is new."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def observed(stream: DataFrame, kinds: list[str] | None = None, peers: list[str] | None = None) -> DataFrame:
    """Events (kind, peer, ...) of the kinds and peers asked for; nothing is dropped, so there are no gaps to mark."""
    rows = stream if kinds is None else stream.where(F.col("kind").isin(kinds))
    return rows if peers is None else rows.where(F.col("peer").isin(peers))
