"""The folder that driver and executors share, tables staged in it, and Arrow batch limits."""

from __future__ import annotations

import atexit
import gc
import itertools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BATCH_BYTES = 4 << 20
SWEEP_EVERY = 3  # staged tables after which the driver collects its garbage


_own: dict[str, str] = {}
_written = itertools.count(1)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (local runs and tests) a temporary folder, the same for the whole application."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own.get(spark.sparkContext.applicationId)
    if not found:
        own = tempfile.mkdtemp(prefix="polyquery-")
        atexit.register(shutil.rmtree, own, True)
        found = _own[spark.sparkContext.applicationId] = f"file://{own}"
    return found.rstrip("/")


def limits(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, so that very long texts don't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def staged(df: DataFrame, what: str = "t") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, without lineage, there after an executor is lost.

    Each SWEEP_EVERY tables the driver collects its garbage, so that its heap doesn't grow by the plans of the tables before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if next(_written) % SWEEP_EVERY == 0:
        swept(spark)
    return spark.read.schema(df.schema).parquet(path)


def folders(table: DataFrame) -> set[str]:
    """Where a staged table's files lie: in one folder, or none if it has no files."""
    return {f.rsplit("/", 1)[0] for f in table.inputFiles()}


def all_staged(tables: list[DataFrame], *columns: str) -> DataFrame:
    """The rows of staged tables that have these columns alike, by one scan: a union's plan would grow with each table."""
    one, paths = tables[0].select(*columns), sorted(set().union(*map(folders, tables)))
    return one.sparkSession.read.schema(one.schema).parquet(*paths) if paths else one


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes files and folders, wherever Spark can write them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame | None) -> None:
    """Removes staged tables that no later step reads."""
    for t in tables:
        if t is not None:
            remove(t.sparkSession, *folders(t))


def swept(spark: SparkSession) -> None:
    """The driver collects its garbage, between the rounds of a loop: only then do the plans of earlier rounds go, and with them the
    broadcasts and shuffle files that executors hold for them. Else its heap grows by each round's plans."""
    gc.collect()
    spark._jvm.System.gc()


def local_path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put_file(uri: str, data: bytes) -> None:
    """Writes one file whole: under another name first, so that a task that runs twice leaves one full copy."""
    if at := local_path(uri):
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(f"{at}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(f.name, at)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(tmp := f"{at}.{uuid.uuid4().hex}") as f:
        f.write(data)
    store.move(tmp, at)


def map_file(uri: str):
    """The file's bytes, memory-mapped. A remote file is copied to a nameless local one first."""
    import mmap

    if at := local_path(uri):
        with open(at, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as f, store.open_input_stream(at) as src:
        while block := src.read(8 << 20):
            f.write(block)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)


def running(df: DataFrame, keys: list[str], by: Column, order: list[Column], weight: Column, name: str, rows_per_bucket: int = 2_000, rows: int | None = None, ordered: bool = False) -> DataFrame:
    """Adds `name`: the sum of `weight` over the rows of the same keys before this one, in the order of (bucket of `by`, order).

    by: a uniform 64-bit hash, or, if ordered, numbers from 0 up to about `rows` whose order counts. They deal
    the rows of each key into buckets, so that a key that holds most rows is still spread over many
    tasks: bucket totals are pre-aggregated and summed over (at most 65,536 per key), and a window runs
    inside each bucket only. A null key is a key of its own.
    """
    rows = df.count() if rows is None else rows
    bits = max(0, min(16, (max(rows, 1) // rows_per_bucket).bit_length()))
    bucket = (by / F.lit(max(1.0, rows / (1 << bits)))).cast("int") if ordered else F.shiftrightunsigned(by, 64 - bits).cast("int") if bits else F.lit(0)
    null_safe = [F.when(F.col(k).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(k).cast("string"))).alias(f"_k{i}") for i, k in enumerate(keys)]
    df = df.select("*", bucket.alias("_b"), *null_safe)
    ks = [f"_k{i}" for i in range(len(keys))]
    totals = df.groupBy(*ks, "_b").agg(F.sum(weight).alias("_w"))
    before = totals.select(*ks, "_b", F.coalesce(F.sum("_w").over(W.partitionBy(*ks).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*ks, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return df.join(before, [*ks, "_b"]).withColumn(name, F.col("_before") + F.col("_inside")).drop(*ks, "_b", "_before", "_inside")


def ready(spark: SparkSession) -> None:
    """Arrow limits, and the package on the workers' path where the driver found it by sys.path alone."""
    limits(spark)
    import polyquery

    root = os.path.dirname(os.path.dirname(os.path.abspath(polyquery.__file__)))
    known = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p} | {os.getcwd()}
    if root in known or "polyquery.zip" in spark.sparkContext._python_includes:
        return
    import zipfile

    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "polyquery.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "polyquery")):
            for n in names:
                if n.endswith(".py"):
                    z.write(full := os.path.join(folder, n), os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
