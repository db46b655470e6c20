"""Results cut from their lineage, in the folder that the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session without one, a temporary folder that goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _own:
        own = tempfile.mkdtemp(prefix="polyquery-")
        atexit.register(shutil.rmtree, own, True)
        _own[spark.sparkContext.applicationId] = f"file://{own}"
    return _own[spark.sparkContext.applicationId]


_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept by a reliable checkpoint."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
