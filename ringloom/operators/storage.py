"""Cutting lineage of iterative operators through the folder in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialised(df: DataFrame) -> DataFrame:
    """df written as compressed Parquet into the folder of checkpoints and read back; the shuffle files made for it go at
    once, the table with the session. A session without a checkpoint folder on one
    machine (tests) gets a temporary one, a cluster must name its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ringloom-"))
    path = f"{sc.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    atexit.register(_dropped, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _dropped(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone; the folder is the cluster's to clear
        pass
