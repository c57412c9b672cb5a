"""Lineage cuts that survive lost executors: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where none is set, a local session gets a temporary folder; a cluster must name one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='wardenflow-')}"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark).split(":", 1)[-1].strip("/")
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
