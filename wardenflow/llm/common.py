"""Shared helpers: table access, lineage cuts in the shared folder, row counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract of this subpackage: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local session gets a temporary one; a cluster must name one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='wardenflow-')}"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def settle(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage in a way that survives lost executors and lets later plans see true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what :func:`settle` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, table: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has each ``key`` once, where a key may hold a large part of ``rows``.

    At most ``most`` keys can hold a ``most``-th of the rows each; their rows of ``table`` are broadcast, the others shuffled.
    """
    n = rows.count()
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n__")).filter((F.col("n__") >= 64) & (F.col("n__") * most >= n)).select(key)
    hot = settle(hot, "hot_keys")
    if hot.isEmpty():
        return rows.join(table, key)
    few = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))
    others = rows.join(F.broadcast(hot), key, "left_anti").join(table, key)
    return rows.join(few, key).unionByName(others)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor
