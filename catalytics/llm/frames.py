"""Spark helpers shared by the operators: tables, row keys, written intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the master is local and it is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows as Parquet in the shared folder and read them back.

    The written table ends the lineage: a lost executor repeats only the step that was running.
    The shuffle files of the finished step are then free; asking the driver's JVM to collect
    its garbage lets Spark's cleaner remove them before the next step writes its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    for _ in range(2):                                    # Python's handles on plans keep their shuffles, too
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.cut_path = path
    return out


def drop(*steps: DataFrame) -> None:
    """Remove written steps that nothing reads any more: what was made of them is written too."""
    for df in steps:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def row_key(df: DataFrame, id_column: str, text_column: str) -> tuple[Column, Column]:
    """Two longs naming a row: rows that share both hold the same text, even where ids are null or repeated."""
    return (F.xxhash64(df[id_column].cast("string")).alias("__k1"), F.xxhash64(df[text_column].cast("string")).alias("__k2"))
