"""Tables of a corpus folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A Parquet table. With ``key``, one in fewer files than half the cores is dealt to all cores by a salted hash of that column.

    A file of one row group is one task's work however large the cluster and however small its splits, so
    texts in a few files would be worked on by a few cores. Tables in many files, as large ones are,
    aren't shuffled. The salt keeps plans from taking the deal for a partitioning by the column.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, F.xxhash64(key, F.lit(name))) if key and 2 * len(df.inputFiles()) < cores else df


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; it goes when the driver ends.

    Where that is unset, a local session (tests) gets a temporary folder; a cluster must name one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    folder = f"{shared.rstrip('/')}/glotta-{name}-{uuid.uuid4().hex}"
    own = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(own)
    fs.deleteOnExit(own)
    return folder
