"""Intermediate results of loops, written where all executors can read them."""

from __future__ import annotations

import getpass
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new folder below that of ``spark.checkpoint.dir``, deleted when the application ends.

    Only on a local master, where the setting may be absent, the local temp folder stands in.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints/{getpass.getuser()}"
    uri = f"{root.rstrip('/')}/level-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return uri


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a new shared folder and read back: a short lineage that outlives executors."""
    uri = new_folder(df.sparkSession)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
