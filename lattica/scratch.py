"""Tables written in the cluster's shared folder: they cut lineage, and a lost executor reads them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .config import checkpoint_folder


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    checkpoint_folder(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that is deleted when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, stored as Parquet and read back."""
    folder = new_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
