"""Tables written to the cluster's shared folder to cut lineage, and their removal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from particula.session import scratch_path


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, on whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
