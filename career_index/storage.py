"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from career_index.session import ensure_checkpoint_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: every later use sees the same rows, and no lineage is run again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables written by ``stored`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_stored_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
