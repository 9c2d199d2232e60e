"""Helpers shared by the operators: written intermediate tables, bindings inside expressions, row filters."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from career_index.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; driver and executors share it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The plan is cut there: later jobs, retries and lost executors read the files instead of
    running the work again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame):
    """(file system, path) of the written tables that ``df`` reads from the shared folder."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/").split(":", 1)[-1]
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            yield path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that no later plan reads."""
    for fs, path in _folders(df):
        fs.delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver collect plans that nothing refers to any more; Spark then deletes their shuffle files.

    Worth calling between written tables of a long job, whose shuffle files otherwise stay until the driver happens to collect garbage.
    """
    gc.collect()
    spark._jvm.System.gc()


def small_side(df: DataFrame, limit_bytes: int = 32 << 20) -> DataFrame:
    """A materialised table for one side of a join: broadcast if its files are within the limit, else shuffled like the other side."""
    written = sum(fs.getContentSummary(path).getLength() for fs, path in _folders(df))
    return F.broadcast(df) if written <= limit_bytes else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows of a table apart: the id and a hash of the text. Rows equal in both are one document repeated."""
    return [F.col(id_col).cast("long").alias("k_id"), F.xxhash64(text_or_empty(text_col)).alias("k_hash")]


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose key has a true ``kept`` in ``verdicts`` (k_id, k_hash, kept), one for each key.

    All columns of ``docs`` come back unchanged. The rejected keys are the narrow side of an anti
    join. Repeated rows are rare, so only their keys go through a shuffle of whole rows.
    """
    again = verdicts.groupBy("k_id", "k_hash").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    again = small_side(materialize(again.filter((F.col("n") > 1) | ~F.col("kept")), "verdicts"))
    k_id, k_hash = row_key(id_col, text_col)
    cond = lambda side: k_id.eqNullSafe(side["k_id"]) & (k_hash == side["k_hash"])
    out = docs.join(again, cond(again), "left_anti")
    repeated = again.filter("kept")
    if repeated.isEmpty():
        return out
    found = docs.join(repeated, cond(repeated), "left_semi")
    return out.unionByName(found.withColumn("__k", F.struct(k_id, k_hash)).dropDuplicates(["__k"]).drop("__k"))
