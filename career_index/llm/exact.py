"""Exact deduplication with keyed streaming state (operator 7, native).

Every row is reduced to a locator: digest, id and source file. The locators run through a
Structured Streaming aggregation without a watermark, so its state never expires; RocksDB keeps it
on disk under the shared folder. The state holds, per digest, the stable identifier that stays, its
content locator and the number of rows, and is read back with the state data source. Partial
aggregation runs before the shuffle, so a digest that a third of all rows share reaches its state
partition as one row from each task.

A digest found twice is a hit. Hits are checked on the full bytes of every member: the least and the greatest text
of a group must agree. Digests whose members differ are grouped anew by their text.

Defined results: null text equals empty text. Null ids sort before all others. Rows with equal id and
text are one document repeated and share a verdict. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import keep_rows, materialize, row_key, scratch_path, small_side, text_or_empty

#: Keyed state on disk, with one memory bound for all stores of an executor and no disk space set aside for small stores.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_state(locators: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_source, group_size): the state after all locators (digest, doc_id, source) have streamed through."""
    spark = locators.sparkSession
    where = scratch_path(spark, "exact-state")
    locators.write.parquet(f"{where}/locators")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(locators.schema).parquet(f"{where}/locators")
        state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "source")).alias("keep"), F.count(F.lit(1)).alias("n"))
        run = (state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
               .option("checkpointLocation", f"{where}/checkpoint").start())
        run.awaitTermination()
        seen = run.lastProgress is not None
        found = spark.read.format("statestore").load(f"{where}/checkpoint") if seen else None
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if found is None:
        return spark.createDataFrame([], "digest string, keep_id long, keep_source string, group_size long")
    return found.select("key.digest", F.col("value.max.doc_id").alias("keep_id"), F.col("value.max.source").alias("keep_source"),
                        F.col("value.count").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, k_hash.

    Of equal texts the row with the largest id stays. ``digest`` may be any hash of the text; the
    byte check makes the result right for weak ones too.
    """
    text = text_or_empty(text_col)
    k_id, k_hash = row_key(id_col, text_col)
    rows = docs.select(k_id.alias("doc_id"), digest(text).alias("digest"), sha256(text).alias("text_sha256"), k_hash,
                       F.input_file_name().alias("source"))
    rows = materialize(rows, "exact-rows")
    state = materialize(keyed_state(rows.select("doc_id", "digest", "source")), "exact-state-rows")
    hits = small_side(materialize(state.filter("group_size > 1").select("digest"), "exact-hit-digests"))
    members = docs.select(digest(text).alias("digest"), text.alias("body")).join(hits, "digest")
    members = materialize(members, "exact-hits")  # read back without a partitioning, so that a hot group is combined before the shuffle
    # All bytes of a group agree if its least and greatest text do; both are combined before the shuffle.
    differ = members.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low != high").select("digest")
    differ = materialize(differ, "exact-collisions")
    columns = ("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "k_hash")
    if differ.isEmpty():
        return rows.join(state, "digest").select(*columns)
    plain = rows.join(differ, "digest", "left_anti").join(state, "digest").select(*columns)
    mixed = docs.select(k_id.alias("doc_id"), digest(text).alias("digest"), sha256(text).alias("text_sha256"), k_hash, text.alias("body"))
    mixed = mixed.join(differ, "digest", "left_semi")
    by_text = mixed.groupBy("body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return plain.unionByName(mixed.join(by_text, "body").select(*columns))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns."""
    groups = exact_groups(docs, id_col, text_col)
    return keep_rows(docs, groups.select(F.col("doc_id").alias("k_id"), "k_hash", "kept"), id_col, text_col)
