"""Company snapshot and health record read / write.

Snapshots are directories (one JSON Lines or parquet part per task), not single files: a
cluster job writes in parallel. ``ord`` (the internal tie-break) travels with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_index.operators.ranking import with_rank
from career_index.storage import stored

COMPANY_SCHEMA = ("name string, website string, career_page_url string, country_of_origin string, source string, "
                  "jobs array<struct<title:string,url:string>>, ord long")
FIELDS = ("name", "website", "career_page_url", "country_of_origin", "source", "jobs")
HEALTH_SCHEMA = ("generated_at_utc string, candidates struct<wikipedia:bigint, wikipedia_global:bigint, "
                 "eu_startups:bigint, clutch:bigint, themanifest:bigint, total_raw:bigint, total_deduped:bigint>, "
                 "enriched_with_careers bigint, final_merged bigint, final_by_source map<string,bigint>")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _load(spark: SparkSession, path: str, fmt: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Rows of a snapshot: one object per line, or one JSON array over many lines in a single file."""
    reader = spark.read.schema(COMPANY_SCHEMA).option("mode", mode)
    if fmt != "json":
        return reader.format(fmt).load(path)
    # One character decides, whatever the length of the first line.
    head = spark.read.text(path).select(F.left(F.ltrim("value"), F.lit(1)).alias("c")).where("c != ''").limit(1).collect()
    return reader.option("multiLine", bool(head) and head[0][0] == "[").json(path)


def _with_ord(df: DataFrame) -> DataFrame:
    """Rows keep their own ``ord``; those without one follow all others, in the order of the files, their parts, and the places there."""
    if df.where("ord IS NULL").isEmpty():
        return df
    # A task reads a part from its start on, so this number rises with the place; the table is written once, so it can't change between uses.
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"),
                       F.monotonically_increasing_id().alias("_at"))
    placed = stored(placed, "snapshot")
    last = placed.agg(F.max("ord")).first()[0]
    own = placed.where("ord IS NOT NULL").drop("_file", "_part", "_at")
    rest = with_rank(placed.where("ord IS NULL").drop("ord"), "_file", "_part", "_at", rank_col="ord").drop("_file", "_part", "_at")
    return own.unionByName(rest.withColumn("ord", F.col("ord") + F.lit(-1 if last is None else last)))


def read_companies(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Snapshot for merging; a missing path gives an empty table; rows that are not
    objects (no fields) are dropped. Without ``ord`` in the data, file order is used."""
    if not _exists(spark, path):
        return spark.createDataFrame([], COMPANY_SCHEMA)
    df = _with_ord(_load(spark, path, fmt))
    return df.where(" OR ".join(f"{c} IS NOT NULL" for c in FIELDS))


def read_served_companies(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Snapshot for serving: all six fields present, non-empty career page; corrupt input
    is an error (FAILFAST)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], COMPANY_SCHEMA)
    df = _with_ord(_load(spark, path, fmt, "FAILFAST"))
    df = df.where(" AND ".join(f"{c} IS NOT NULL" for c in FIELDS)).where("career_page_url != ''")
    return df.orderBy(F.lower("name"), "ord")


def write_companies(df: DataFrame, path: str, fmt: str = "json") -> None:
    """S3: overwrite the snapshot directory (UTF-8 JSON Lines or parquet)."""
    cols = ["name", "website", "career_page_url", "country_of_origin", "source", "jobs", "ord"]
    df.select(*cols).write.mode("overwrite").format(fmt).save(path)


def write_health(df: DataFrame, path: str) -> None:
    """S4 (write): the one-row health record."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """S4 (read): the health record, or a one-row message when none was written yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([("No source health data found yet.",)], "message string")
    return spark.read.schema(HEALTH_SCHEMA).option("mode", "FAILFAST").json(path)
