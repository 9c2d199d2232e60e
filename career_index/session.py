"""SparkSession helpers shared by tests, the bench and the driver entry points."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "career_index") -> SparkSession:
    """Session for local runs (tests, bench). On a cluster the caller supplies its own session."""
    master = master or os.environ.get("CAREER_INDEX_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CAREER_INDEX_DRIVER_MEMORY", "8g"))
    for k, v in _DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is a folder that the driver and all executors share; without it the call
    fails, because files in a machine-local folder would be lost to other nodes. Only a session
    with master ``local`` (tests, bench), where everything runs on one machine, gets a scratch
    folder of its own.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="career-index-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir
