"""Tables and checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting to remove a query's shuffle files at its end.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, below a folder of our own if Spark runs in one process
    (tests), else an error: no other folder is known to be shared."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: no lineage, nothing that a lost executor takes along. What was
    shuffled for them leaves the executors' disks when they are written."""
    path, conf = shared_path(rows.sparkSession, "table"), rows.sparkSession.conf
    old = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        rows.write.parquet(path, compression="zstd")
    finally:
        conf.set(FREED, old) if old else conf.unset(FREED)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by their keys to as many tasks as a shuffle has, for work on each row that a small file's one task
    would do alone."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
