"""A table that batches are merged into, each once: buckets of Parquet files and a manifest of what each batch has written."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "number long, bucket int, path string"


class VersionedTable:
    """A keyed table below `root`, in `buckets` by a hash of its keys.

    A batch writes new files of the buckets it touches, then one file of the manifest (number, bucket, path), which Spark
    makes visible as a whole: before, nothing of the batch counts; after, all of it. A batch whose number the manifest
    has is not merged again. So a stream that stops anywhere and starts anew finds its state and loses or repeats
    nothing. Files of stopped batches and of earlier versions stay until the folder is cleared. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifest(self) -> DataFrame | None:
        """What batches have written; None before the first one."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def state(self) -> tuple[int | None, dict[int, str]]:
        """The last batch's number, and where each bucket is: a row a bucket reaches the driver."""
        manifest = self.manifest()
        if manifest is None:
            return None, {}
        last = manifest.agg(F.max("number")).first()[0]
        at = manifest.where("bucket >= 0").groupBy("bucket").agg(F.max_by("path", "number").alias("path")).collect()
        return last, {r["bucket"]: r["path"] for r in at}

    def files(self, at: dict[int, str], wanted: set[int] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(at.items()) if wanted is None or b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.files(self.state()[1])

    def create(self, initial: DataFrame) -> None:
        """The rows to begin with, as batch -1; does nothing if the table is there."""
        self.merge(-1, initial, lambda _, new: new)

    def merge(self, number: int, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Lays `new` on the table by how(old, new), once for each number; numbers rise. False if it has been done.

        `new` has the keys; `how` gets the rows of the buckets that it touches, and returns those buckets' new rows."""
        last, at = self.state()
        if last is not None and number <= last:
            return False
        touched = {r[0] for r in new.select(self.bucket().alias("b")).distinct().collect()}
        version = f"{self.root}/versions/{number}-{uuid.uuid4().hex}"
        rows = how(self.files(at, touched), new).select(*self.schema.fieldNames())
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(version)
        written = {r[0] for r in self.spark.read.parquet(version).select("bucket").distinct().collect()} if touched else set()
        # A batch of no rows leaves a mark too.
        entries = [(number, b, f"{version}/bucket={b}") for b in sorted(written)] or [(number, -1, "")]
        self.commit(entries)
        return True

    def commit(self, entries: list[tuple[int, int, str]]) -> None:
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
