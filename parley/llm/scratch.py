"""Written tables between the jobs of one operator, in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parley.session import ensure_checkpoint_dir


class Scratch:
    """A folder of its own beside the checkpoints. A table written there cuts lineage as a
    checkpoint does, is compressed, and tells the planner its size."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        """Delete a table that nothing reads any more, or the whole folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
