"""Tables of one run below ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A written table cuts lineage: a lost executor costs only the tasks that it ran. Tables go when Spark ends.

    A local session without that setting uses a temporary folder of its own; a cluster has to name one that driver and executors share.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = f"file://{os.path.join(tempfile.gettempdir(), 'pelagia-scratch')}"
        self.spark, self.root, self.marked = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", False

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again."""
        df.write.parquet(f"{self.root}/{name}")
        if not self.marked:
            context = self.spark.sparkContext
            root = context._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(root)
            self.marked = True
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
