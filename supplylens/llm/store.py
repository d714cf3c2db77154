"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A new folder under ``spark.checkpoint.dir`` for one job's tables.

    Lineage is cut by writing a table and reading it back, so a lost executor costs only
    the tasks it was running. Aggregates that are joined back are written first: the join then
    reads two plain shuffles, and adaptive execution may split the rows of a very common key or
    broadcast the side that has turned out small. Only a local session without the setting makes its own folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._tables = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table."""
        self._tables += 1
        path = f"{self.root}/t{self._tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
