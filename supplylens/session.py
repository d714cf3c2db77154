"""Session helpers: a tuned builder and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "supplylens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on; extra settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session (one process) without that setting gets a new temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, and later reads take only the columns they need."""
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.drop(*void).write.parquet(path)
    rows = df.sparkSession.read.schema(T.StructType([f for f in df.schema.fields if f.name not in void])).parquet(path)
    return rows.select(*[F.lit(None).alias(f.name) if f.name in void else F.col(f"`{f.name}`") for f in df.schema.fields])


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores before costly row work, if its sources are so small that their scan may have fewer tasks."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < size < cores * (32 << 20) else df


def stored(df: DataFrame) -> bool:
    """True if ``df`` only picks columns from a written table, so that reading it once for each column repeats no work."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    return plan.nodeName().startswith("Relation") or plan.nodeName() == "LogicalRelation"
