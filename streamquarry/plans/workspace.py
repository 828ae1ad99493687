"""Written intermediate tables: the only way lineage is cut in this package.

A step that would otherwise grow the plan without end (one level of a
discovery run) is written as parquet to the folder the cluster names in
``spark.checkpoint.dir`` and read back.  The folder must be shared by all
nodes, so losing an executor costs at most the level that is being computed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Largest row count of a table that is sent to every executor.  Rows of the
# tables that are checked against it (queries, candidates, dictionaries) are
# some hundred bytes wide, so this is tens of megabytes at most.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the cluster's, else the session's checkpoint folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    return configured.rstrip("/")


def write_step(df: DataFrame, label: str = "step") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back with a fresh plan; also the folder.

    Rows are counted while they are written, see ``shuffled_if_large``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return shuffled_if_large(spark.read.schema(df.schema).parquet(path), written.get["n"]), path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written and read back; the folder stays as long as the shared folder does."""
    return write_step(df, label)[0]


def delete_steps(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``write_step`` has made, wherever the shared folder lies."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast a side whose counted rows stay below ``BROADCAST_ROWS``.

    A larger side is returned as it is: the join then shuffles and adaptive
    execution splits skewed partitions.
    """
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def shuffled_if_large(df: DataFrame, n_rows: int) -> DataFrame:
    """The counterpart: a side of more rows is never broadcast, unless a join asks for it.

    Spark takes the size of the files for the size of the rows. Sorted positions and short codes
    are a byte or two a row in a file and a hundred in memory, so millions of rows can seem to fit.
    """
    return df.hint("merge") if n_rows > BROADCAST_ROWS else df
