"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a table beyond which a join sorts it instead of sending it whole to driver and executors.
LARGE = 1 << 18

#: Rows of one task where a join or a grouping is dealt by their number.
TASK = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one if the master is local, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, under this application's tables."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read back: cuts lineage, and a lost executor costs nothing that came before."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df for joins that sort and merge: never sent whole to the driver, however small its files. Columns of ids compress well, so
    Spark would take a table of millions of rows for a small one and build a hash table of it in the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df by keys in tasks of about TASK rows, if so many rows (its own or those it is joined with) are dealt; left to Spark if rows is None.

    What Spark sizes by shuffled bytes can be millions of rows, since ids compress well; by rows, a task's memory doesn't grow with the
    table, however few partitions the session has. A join's other side follows where it isn't dealt yet."""
    return df if rows is None else df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1 + rows // TASK), *keys)


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """written(), and how many rows it has."""
    path, seen = fresh(df.sparkSession, label), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"] or 0


def side(df: DataFrame, rows: int) -> DataFrame:
    """df of so many rows as the side of a join: sent whole up to LARGE rows, so that the other side stays where it is; else kept apart()."""
    return F.broadcast(df) if rows <= LARGE else apart(df)


def written_rows(df: DataFrame, label: str) -> DataFrame:
    """written(), for tables that grow with the graph: one of more than LARGE rows is kept apart()."""
    back, rows = counted(df, label)
    return apart(back) if rows > LARGE else back


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) as Hadoop objects, whatever the store."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())
