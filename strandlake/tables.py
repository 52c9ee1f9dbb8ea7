"""Working tables in the shared folder, and small helpers on DataFrames."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is made,
    recorded in the session's runtime conf and removed when the process ends. On a cluster it is an error.
    """
    key = "strandlake.shared"
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(key, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, never a recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Delete the files of working tables that no later plan reads."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, folder)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def ranges(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` written in ranges of (by, order), each with the number ``part_no`` of its range.

    Ranges rise with the order, and a large group has several. They are written, as the sampled
    bounds may differ when a task is run again.
    """
    return stage(rows.repartitionByRange(by, *order).withColumn("part_no", F.spark_partition_id()), "ranges")


def number(rows: DataFrame, by: str, *order: str, name: str = "seq_index") -> DataFrame:
    """``rows`` with their place from 0 in each group, by ``order``; no task gets a whole group.

    Places inside a range are shifted by the rows of the ranges before it. Rows that are equal in
    ``by`` and ``order`` share a range, so the order should tell rows apart; a ``name`` that is
    among the columns is replaced.
    """
    cut = ranges(rows, by, *order)
    counts = cut.groupBy(by, "part_no").agg(F.count(F.lit(1)).alias("rows_here"))
    before = Window.partitionBy(by).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col(by).alias("group_of"), F.col("part_no").alias("part_of"), F.coalesce(F.sum("rows_here").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy(by, "part_no").orderBy(*order)) - 1
    both = cut.withColumn("place_here", own).join(shift, F.col(by).eqNullSafe(F.col("group_of")) & (F.col("part_no") == F.col("part_of")))
    return both.withColumn(name, (F.col("place_here") + F.col("shift")).cast("int")).drop("part_no", "place_here", "group_of", "part_of", "shift")


def columns_apart(df: DataFrame, *wanted: str) -> DataFrame:
    """Just the wanted columns, so that a caller's extra columns never clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])
