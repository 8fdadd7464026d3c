"""Lineage cuts by tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where all runs in one local process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillshift-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Unlike a checkpoint's, the size of a table that is read is that of its files: in loops of joins the sizes that
    Spark derives for plans would square from round to round.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 1_000_000, size: int = 64 << 20) -> DataFrame:
    """``df``, marked for broadcasting if it has at most ``rows`` rows of ``size`` bytes as text, which is measured."""
    some = df.limit(rows + 1).select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if some[0] <= rows and some[1] <= size else df


def slices(spark: SparkSession, rows: int = 0, each: int = 2_000) -> int:
    """In how many partitions rows that are small but dear to work on keep all cores busy, with about ``each`` rows in one if they are many."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: rows that are small but dear to work on else come in few partitions, which are cut by bytes."""
    return df.repartition(slices(df.sparkSession))
