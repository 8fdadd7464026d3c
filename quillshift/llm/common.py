"""Helpers shared by the training-data operators: lineage cuts, salts, union-find."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the cluster names none (tests on one machine) a folder of our own is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillshift-"))
    return sc.getCheckpointDir()


def by_bytes(df: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """``df``, to be sent to Python in Arrow batches of about ``limit`` bytes at most.

    Spark's own bound is 64 MB; one that the session sets is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(limit))
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compacted(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` checkpointed, and once more in a partition for each ``rows`` rows where these are fewer by half.

    For what a loop keeps of its rounds: else each small round leaves a file, and a task to all later ones, for each partition.
    """
    held = checkpointed(df)
    wanted = max(1, -(-held.count() // rows))
    return checkpointed(held.coalesce(wanted)) if 2 * wanted <= held.rdd.getNumPartitions() else held


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and checkpoints that nothing refers to any more.

    It follows the driver's garbage collection, which may not come for a whole run of small rounds.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that later steps read."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of our own in the shared folder that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, limit: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose string or binary ``column`` takes about ``limit`` bytes at most, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        reach = np.cumsum(sizes[at:])
        n = max(1, int(np.searchsorted(reach, limit, side="right")))
        yield batch.slice(at, n)
        at += n


def small(df: DataFrame, rows: int = 1_000_000, size: int = 64 << 20) -> DataFrame:
    """``df``, marked for broadcasting if it has at most ``rows`` rows of ``size`` bytes as text, which is measured."""
    some = df.limit(rows + 1).select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if some[0] <= rows and some[1] <= size else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find by alternating large-star and small-star rounds.

    ``edges`` has two columns of one orderable type; returns (node, comp) for every node
    that occurs in an edge, ``comp`` being the smallest node of its component.  Self loops
    give their node a row.  Neighbour minima are combined map-side and joined back, so a hub
    is never gathered in one task.  Each round is cut by a checkpoint.
    """
    a, b = edges.columns
    e = checkpointed(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col("u").isNotNull() & F.col("v").isNotNull())
        .distinct()
    )
    loops = e.filter("u = v").select("u")
    cur = e.filter("u <> v")
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u <> v").distinct()
        )
        cur = compacted(small)
        release(cur.sparkSession)
        # a fixed point: the same edges, and every node hangs on a root directly
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("union-find did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct()
    return (
        cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        .unionByName(roots.select("node", F.col("node").alias("comp")))
        .unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("comp")))
        .groupBy("node").agg(F.min("comp").alias("comp"))
    )
