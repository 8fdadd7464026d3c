"""Two-column example tables: scans, roles, and the id space of inputs and example outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "input string, output string"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV (RFC quoting, UTF-8, byte-order mark allowed) as (dataset, row_id, input, output).

    Columns are strings; nothing is inferred and no text means null.  ``row_id`` is the line's
    place in its file: files are scanned whole, so a dataset is numbered within one small task.
    """
    raw = (
        spark.read.schema(SCHEMA).option("escape", '"').option("multiLine", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
        .select(F.col("_metadata.file_name").alias("file"), "input", "output")
        .withColumn("place", F.monotonically_increasing_id())
    )
    order = Window.partitionBy("file").orderBy("place")
    return raw.select(
        F.regexp_replace("file", r"\.csv$", "").alias("dataset"), (F.row_number().over(order) - 1).cast("long").alias("row_id"),
        F.regexp_replace(F.coalesce("input", F.lit("")), "^﻿", "").alias("input"), F.coalesce("output", F.lit("")).alias("output"),
    )


def with_roles(rows: DataFrame, examples: int) -> DataFrame:
    """Add ``role``: the first ``examples`` ids are examples, the others queries."""
    return rows.withColumn("role", F.when(F.col("row_id") < examples, "example").otherwise("query"))


def examples(rows: DataFrame, k: int) -> DataFrame:
    return rows.filter(F.col("row_id") < k)


def truth(rows: DataFrame, first: int = 5) -> DataFrame:
    """Rows that count in an evaluation, whatever the number of examples."""
    return rows.filter(F.col("row_id") >= first).select("row_id", "output")


def cluster_input(rows: DataFrame, outputs: int = 5) -> DataFrame:
    """(row_id, side, text): all inputs and the first outputs."""
    return rows.select("row_id", F.lit("in").alias("side"), F.col("input").alias("text")).unionByName(
        rows.filter(F.col("row_id") < outputs).select("row_id", F.lit("out").alias("side"), F.col("output").alias("text"))
    )


def cluster_strings(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """(cluster_id, row_id, input) of cluster members."""
    return clusters.join(rows.select("row_id", "input"), "row_id").select("cluster_id", "row_id", "input")


def mock_rows(spark: SparkSession) -> DataFrame:
    """A small table in two formats, for trials."""
    pairs = [("12/31/1999", "1999-12-31"), ("07.04.2001", "2001-04-07"), ("01/02/2003", "2003-01-02"), ("30.06.2010", "2010-06-30")]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "row_id long, input string, output string")
