"""Alignment counts over long component tables (row_id, side, ord, key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillshift.functions.text import key_normalize


def _side(components: DataFrame, side: str, prefix: str) -> DataFrame:
    return components.filter(F.col("side") == side).select("row_id", F.col("key").alias(f"{prefix}key"), F.col("value").alias(f"{prefix}value"))


def same_values(components: DataFrame) -> DataFrame:
    """(okey, ikey, n): equal normalised values under different keys in more than half of the rows."""
    outs = _side(components, "out", "o").withColumn("v", key_normalize(F.col("ovalue")))
    ins = _side(components, "in", "i").withColumn("v", key_normalize(F.col("ivalue")))
    rows = components.filter("side = 'out'").agg(F.count_distinct("row_id").alias("rows"))
    votes = outs.join(ins, ["row_id", "v"]).filter("okey <> ikey").groupBy("okey", "ikey").agg(F.count(F.lit(1)).alias("n"))
    return votes.join(F.broadcast(rows), F.col("n") > F.floor(F.col("rows") / 2)).select("okey", "ikey", "n")


def constants(components: DataFrame, share: float = 0.75) -> DataFrame:
    """(key, value, n): output components with one value in at least ``share`` of the rows."""
    outs = components.filter("side = 'out'")
    rows = outs.agg(F.count_distinct("row_id").alias("rows"))
    votes = outs.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return votes.join(F.broadcast(rows), F.col("n") >= share * F.col("rows")).select("key", "value", "n")


def before_counts(components: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, n): in how many outputs the value of key a is found before that of key b."""
    at = (
        components.filter("side = 'out' and trim(value) <> ''").join(texts, "row_id")
        .select("row_id", "key", F.position(F.col("value"), F.col("output")).alias("at")).filter("at > 0")
    )
    a, b = at.select("row_id", F.col("key").alias("a"), F.col("at").alias("at_a")), at.select("row_id", F.col("key").alias("b"), F.col("at").alias("at_b"))
    return a.join(b, "row_id").filter("at_a < at_b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def common_programs(programs: DataFrame) -> DataFrame:
    """(cluster_id, key, program) of programs that every example of a cluster and key has."""
    total = programs.groupBy("cluster_id", "key").agg(F.count_distinct("row_id").alias("rows"))
    each = programs.groupBy("cluster_id", "key", "program").agg(F.count_distinct("row_id").alias("n"))
    return each.join(total, ["cluster_id", "key"]).filter("n = rows").select("cluster_id", "key", "program")
