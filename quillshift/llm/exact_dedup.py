"""Exact deduplication by skew-safe combining (DataFrame functions only).

Rows are combined on the map side, merged within salted digest groups, and the salt winners
are then combined globally.  Text is part of the grouping key at every stage, so equality
always means equal content; the digest only routes rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillshift.llm.common import checkpointed, table


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    The row with the largest id of a group of equal texts stays.  A null text counts as
    empty; nothing else is normalised.  A null id never wins over another id; a group whose
    ids are all null keeps one row and has a null ``keep_id``.  Of repeated rows (same id
    and text) one is kept.  An empty table gives an empty table.  Other columns are ignored.

    ``digest`` routes rows only (default SHA-256): two texts that share a digest stay apart.
    """
    route = digest or (lambda c: F.sha2(c, 256))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = base.select("doc_id", "text", route(F.col("text")).alias("digest"))

    # map-side partial aggregation is the local pass; the salt keeps a hot digest apart
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = (
        salted.repartition(F.col("digest"))
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("digest")))
        .select(F.col("digest").alias("w_digest"), "keep_id", "group_size", "texts",
                F.when(F.col("texts") > 1, F.col("text")).alias("w_text"))
    )
    winners = checkpointed(winners)
    clash = not winners.filter("texts > 1").isEmpty()

    # one row per (text, id) with its number of repeats: hot repeats shrink before the join
    key = ["digest", "doc_id", *(["text"] if clash else [])]
    if digest is not None:
        key.append("sha")
        rows = rows.withColumn("sha", F.sha2("text", 256))
    members = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("repeats"))
    same = F.col("digest") == F.col("w_digest")
    if clash:
        same = same & (F.col("w_text").isNull() | (F.col("w_text") == F.col("text")))
    joined = members.join(winners, same)
    null_wins = F.col("keep_id").isNull() & F.col("doc_id").isNull()
    return joined.select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("nth")
    ).select(
        "doc_id", "keep_id", "group_size",
        (((F.col("doc_id") == F.col("keep_id")) | null_wins) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha" if digest is not None else "digest").alias("text_sha256"),
    ).withColumn("kept", F.coalesce("kept", F.lit(False)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of equal texts of all ``documents`` and which row of each stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
