"""The relational shapes that example-based transformation needs, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillshift.sources.shared import small


def semi(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows that have an example."""
    return rows.join(ids.select(on), on, "left_semi")


def anti(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows that have none."""
    return rows.join(ids.select(on), on, "left_anti")


def ordered_pairs(rows: DataFrame, key: str, within: str) -> DataFrame:
    """(within, a, b) with a < b among the distinct keys of each group."""
    each = rows.select(within, key).distinct()
    return each.withColumnRenamed(key, "a").join(each.withColumnRenamed(key, "b"), within).filter("a < b")


def products(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of one table with every row of another (models by modes); ``right`` is broadcast if it is small."""
    return left.crossJoin(small(right))


def prefix_join(texts: DataFrame, prefixes: DataFrame, text: str, prefix: str) -> DataFrame:
    """Texts with the given prefixes that start them.

    An equal join for each length that a prefix has: texts are repeated by the number of lengths, not of prefixes.  Equal
    prefixes match each by itself; nulls match nothing.
    """
    given = prefixes.withColumn("_size", F.length(prefix)).filter(F.col(prefix).isNotNull())
    sizes = given.select(F.col("_size").alias("_asked")).distinct()
    cut = texts.join(small(sizes), F.length(text) >= F.col("_asked")).withColumn("_begin", F.left(F.col(text), F.col("_asked")))
    return cut.join(given, (F.col("_asked") == F.col("_size")) & (F.col("_begin") == F.col(prefix))).drop("_asked", "_begin", "_size")


def contained_items(texts: DataFrame, items: DataFrame, text: str, item: str) -> DataFrame:
    """Texts with the items they contain; the items are broadcast if they are small."""
    return texts.join(small(items), F.contains(F.col(text), F.col(item)))


def first_rows(rows: DataFrame, id_col: str, k: int) -> DataFrame:
    return rows.filter(F.col(id_col) < k)
