"""Result sinks, feature tables and memoisation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshift.operators.metrics import result_matrix


def append_text(df: DataFrame, path: str, line: str = "concat_ws(' ', *)") -> None:
    """Append one line of text for each row."""
    df.select(F.expr(line).alias("value")).write.mode("append").text(path)


def write_matrix(df: DataFrame, path: str, row: str = "file", column: str = "model", value: str = "accuracy") -> None:
    """Rows by file, columns by model, with a row of means, as CSV with a header."""
    result_matrix(df, row, column, value).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_clusters(df: DataFrame, path: str, key: str = "cluster_id", id_col: str = "row_id") -> None:
    """Clusters in the format their reader takes: a line of ids for each."""
    members = df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(id_col)), lambda x: x.cast("string")), ",").alias("value"))
    members.orderBy(key).select("value").coalesce(1).write.mode("overwrite").text(path)


def feature_table(df: DataFrame, path: str) -> DataFrame:
    """Write features once as Parquet and read them back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


class Memo:
    """Results by function name and *all* arguments, configuration included.

    In memory by default; with a folder also as JSON files through Spark, on any store.
    """

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.held: dict[str, Any] = {}

    @staticmethod
    def key(name: str, args: Any) -> str:
        return f"{name}-{hashlib.sha256(json.dumps(args, sort_keys=True, default=repr).encode()).hexdigest()[:32]}"

    def __call__(self, name: str, args: Any, make: Callable[[], Any]) -> Any:
        k = self.key(name, args)
        if k not in self.held:
            self.held[k] = self._read(k)
            if self.held[k] is None:
                self.held[k] = make()
                if self.folder:
                    self.spark.createDataFrame([(json.dumps(self.held[k]),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{k}")
        return self.held[k]

    def _read(self, k: str) -> Any:
        if not self.folder:
            return None
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{k}/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/{k}", wholetext=True).first()["value"])

    def clear(self, name: str | None = None) -> None:
        """Forget everything, or what one function made."""
        for k in [k for k in self.held if name is None or k.startswith(f"{name}-")]:
            del self.held[k]
        if self.folder:
            jvm = self.spark._jvm
            root = jvm.org.apache.hadoop.fs.Path(self.folder)
            fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if fs.exists(root):
                for status in fs.listStatus(root):
                    if name is None or status.getPath().getName().startswith(f"{name}-"):
                        fs.delete(status.getPath(), True)
