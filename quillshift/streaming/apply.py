"""Fitted models on streams: a model is a projection, so it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillshift.functions.text import collapse
from quillshift.plans.model import TransformModel


def transform_stream(stream: DataFrame, model: TransformModel, text: str = "input") -> DataFrame:
    return model.transform(stream, text)


def format_counts(stream: DataFrame, text: str, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows by surface format in event-time windows; rows later than ``late`` don't count."""
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), collapse(F.col(text)).alias("collapsed"))
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "collapsed", "n")
    )


def run_folder(spark: SparkSession, source: str, schema: str, model: TransformModel, sink: str, checkpoint: str, text: str = "input") -> StreamingQuery:
    """Transform the Parquet files of a folder as they come, exactly once, until none is left."""
    stream = spark.readStream.schema(schema).parquet(source)
    return transform_stream(stream, model, text).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink)
