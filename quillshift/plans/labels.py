"""Row labels from a service, kept in a table that many tasks and runs share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshift.plans.providers import few_shot
from quillshift.sources.shared import small

STORE = "key string, reply string"


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(key, reply) of all runs; a key that two runs asked for at once counts once."""
    try:
        held = spark.read.schema(STORE).option("recursiveFileLookup", "true").parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], STORE)
    return held.groupBy("key").agg(F.min("reply").alias("reply"))


def ask(df: DataFrame, call: Callable[[list[str]], list[str]], examples: Sequence[tuple[str, str]], store: str, n: int = 2, batch: int = 16, per_round: int = 10_000, tasks: int = 8) -> None:
    """Ask for the texts of ``df`` (key, text) that the store lacks, and append the replies.

    ``tasks`` tasks ask at a time, ``batch`` prompts in a call.  After ``per_round`` texts the replies are committed to a folder of
    their own, so a run that is killed loses one round at most and the next goes on.  A batch that fails is asked again text by
    text; a text that fails by itself is not stored, so another run asks again.
    """

    def one(prompt: str) -> str | None:
        try:
            return call([prompt])[0]
        except Exception:
            return None

    def replies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                prompts = [few_shot(examples, t, n) for t in part["text"]]
                try:
                    said = list(call(prompts))
                    if len(said) != len(prompts):
                        raise ValueError("replies and prompts differ in number")
                except Exception:
                    said = [one(p) for p in prompts]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "reply": said}).dropna()

    missing = df.groupBy("key").agg(F.min("text").alias("text")).join(stored(df.sparkSession, store), "key", "left_anti")
    rounds = -(-missing.count() // per_round)
    for k in range(rounds):
        # what a round holds is decided by the key, so a repeated run meets the same rounds
        mine = missing.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k) if rounds > 1 else missing
        mine.repartition(tasks).mapInPandas(replies, STORE).write.parquet(f"{store.rstrip('/')}/round-{uuid.uuid4().hex}")


def label_rows_once(df: DataFrame, call: Callable[[list[str]], list[str]], examples: Sequence[tuple[str, str]], store: str, text: str = "input", n: int = 2, **options) -> DataFrame:
    """Add ``composition``, as ``label_rows`` does, with each distinct text asked for once ever.

    ``store`` is a folder that all executors and later runs share; replies are known by the prompt's examples and the text, so
    other examples are asked for anew.  Null texts get null, texts whose calls failed "".  Repeated texts are joined to one
    reply; an empty table asks nothing.
    """
    shown = few_shot(examples, "", n)
    keyed = df.withColumn("_key", F.sha2(F.concat(F.lit(shown + "\0"), F.col(text)), 256))
    ask(keyed.select(F.col("_key").alias("key"), F.col(text).alias("text")).filter("text is not null"), call, examples, store, n, **options)
    known = stored(df.sparkSession, store).withColumnsRenamed({"key": "_known", "reply": "_reply"})
    held = keyed.join(small(known.join(keyed.select(F.col("_key").alias("_known")).distinct(), "_known")), F.col("_key") == F.col("_known"), "left")
    labels = F.array_join(F.regexp_extract_all("_reply", F.lit(r"\[[^\]]*\]"), F.lit(0)), "")
    return held.select(*df.columns, F.when(F.col(text).isNotNull(), F.coalesce(labels, F.lit(""))).alias("composition"))


def prompt_query(prompt: str) -> str:
    """The text that a labelling prompt asks about."""
    return re.split(r"\nInput: ", "\n" + prompt)[-1].removesuffix("\nLabels:")
