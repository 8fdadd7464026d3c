"""Command line: fit on the first rows of two-column files, transform, evaluate."""

from __future__ import annotations

import argparse
import signal
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshift.functions.text import hashed_vector
from quillshift.operators.cluster import cluster
from quillshift.operators.metrics import accuracy, runtime_matrix
from quillshift.plans.model import Config, fit
from quillshift.plans.providers import ComponentProvider, RuleProvider, TruthProvider
from quillshift.sources.datasets import read_pairs, truth
from quillshift.sources.sinks import append_text, write_matrix
from quillshift.plans.witness import Programs
from quillshift.sources.truth import read_clusters, read_programs, read_split


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillshift", description=__doc__)
    p.add_argument("data", help="a CSV file, or a folder of them")
    p.add_argument("-k", "--examples", type=int, default=5)
    p.add_argument("-s", "--splits", help="a folder of {dataset}_split.txt component truth; rules otherwise")
    p.add_argument("-p", "--split-prompts", action="store_true", help="take components from {dataset}_split_prompt.txt of that folder")
    p.add_argument("--clusters", help="a folder of {dataset}_cluster.txt cluster truth; surface formats otherwise")
    p.add_argument("--operators", help="a folder of {dataset}_op.txt programs of given rows; induced ones otherwise")
    p.add_argument("--strategy", choices=("collapse", "composition", "collapse_embedding", "collapse_split", "embedding", "embedding_collapse"), default="collapse", help="how rows are clustered without cluster truth; embeddings are hashed n-grams unless the data has some")
    p.add_argument("--further", action="store_true", help="split input components again that the outputs take apart")
    p.add_argument("--order", choices=("precedence", "most", "least"), default="precedence", help="how output components are ordered")
    p.add_argument("-c", "--coverage", choices=("off", "max"), default="max")
    p.add_argument("--compat", action="store_true", help="the traditional reading of positions")
    p.add_argument("-o", "--output", help="a folder for transformations, mistakes and the accuracy matrix")
    p.add_argument("-t", "--timeout", type=int, default=600, help="seconds for each file")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


@contextmanager
def limited(seconds: int) -> Iterator[None]:
    """Raise TimeoutError after so many seconds, where the platform has alarms."""

    def late(*_) -> None:
        raise TimeoutError(f"more than {seconds} s")

    if not hasattr(signal, "SIGALRM"):
        yield
        return
    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def run_dataset(
    rows: DataFrame, provider: ComponentProvider, outputs: ComponentProvider | None, examples: int, config: Config,
    clusters: DataFrame | None = None, operators: dict[int, Programs] | None = None, strategy: str = "collapse", further: bool = False, order_by: str = "precedence",
) -> tuple[DataFrame, DataFrame]:
    """(transformed rows, accuracy) of one dataset.

    ``clusters`` (cluster_id, row_id) are taken as given; rows in none of them have no programs.
    """
    by = None
    if clusters is None and strategy != "collapse":
        clusters = cluster(rows if "embedding" in rows.columns else rows.withColumn("embedding", hashed_vector(F.col("input"))), strategy)
    if clusters is not None:
        by, rows = "cluster_id", rows.join(clusters.select("row_id", "cluster_id"), "row_id", "left")
    model = fit(rows, provider, outputs, examples, config=config, by=by, operators=operators, further=further, order_by=order_by)
    made = model.transform_resolved(rows)
    return made, accuracy(made, truth(rows))


def _shifted(parts: dict[int, dict[str, str]], by: int) -> TruthProvider:
    return TruthProvider({i - by: p for i, p in parts.items() if i >= by})


def main(argv: list[str] | None = None, session: Callable[[], SparkSession] = lambda: SparkSession.builder.getOrCreate()) -> list[tuple[str, float, str]]:
    args = parser().parse_args(argv)
    spark = session()
    rows = read_pairs(spark, args.data).cache()
    results: list[tuple[str, float, str]] = []
    seconds: list[tuple[str, str, float | None]] = []
    for name in sorted(r[0] for r in rows.select("dataset").distinct().collect()):
        one = rows.filter(F.col("dataset") == name)
        began = time.monotonic()
        try:
            with limited(args.timeout):
                provider: ComponentProvider = RuleProvider()
                outputs: ComponentProvider | None = None
                if args.splits:
                    parts, n = read_split(spark, f"{args.splits}/{name}_split{'_prompt' * args.split_prompts}.txt"), one.count()
                    provider, outputs = TruthProvider(parts), _shifted(parts, n)
                clusters = read_clusters(spark, f"{args.clusters}/{name}_cluster.txt") if args.clusters else None
                operators = read_programs(spark, f"{args.operators}/{name}_op.txt") if args.operators else None
                config = Config(coverage=args.coverage, compat=args.compat)
                made, score = run_dataset(one, provider, outputs, args.examples, config, clusters, operators, args.strategy, args.further, args.order)
                if args.output:
                    made.select("dataset", "row_id", "input", "transformation", "status").write.mode("append").parquet(f"{args.output}/transformations")
                results.append((name, float(score.first()["accuracy"]), "ok"))
                seconds.append((name, f"k{args.examples}", time.monotonic() - began))
        except Exception as e:  # a dataset that fails counts 0.0 and doesn't stop the others
            results.append((name, 0.0, f"{type(e).__name__}: {str(e)[:200]}"))
            seconds.append((name, f"k{args.examples}", None))
        if args.verbose:
            print(*results[-1])
    table = spark.createDataFrame(results, "file string, accuracy double, status string")
    if args.output:
        append_text(table, f"{args.output}/log", "concat(file, ': ', accuracy, ' ', status)")
        write_matrix(table.withColumn("model", F.lit(f"k{args.examples}")), f"{args.output}/accuracy")
        times = spark.createDataFrame(seconds, "file string, model string, seconds double")
        runtime_matrix(times, "file", "model", "seconds").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{args.output}/seconds")
    return results


if __name__ == "__main__":
    main()
