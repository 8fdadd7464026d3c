"""Queries that work long on small rows use all cores, and work once on each distinct string."""

from pyspark.sql import functions as F

from quillshift.operators import automata
from quillshift.plans import queries
from quillshift.plans.model import Config, fit
from quillshift.plans.providers import PatternProvider


def test_names_are_resolved_on_all_cores(spark):
    made = queries.resolved_choices(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_expressions_are_held_against_distinct_strings(spark, monkeypatch):
    seen = []

    def given(df, key, text):
        seen.append((df.count(), df.select(key, text).distinct().count()))
        return df.select(key).distinct().withColumns({"states": F.lit(1), "regex": F.lit("^.*$")})

    monkeypatch.setattr(automata, "group_expressions", given)
    made = queries.group_expressions(spark, "/root/testdata/sf0.001").collect()
    assert seen[0][0] == seen[0][1] and all(r["n"] == r["matched"] for r in made)
    assert {r["of"]: r["n"] for r in made}["priority"] == queries.table(spark, "/root/testdata/sf0.001", "orders").count()


def test_many_formats_are_fitted_and_applied_on_all_cores(spark):
    rows = [(i, "x" + "-" * i + f" w{i}", f"w{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, input string, output string").coalesce(1)
    word = PatternProvider([r"(?P<word>\w+)$"])
    model = fit(df, word, word, config=Config(local_formats=10))
    assert len(model.table.inputFiles()) >= spark.sparkContext.defaultParallelism
    made = model.transform(df)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert all(r["transformation"] == r["output"] for r in made.collect())
