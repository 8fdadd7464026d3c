import math
import random

import pytest
from pyspark.sql import functions as F

from quillshift.operators import cluster, metrics, relational
from quillshift.operators.components import components

VECS = [(0, "a", [1.0, 0.0]), (1, "a", [0.99, 0.05]), (2, "a", [0.98, 0.1]), (3, "b", [0.0, 1.0]), (4, "b", [0.05, 0.99]), (5, "b", [0.1, 0.97]), (6, "c", [0.7, 0.6])]


@pytest.fixture()
def vecs(spark):
    return spark.createDataFrame(VECS, "vec_id long, c string, embedding array<double>")


def test_dbscan(vecs):
    got = {r["id"]: r["label"] for r in cluster.dbscan(vecs, 0.02, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}


def test_merge_sparse(vecs):
    got = {r["vec_id"]: r["c"] for r in cluster.merge_sparse(vecs, "vec_id", "c").collect()}
    assert got[6] == "a" and got[0] == "a" and got[3] == "b"
    alone = vecs.withColumn("c", F.col("vec_id").cast("string"))
    assert cluster.merge_sparse(alone, "vec_id", "c").count() == 7


def test_distances(spark):
    row = spark.sql("select array(1.0D, 0.0D) a, array(0.0D, 2.0D) b, array(0.0D, 0.0D) z").select(
        cluster.cosine_distance(F.col("a"), F.col("b")), cluster.euclidean_distance(F.col("a"), F.col("b")), cluster.cosine_distance(F.col("a"), F.col("z")),
        cluster.mixed_distance(0.5, (F.col("a"), F.col("b")), (F.col("a"), F.col("a"))),
    ).first()
    assert row[0] == pytest.approx(1) and row[1] == pytest.approx(math.sqrt(5)) and row[2] is None and row[3] == pytest.approx(0.5)


def test_knee():
    assert cluster.knee([1, 2, 3, 4, 5], [10, 4, 2, 1.5, 1]) in (2, 3)
    assert cluster.knee([1, 2, 3], [1, 1, 1]) is None


def test_rare_and_relaxed(spark):
    df = spark.createDataFrame([("Aa-Aa",), ("Aa/Aa",), ("Aa/Aa",), ("Aa.0",), ("Aa.0",), ("Aa.0",)], "collapsed string")
    assert {r["symbol"] for r in cluster.rare_symbols(df).collect()} == {"-"}
    assert cluster.rare_symbols(df.filter("collapsed <> 'Aa-Aa'")).count() == 0
    few = spark.createDataFrame([("a-a",), ("a/a",), ("a.a",), ("a+a",)], "collapsed string")
    assert {r["relaxed"] for r in cluster.relax_until_dense(few).collect()} == {"a"}


@pytest.mark.parametrize("strategy", ["collapse", "composition", "embedding", "collapse_embedding", "collapse_split", "embedding_collapse", "unknown"])
def test_strategies_cover_every_row(spark, strategy):
    df = spark.createDataFrame([(i, "Ab 1" if i % 2 else "x-y", "[n]", v) for i, _, v in VECS], "row_id long, input string, composition string, embedding array<double>")
    assert sorted(r["row_id"] for r in cluster.cluster(df, strategy).collect()) == list(range(7))


def test_digit_gate(spark):
    assert cluster.all_digit_gate(spark.createDataFrame([("1-2",), ("a",)], "text string"))
    assert not cluster.all_digit_gate(spark.createDataFrame([("a",)], "text string"))


def test_accuracy(spark):
    pred = spark.createDataFrame([(5, "a"), (6, "b"), (7, None)], "row_id long, transformation string")
    truth = spark.createDataFrame([(5, " a "), (6, "c"), (7, "d")], "row_id long, output string")
    assert metrics.accuracy(pred, truth).first() == (pytest.approx(1 / 3), 1, 2)
    assert metrics.accuracy(pred.limit(0), truth).first()[0] == 0.0
    assert metrics.mistakes(pred, truth).count() == 2
    short = pred.limit(1).withColumnRenamed("transformation", "prediction")
    assert metrics.truncated_accuracy(short, truth).first()["accuracy"] == pytest.approx(1 / 3)


def test_pairwise_and_v_measure(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "p int, t int")
    got = {r["pred"]: (r["p"], r["r"]) for r in metrics.pairwise(df, "p", "t").collect()}
    assert got[0] == (pytest.approx(1 / 3), 1.0) and got[1] == (1.0, pytest.approx(1 / 6)) and got[2] == (0.0, 0.0)
    same = spark.createDataFrame([(0, 5), (1, 6)], "p int, t int")
    assert metrics.v_measure(same, "p", "t").first()["v_measure"] == pytest.approx(1)
    one = spark.createDataFrame([(0, 0), (0, 0)], "p int, t int")
    assert metrics.v_measure(one, "p", "t").first()["homogeneity"] == 1.0
    assert {r["pred"]: r["recall"] for r in metrics.best_overlap_recall(df, "p", "t").collect()}[1] == pytest.approx(0.5)
    assert metrics.pairwise_mean(df, "p", "t").first()["p"] == pytest.approx(4 / 9)


def test_matrix(spark):
    df = spark.createDataFrame([("x", "m1", 1.0), ("y", "m1", 0.0), ("x", "m2", 0.5)], "file string, model string, accuracy double")
    got = {r["file"]: (r["m1"], r["m2"]) for r in metrics.result_matrix(df, "file", "model", "accuracy").collect()}
    assert got == {"x": (1.0, 0.5), "y": (0.0, None), "mean": (0.5, 0.5)}


def test_relational(spark):
    t, p = spark.createDataFrame([("ab",), ("b",)], "t string"), spark.createDataFrame([("a",), ("b",)], "p string")
    assert {tuple(r) for r in relational.prefix_join(t, p, "t", "p").collect()} == {("ab", "a"), ("b", "b")}
    assert {tuple(r) for r in relational.contained_items(t, p, "t", "p").collect()} == {("ab", "a"), ("ab", "b"), ("b", "b")}
    assert relational.first_rows(spark.range(9), "id", 3).count() == 3


def test_a_long_chain_is_one_cluster(spark):
    chain = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(140)] + [(500, [900.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["id"]: r["label"] for r in cluster.dbscan(chain, 1.0, 3, distance=cluster.euclidean_distance).collect()}
    assert {got[i] for i in range(140)} == {1} and got[500] == -1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (300, 300), (None, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200, 300: 300}
    assert components(edges.limit(0)).count() == 0


def test_numbers_follow_the_order(spark):
    words = [f"k{i % 37:02d}" for i in range(300)] + [None]
    df = spark.createDataFrame([(w,) for w in words], "k string")
    got = {(r["k"], r["cluster_id"]) for r in cluster.by_columns(df, ["k"]).collect()}
    assert got == {(None, 0), *((f"k{i:02d}", i + 1) for i in range(37))}


def test_label_counts_are_those_of_dbscan(vecs):
    xs = [0.003, 0.02, 0.3, 1.0]
    assert cluster.label_counts(vecs, xs).first()["counts"] == [cluster.dbscan(vecs, x, 2).select("label").distinct().count() for x in xs]


def test_best_columns_read_their_values_once(spark):
    """Values that come out otherwise each time they are made, as sums of doubles can, lose no rows."""

    @F.udf("double")
    def drawn(_):
        return random.random()

    made = spark.range(12).select((F.col("id") % 4).alias("r"), (F.col("id") % 3).cast("string").alias("c"), drawn.asNondeterministic()("id").alias("v"))
    assert sorted(x["r"] for x in metrics.best_columns(made, "r", "c", "v").collect()) == [0, 1, 2, 3]
    held = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0), (2, "x", None), (3, "n", float("nan")), (3, "m", 9.0)], "r int, c string, v double")
    assert sorted((x["r"], x["c"]) for x in metrics.best_columns(held, "r", "c", "v").collect()) == [(1, "a"), (2, "x"), (3, "n")]
