"""Accuracy and clustering quality as aggregates over contingency tables; no pair is materialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(pred: DataFrame, truth: DataFrame, on: str = "row_id", predicted: str = "transformation", expected: str = "output") -> DataFrame:
    """(accuracy, correct, incorrect) of exact matches with trimmed truth; 0.0 without rows."""
    hit = F.coalesce(F.col(predicted) == F.trim(F.col(expected)), F.lit(False))
    both = pred.select(on, predicted).join(truth.select(on, expected), on)
    return both.agg(
        F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("accuracy"), F.count_if(hit).alias("correct"), F.count_if(~hit).alias("incorrect")
    )


def mistakes(pred: DataFrame, truth: DataFrame, on: str = "row_id", predicted: str = "transformation", expected: str = "output") -> DataFrame:
    both = pred.select(on, predicted).join(truth.select(on, expected), on)
    return both.filter(~F.coalesce(F.col(predicted) == F.trim(F.col(expected)), F.lit(False)))


def truncated_accuracy(pred: DataFrame, truth: DataFrame, on: str = "row_id", predicted: str = "prediction", expected: str = "output") -> DataFrame:
    """Exact matches by position over *all* truths; predictions beyond them don't count."""
    hit = F.coalesce(F.trim(F.col(predicted)) == F.trim(F.col(expected)), F.lit(False))
    return truth.select(on, expected).join(pred.select(on, predicted), on, "left").agg(
        F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("accuracy"), F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total")
    )


def members_by_label(df: DataFrame, label: str, id_col: str) -> DataFrame:
    """(label, members): 1-based positions are the caller's ids; sets are sorted."""
    return df.groupBy(label).agg(F.array_sort(F.collect_set(id_col)).alias("members"))


def contingency(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """(pred, truth, n, n_pred, n_truth)."""
    n = df.groupBy(F.col(pred).alias("pred"), F.col(truth).alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    by_pred = n.groupBy("pred").agg(F.sum("n").alias("n_pred"))
    by_truth = n.groupBy("truth").agg(F.sum("n").alias("n_truth"))
    return n.join(by_pred, "pred").join(by_truth, "truth").select("pred", "truth", "n", "n_pred", "n_truth")


def best_overlap_recall(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """(pred, recall): share of the truth cluster of largest overlap, the best of tied ones."""
    c = contingency(df, pred, truth)
    best = c.groupBy("pred").agg(F.max(F.struct("n", (F.col("n") / F.col("n_truth")).alias("recall"))).alias("b"))
    return best.select("pred", F.col("b.recall").alias("recall"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def pairwise(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """(pred, p, r, f1) by pairs: against the truth cluster with most common pairs."""
    c = contingency(df, pred, truth)
    common = _pairs(F.col("n"))
    top = c.groupBy("pred").agg(F.max(common).alias("common"), F.first("n_pred").alias("n_pred"))
    tied = c.join(top.select(F.col("pred").alias("p2"), "common"), (F.col("pred") == F.col("p2")) & (common == F.col("common")))
    recall = tied.groupBy("pred").agg(F.max(F.coalesce(F.try_divide(F.col("common"), _pairs(F.col("n_truth"))), F.lit(0.0))).alias("r"))
    out = top.join(recall, "pred").select("pred", F.coalesce(F.try_divide(F.col("common"), _pairs(F.col("n_pred"))), F.lit(0.0)).alias("p"), "r")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def pairwise_mean(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """(p, r, f1): means over predicted clusters, and F1 of the means."""
    m = pairwise(df, pred, truth).agg(F.avg("p").alias("p"), F.avg("r").alias("r"))
    return m.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def v_measure(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """(homogeneity, completeness, v_measure) from entropies of the contingency table."""
    c = contingency(df, pred, truth)
    total = c.agg(F.sum("n").alias("total"))
    plogp = lambda n, of: -(n / of) * F.ln(n / of)
    h_pred = c.groupBy("pred").agg(F.first("n_pred").alias("m")).join(F.broadcast(total)).agg(F.sum(plogp(F.col("m"), F.col("total"))).alias("h_pred"))
    h_truth = c.groupBy("truth").agg(F.first("n_truth").alias("m")).join(F.broadcast(total)).agg(F.sum(plogp(F.col("m"), F.col("total"))).alias("h_truth"))
    given = c.join(F.broadcast(total)).agg(
        F.sum(-(F.col("n") / F.col("total")) * F.ln(F.col("n") / F.col("n_pred"))).alias("truth_given_pred"),
        F.sum(-(F.col("n") / F.col("total")) * F.ln(F.col("n") / F.col("n_truth"))).alias("pred_given_truth"),
    )
    one = given.join(h_pred).join(h_truth)
    hom = F.when(F.col("h_truth") == 0, 1.0).otherwise(1 - F.try_divide(F.col("truth_given_pred"), F.col("h_truth")))
    com = F.when(F.col("h_pred") == 0, 1.0).otherwise(1 - F.try_divide(F.col("pred_given_truth"), F.col("h_pred")))
    out = one.select(hom.alias("homogeneity"), com.alias("completeness"))
    return out.withColumn("v_measure", F.coalesce(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")), F.lit(0.0)))


def completeness_by_cluster(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """(truth, completeness): how much of each truth cluster one predicted cluster holds."""
    return contingency(df, pred, truth).groupBy("truth").agg((F.max("n") / F.first("n_truth")).alias("completeness"))


def result_matrix(df: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """Mean of ``value`` by row and column, with a ``mean`` row over all rows."""
    cells = df.groupBy(row).pivot(column, columns).agg(F.avg(value))
    names = [c for c in cells.columns if c != row]
    means = cells.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in names])
    return cells.withColumn(row, F.col(row).cast("string")).unionByName(means.select(F.lit("mean").alias(row), *[F.col(f"`{c}`") for c in names]))


def means_by(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Mean of each value by key, and over all keys' rows where the key is null (rollup)."""
    return df.rollup(key).agg(*[F.avg(v).alias(v) for v in values])


def best_columns(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, column, value) of each row's highest value, the first column by name on ties; missing values and names last.

    The table is read once: means that are made twice can differ in their last bits, and a join on them loses rows.
    """
    place = F.struct(F.col(value).isNull().alias("none"), (~F.isnan(F.col(value).cast("double"))).alias("number"), (-F.col(value)).alias("down"), F.col(column).isNull().alias("last"), F.col(column).alias("name"))
    best = df.groupBy(row).agg(F.min_by(F.struct(column, value), place).alias("_b"))
    return best.select(row, F.col(f"_b.{column}").alias(column), F.col(f"_b.{value}").alias(value))


def best_v_measures(preds: DataFrame, truths: DataFrame, on: str, pred_name: str, pred: str, truth_name: str, truth: str) -> DataFrame:
    """(pred_name, v_measure): each clustering's best V-measure over all truths.

    ``preds`` and ``truths`` are long tables of (name, row, cluster); all pairs of names are
    scored from one contingency table.
    """
    p = preds.select(F.col(on).alias("_id"), F.col(pred_name).alias("pn"), F.col(pred).alias("p"))
    t = truths.select(F.col(on).alias("_id"), F.col(truth_name).alias("tn"), F.col(truth).alias("t"))
    n = p.join(t, "_id").groupBy("pn", "tn", "p", "t").agg(F.count(F.lit(1)).alias("n"))
    pair = ["pn", "tn"]
    sides = n.join(n.groupBy(*pair, "p").agg(F.sum("n").alias("n_p")), [*pair, "p"]).join(n.groupBy(*pair, "t").agg(F.sum("n").alias("n_t")), [*pair, "t"])
    sides = sides.join(n.groupBy(*pair).agg(F.sum("n").alias("all")), pair)
    # a row of the contingency table holds its share of the marginals' entropies
    part = lambda m: -(F.col("n") / F.col("all")) * F.ln(m)
    h = sides.groupBy(*pair).agg(
        F.sum(part(F.col("n_p") / F.col("all"))).alias("hp"), F.sum(part(F.col("n_t") / F.col("all"))).alias("ht"),
        F.sum(part(F.col("n") / F.col("n_p"))).alias("t_given_p"), F.sum(part(F.col("n") / F.col("n_t"))).alias("p_given_t"),
    )
    hom = F.when(F.col("ht") == 0, 1.0).otherwise(1 - F.try_divide(F.col("t_given_p"), F.col("ht")))
    com = F.when(F.col("hp") == 0, 1.0).otherwise(1 - F.try_divide(F.col("p_given_t"), F.col("hp")))
    scored = h.select(*pair, hom.alias("hom"), com.alias("com"))
    v = F.coalesce(F.try_divide(2 * F.col("hom") * F.col("com"), F.col("hom") + F.col("com")), F.lit(0.0))
    return scored.groupBy("pn").agg(F.max(v).alias("v_measure")).withColumnRenamed("pn", pred_name)


def runtime_matrix(df: DataFrame, dataset: str, column: str, seconds: str, columns: list | None = None) -> DataFrame:
    """Seconds by dataset and column, failures (null) as -1, with a ``mean`` row over those that ended."""
    held = result_matrix(df, dataset, column, seconds, columns)
    return held.select(dataset, *[F.coalesce(F.col(f"`{c}`"), F.lit(-1.0)).alias(c) for c in held.columns if c != dataset])
