"""Clustering by surface format, by composition, and by embedding distance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillshift.functions import text as T
from quillshift.operators import metric
from quillshift.operators.components import components
from quillshift.operators.spanning import spanning_forest
from quillshift.sources.shared import checkpointed, small


@dataclass(frozen=True)
class Thresholds:
    sparse: int = 3
    sparse_share: float = 0.5
    sparse_count: int = 2


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity of two arrays; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return 1 - F.try_divide(dot, size(a) * size(b))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def mixed_distance(alpha: float, vec: tuple[Column, Column], num: tuple[Column, Column]) -> Column:
    """alpha * cosine of the embeddings + (1 - alpha) * euclidean distance of the numbers."""
    return alpha * cosine_distance(*vec) + (1 - alpha) * euclidean_distance(*num)


def by_columns(df: DataFrame, keys: Sequence[str], out: str = "cluster_id") -> DataFrame:
    """Number the distinct values of ``keys`` in their order and add the number.

    Only the distinct values are ordered, by range partitions: a value's number is its place in
    its partition and what the partitions before it hold, so no task sees all of them.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    order = [F.col(n).asc_nulls_first() for n in names]
    groups = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    ranged = checkpointed(groups.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = ranged.withColumn("_place", place).join(F.broadcast(starts), "_part").select(*names, (F.col("_start") + F.col("_place")).alias(out))
    on = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return df.join(numbered, on).drop(*names)


def collapse_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """(collapsed, n, first text) for each surface format."""
    return df.groupBy(T.collapse(F.col(text)).alias("collapsed")).agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("example"))


def rare_symbols(df: DataFrame, pattern: str = "collapsed", keep: int = 2) -> DataFrame:
    """Symbols of the least frequency; none if there are ``keep`` or fewer distinct symbols."""
    counts = df.select(F.explode(T.symbols(F.col(pattern))).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    least = counts.agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds"))
    return counts.join(F.broadcast(least), (F.col("n") == F.col("least")) & (F.col("kinds") > keep)).select("symbol", "n")


def sparse_stats(df: DataFrame, key: str = "collapsed", t: Thresholds = Thresholds()) -> DataFrame:
    """(clusters, sparse, sparse_share, sparse_rows_share) over the clusters of ``key``."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sparse = F.col("n") < t.sparse
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(sparse).alias("sparse"),
        F.try_divide(F.count_if(sparse).cast("double"), F.count(F.lit(1))).alias("sparse_share"),
        F.try_divide(F.sum(F.when(sparse, F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("sparse_rows_share"),
    )


def relax_until_dense(df: DataFrame, pattern: str = "collapsed", t: Thresholds = Thresholds()) -> DataFrame:
    """Drop the rarest symbols from the patterns of sparse clusters while too many are sparse.

    Each round drops a symbol at least, so it ends.  Works on distinct patterns, which stay few, and joins the result back as ``relaxed``.
    """
    patterns = checkpointed(df.groupBy(F.col(pattern).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("relaxed", F.col("_p")))
    while True:
        sizes = patterns.groupBy("relaxed").agg(F.sum("_n").alias("size"))
        clusters, sparse = sizes.agg(F.count(F.lit(1)), F.count_if(F.col("size") < t.sparse)).first()
        if not (sparse > t.sparse_count and sparse >= t.sparse_share * clusters):
            break
        weighted = patterns.join(sizes, "relaxed")
        few = weighted.filter(F.col("size") < t.sparse)
        counts = few.select("_n", F.explode(T.symbols(F.col("relaxed"))).alias("s")).groupBy("s").agg(F.sum("_n").alias("n"))
        found = counts.collect()  # at most one row for each kind of symbol
        if len(found) <= 2:
            break
        rare = sorted(r["s"] for r in found if r["n"] == min(x["n"] for x in found))
        patterns = checkpointed(weighted.select(
            "_p", "_n", F.when(F.col("size") < t.sparse, T.relax(F.col("relaxed"), rare)).otherwise(F.col("relaxed")).alias("relaxed")
        ))
    final = patterns.select("_p", "relaxed")
    return df.join(final, df[pattern].eqNullSafe(final["_p"])).drop("_p")


# ---- embeddings


#: What ``distance`` may be: a metric, or one of the two plain expressions.
Distance = metric.Metric | Callable[[Column, Column], Column]


def _metric(distance: Distance) -> metric.Metric:
    return distance if isinstance(distance, metric.Metric) else {cosine_distance: metric.COSINE, euclidean_distance: metric.EUCLIDEAN}[distance]


def close_pairs(df: DataFrame, eps: float, id_col: str, vec: str, distance: Distance = cosine_distance, within: str | None = None) -> DataFrame:
    """(a, b) with a < b and distance at most ``eps``; with ``within``, only inside equal values of it.

    Rows are compared in cells about pivots (``operators.metric``), so rows that are far apart never meet.
    """
    m = _metric(distance)
    placed = metric.cells(metric.points(df, m, id_col, vec, within), m, eps)
    return metric.pairs_within(placed, m, eps).select("a", "b")


def dbscan(df: DataFrame, eps: float, min_samples: int, id_col: str = "vec_id", vec: str = "embedding", distance: Distance = cosine_distance, within: str | None = None, weight: str | None = None, eps_col: str | None = None) -> DataFrame:
    """(id, label): the smallest core id of the cluster, -1 for noise.

    A core has ``min_samples`` rows within ``eps``, itself included; a border row joins its
    smallest core neighbour's cluster.  Cores within ``eps`` of each other are joined by union-find.  With
    ``weight`` a row stands for so many; ``eps_col`` has an eps of up to ``eps`` for each value of ``within``.  Neighbours are counted in cells about pivots, and only a forest of
    each block's cores leaves it, so no table of pairs is made.
    """
    m = _metric(distance)
    rows = metric.points(df, m, id_col, vec, within, weight, eps_col)
    placed = checkpointed(metric.cells(rows, m, eps))
    others = metric.neighbour_weights(placed, m, eps)
    core = checkpointed(rows.select("id", "w").join(others, "id", "left").filter(F.col("w") + F.coalesce("others", F.lit(0)) >= min_samples).select("id"))
    links = checkpointed(metric.core_links(placed, core, m, eps))
    joined = checkpointed(components(links.filter("core").select("a", "b")))
    label = core.join(joined, core["id"] == joined["node"], "left").select("id", F.coalesce("root", "id").alias("label"))
    border = links.filter("not core").join(label.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near_label"))
    ids = df.select(F.col(id_col).alias("id"))
    return ids.join(label, "id", "left").join(border, F.col("id") == F.col("a"), "left").select("id", F.coalesce("label", "near_label", F.lit(-1)).alias("label"))


def knee(xs: Sequence[float], ys: Sequence[float]) -> float | None:
    """The x farthest below (or above) the chord of a curve; none for a flat one."""
    if len(xs) < 3 or max(ys) == min(ys):
        return None
    sx = [(x - xs[0]) / (xs[-1] - xs[0]) for x in xs]
    sy = [(y - min(ys)) / (max(ys) - min(ys)) for y in ys]
    off = [abs(y - (sy[0] + (sy[-1] - sy[0]) * x)) for x, y in zip(sx, sy, strict=True)]
    best = max(range(len(off)), key=off.__getitem__)
    return xs[best] if off[best] > 0 else None


def label_counts(df: DataFrame, xs: Sequence[float], id_col: str = "vec_id", vec: str = "embedding", within: str | None = None) -> DataFrame:
    """(group, n, counts): how many labels density clustering with two rows gives at each eps of ``xs``; noise counts as one.

    A group is a value of ``within``, or the whole table.  With two rows a cluster is a component of the graph of
    close pairs, and its edges up to eps in the spanning forest are one fewer than its rows.  So one forest
    serves every eps.
    """
    edges = checkpointed(spanning_forest(df, max(xs), id_col, vec, within=within))
    near = edges.select(F.explode(F.array("a", "b")).alias("id"), "d").groupBy("id").agg(F.min("d").alias("near"))
    own = edges.groupBy(F.col("a").alias("id")).agg(F.array(*[F.count_if(F.col("d") <= x) for x in xs]).alias("edges"))
    rows = df.select(F.col(id_col).alias("id"), (F.col(within) if within else F.lit(0)).alias("group"))
    held = rows.join(near, "id", "left").join(own, "id", "left")
    # clustered rows, less the edges that join them; an edge counts with the row it begins at
    upto = lambda i, x: F.count_if(F.col("near") <= x) - F.coalesce(F.sum(F.get("edges", F.lit(i))), F.lit(0))
    noise = lambda x: F.bool_or(F.col("near").isNull() | (F.col("near") > x)).cast("int")
    return held.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.array(*[upto(i, x) + noise(x) for i, x in enumerate(xs)]).alias("counts"))


def knee_eps(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", steps: int = 10, default: float = 0.5, within: str | None = None) -> DataFrame:
    """(group, eps): the knee of the number of labels over eps in [0.1, 1.0], noise counting as one, for each value of ``within``."""
    xs = [round(0.1 + 0.9 * i / (steps - 1), 6) for i in range(steps)]

    @F.pandas_udf("double")
    def at(counts: pd.Series) -> pd.Series:
        return counts.map(lambda ys: knee(xs, list(ys)) or default).astype(float)

    return label_counts(df, xs, id_col, vec, within).select("group", at(F.col("counts")).alias("eps"))


def knee_clusters(df: DataFrame, min_samples: int, id_col: str = "vec_id", vec: str = "embedding", within: str | None = None) -> DataFrame:
    """(id, label): density clusters of the table, or of each value of ``within``, at its own knee."""
    grouped = df.withColumn("_group", F.col(within) if within else F.lit(0))
    found = checkpointed(knee_eps(df, id_col, vec, within=within))
    held = grouped.join(small(found.withColumnRenamed("group", "_group")), "_group")
    top = found.agg(F.max("eps")).first()[0]
    return dbscan(held, top or 0.5, min_samples, id_col, vec, within="_group", eps_col="eps")


def centroids(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """(key, pos, value): mean of each component of each cluster's vectors."""
    return df.select(key, F.posexplode(vec).alias("pos", "v")).groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("value"))


def centroid_vectors(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    each = centroids(df, key, vec).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_parts"))
    return each.select(key, F.transform("_parts", lambda x: x["value"]).alias("centroid"))


def nearest_centroid(points: DataFrame, centres: DataFrame, id_col: str, vec: str, key: str) -> DataFrame:
    """(id, key, distance) of the nearest centroid, the smaller key on ties.

    There is a centroid for each dense cluster; a broadcast nested loop reads the points once.
    """
    each = points.select(id_col, vec).join(small(centres.select(key, "centroid")), on=F.lit(True)).select(id_col, key, cosine_distance(F.col(vec), F.col("centroid")).alias("distance"))
    return each.groupBy(id_col).agg(F.min(F.struct("distance", key)).alias("_m")).select(id_col, F.col(f"_m.{key}").alias(key), F.col("_m.distance").alias("distance"))


def merge_sparse(df: DataFrame, id_col: str, key: str, vec: str = "embedding", t: Thresholds = Thresholds()) -> DataFrame:
    """(id, key): rows of sparse clusters go to the nearest dense centroid, in one batch.

    Centroids are those before the merge, so the result doesn't depend on an order.  If no
    cluster is dense, euclidean DBSCAN (eps 1, 3 rows) decides.
    """
    sized = df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
    dense, sparse = sized.filter(F.col("_n") >= t.sparse), sized.filter(F.col("_n") < t.sparse)
    if dense.isEmpty():
        return dbscan(df, 1.0, 3, id_col, vec, euclidean_distance).select(F.col("id").alias(id_col), F.col("label").alias(key))
    moved = nearest_centroid(sparse, centroid_vectors(dense, key, vec), id_col, vec, key).select(id_col, key)
    return dense.select(id_col, key).unionByName(moved)


def all_digit_gate(df: DataFrame, text: str = "text") -> bool:
    """Whether any row is all digits, which switches labels off for the table."""
    return bool(df.agg(F.bool_or(T.all_digits(F.col(text)))).first()[0])


def cluster(df: DataFrame, strategy: str = "collapse_embedding", id_col: str = "row_id", text: str = "input", vec: str = "embedding", labels: str = "composition", t: Thresholds = Thresholds()) -> DataFrame:
    """(row_id, cluster_id) by one of the strategies; unknown names take the default.

    ``collapse``: surface format.  ``composition``: format and label composition (format alone
    where a row is all digits).  ``embedding``: density at the knee.  ``collapse_embedding``:
    relaxed formats, each split by density at its own knee, sparse ones merged.  ``collapse_split``: formats split
    so.  ``embedding_collapse``: density clusters split by format, sparse ones merged.
    """
    formed = df.withColumn("collapsed", T.collapse(F.col(text)))
    if strategy == "collapse":
        return by_columns(formed, ["collapsed"]).select(id_col, "cluster_id")
    if strategy == "composition":
        keys = ["collapsed"] if labels not in df.columns or all_digit_gate(df, text) else ["collapsed", labels]
        return by_columns(formed, keys).select(id_col, "cluster_id")
    if strategy == "embedding":
        found = knee_clusters(df, t.sparse, id_col, vec)
        return by_columns(found, ["label"]).select(F.col("id").alias(id_col), "cluster_id")
    if strategy == "embedding_collapse":
        found = knee_clusters(df, t.sparse, id_col, vec).withColumnRenamed("id", id_col)
        both = by_columns(formed.join(found, id_col), ["label", "collapsed"])
        return merge_sparse(both.select(id_col, vec, "cluster_id"), id_col, "cluster_id", vec, t)
    relaxed = relax_until_dense(formed, t=t) if strategy != "collapse_split" else formed.withColumn("relaxed", F.col("collapsed"))
    first = checkpointed(by_columns(relaxed, ["relaxed"], "format_id"))
    split = knee_clusters(first, t.sparse, id_col, vec, "format_id").withColumnRenamed("id", id_col)
    both = by_columns(first.join(split, id_col), ["format_id", "label"])
    if strategy == "collapse_split":
        return both.select(id_col, "cluster_id")
    return merge_sparse(both.select(id_col, vec, "cluster_id"), id_col, "cluster_id", vec, t)


def feature_clusters(df: DataFrame, names: Sequence[str], eps: float = 0.1, min_samples: int = 4, id_col: str = "row_id", text: str = "input") -> DataFrame:
    """(id, label): density clusters of the named text features, each min-max scaled over the table.

    Rows of equal features are one point with a weight, so the pairs are those of distinct points.
    """
    held = T.with_features(df.select(id_col, text), text, names)
    for n in names:
        held = T.normalized(held, n, f"_s_{n}")
    vectors = held.select(F.col(id_col).alias("_id"), F.array(*[F.col(f"_s_{n}") for n in names]).alias("v"))
    points = checkpointed(vectors.groupBy("v").agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("w")))
    found = weighted_dbscan(points, eps, min_samples)
    return vectors.join(points.join(found, "id").select("v", "label"), "v").select(F.col("_id").alias(id_col), "label")


def weighted_dbscan(points: DataFrame, eps: float, min_samples: int, distance: Distance = euclidean_distance) -> DataFrame:
    """As ``dbscan`` over points (id, v, w) that stand for ``w`` equal rows each."""
    return dbscan(points, eps, min_samples, "id", "v", distance, weight="w")


def mixed_clusters(df: DataFrame, alpha: float = 0.5, eps: float = 0.4, min_samples: int = 8, id_col: str = "vec_id", vec: str = "embedding", numbers: str = "numbers") -> DataFrame:
    """(id, label): density clusters by ``mixed_distance`` of an embedding and an array of numbers."""
    held = df.select(F.col(id_col).alias("id"), F.struct(F.col(vec).alias("e"), F.col(numbers).alias("f")).alias("v"))
    return dbscan(held, eps, min_samples, "id", "v", metric.Metric(alpha))
