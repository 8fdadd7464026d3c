"""Minimum spanning forests by distance, from forests of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillshift.operators import metric
from quillshift.operators.components import components
from quillshift.operators.metric import COSINE, Metric
from quillshift.sources.shared import checkpointed

#: Edges that one task joins.
CHUNK = 500_000


def core_distances(df: DataFrame, k: int, limit: float, id_col: str = "vec_id", vec: str = "embedding", by: Metric = COSINE) -> DataFrame:
    """(id, core): the distance to the ``k``-th nearest row, itself the first; rows with fewer within ``limit`` are left out.

    A block gives each of its rows the ``k`` - 1 least distances that it sees.
    """
    rows = metric.points(df, by, id_col, vec)
    if k <= 1:
        return rows.select("id", F.lit(0.0).alias("core"))
    placed = metric.cells(rows, by, limit)
    kind = placed.schema["id"].dataType.simpleString()

    def least(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and values of the ``k`` - 1 least of each row that are finite."""
        n = min(k - 1, d.shape[1])
        some = np.partition(d, n - 1, axis=1)[:, :n] if n else d[:, :0]
        r, c = np.nonzero(np.isfinite(some))
        return r, some[r, c]

    def fewest(some: pd.DataFrame) -> pd.DataFrame:
        ids, d = some["id"].to_numpy(), some["d"].to_numpy()
        order = np.lexsort((d, ids))
        ids, d = ids[order], d[order]
        begins = np.concatenate([[True], ids[1:] != ids[:-1]])
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))
        return pd.DataFrame({"id": ids[place < k - 1], "d": d[place < k - 1]})

    def see(left: metric.Part, right: metric.Part, same: bool) -> pd.DataFrame:
        d = metric.block_distances(by, left, right, same)
        if np.isfinite(limit):
            d[d > limit] = np.inf
        if same:
            d = np.minimum(d, d.T)
        made = [(side.id[r], v) for side, (r, v) in ([(left, least(d))] if same else [(left, least(d)), (right, least(d.T.copy()))])]
        return pd.DataFrame({"id": np.concatenate([x for x, _ in made]), "d": np.concatenate([v for _, v in made])})

    seen = metric.in_blocks(placed, see, f"id {kind}, d double", fewest)
    # lists of k - 1 from each task that saw the row
    merged = seen.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k - 1).alias("near"))
    return merged.filter(F.size("near") == k - 1).select("id", F.element_at("near", k - 1).alias("core"))


def lightest(edges: DataFrame) -> DataFrame:
    """(a, b, d): the minimum spanning forest of an edge table, ties by ids, in rounds of each component's lightest edge.

    Components at least halve a round.  Edges inside a component are dropped as soon as it forms.
    """
    kind = edges.schema["a"].dataType.simpleString()
    open_ = checkpointed(edges.select("a", "b", "d", F.col("a").alias("ca"), F.col("b").alias("cb")).filter("a <> b"))
    found = None
    while not open_.isEmpty():
        both = open_.select(F.col("ca").alias("c"), F.struct("d", "a", "b").alias("e")).unionByName(open_.select(F.col("cb").alias("c"), F.struct("d", "a", "b").alias("e")))
        # the order (d, a, b) is total, so the choices make no circle
        best = both.groupBy("c").agg(F.min("e").alias("e")).select("e.a", "e.b", "e.d").distinct()
        taken = checkpointed(best.join(open_.select("a", "b", "ca", "cb").distinct(), ["a", "b"]))
        found = taken.select("a", "b", "d") if found is None else checkpointed(found.unionByName(taken.select("a", "b", "d")))
        roots = checkpointed(components(taken.select("ca", "cb")))
        at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))  # noqa: B023, E731
        moved = open_.join(at("ca"), "ca", "left").join(at("cb"), "cb", "left").select("a", "b", "d", F.coalesce("_ca", "ca").alias("ca"), F.coalesce("_cb", "cb").alias("cb")).filter("ca <> cb")
        # of parallel edges the lightest is enough
        pair = moved.withColumns({"x": F.least("ca", "cb"), "y": F.greatest("ca", "cb")}).groupBy("x", "y").agg(F.min(F.struct("d", "a", "b")).alias("e"))
        open_ = checkpointed(pair.select("e.a", "e.b", "e.d", F.col("x").alias("ca"), F.col("y").alias("cb")))
    return found.distinct() if found is not None else open_.select(F.col("a").cast(kind), F.col("b").cast(kind), "d")


def _lightest(edges: pd.DataFrame) -> pd.DataFrame:
    return metric.lightest_edges(edges["a"].to_numpy(), edges["b"].to_numpy(), edges["d"].to_numpy())


def joined_forests(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of an edge table: shares of ``CHUNK`` edges keep their own while that makes them fewer.

    The one share that is left is the whole; if the forest is larger than a share, it is found in rounds.
    """
    held, schema = checkpointed(edges), edges.schema
    n = held.count()
    while n:
        shares = -(-n // CHUNK)
        one = held.withColumn("share", F.pmod(F.xxhash64("a", "b"), F.lit(shares)))
        held = checkpointed(one.groupBy("share").applyInPandas(lambda x: _lightest(x), schema))
        if shares == 1:
            return held
        before, n = n, held.count()
        if n > 0.7 * before:
            break
    return lightest(held)


def spanning_forest(df: DataFrame, limit: float, id_col: str = "vec_id", vec: str = "embedding", by: Metric = COSINE, cores: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """(a, b, d): the minimum spanning forest of the rows' pairs at a distance of at most ``limit``; with ``within``, of each value of it.

    With ``cores`` (id, core) the distance of a pair is at least the core distance of either, and rows
    without one are left out.  Each block of the matrix gives its own forest, fewer edges than it has rows: an edge that is the heaviest of
    a circle in a block is so in the whole.  So a task, and shares of what the tasks give, keep their forests only; those are joined by their lightest edges.
    """
    placed = metric.cells(metric.points(df, by, id_col, vec, within), by, limit)
    kind = placed.schema["id"].dataType.simpleString()
    placed = placed.join(cores, "id") if cores is not None else placed

    def see(left: metric.Part, right: metric.Part, same: bool) -> pd.DataFrame:
        d = metric.block_distances(by, left, right, same)
        if left.core is not None:
            d = np.maximum(np.maximum(d, left.core[:, None]), right.core[None, :])
        return metric.forest(d, left.id, right.id, limit)

    return joined_forests(metric.in_blocks(placed, see, f"a {kind}, b {kind}, d double", _lightest))
