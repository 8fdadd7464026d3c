"""Density clusters of varying density: mutual reachability, condensed tree, most stable clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillshift.operators.cluster import by_columns
from quillshift.operators.components import components
from quillshift.operators.metric import COSINE, Metric
from quillshift.operators.spanning import core_distances, spanning_forest
from quillshift.sources.shared import checkpointed, small

#: Edges of the forest that one round takes, in order; a task holds no more.
CHUNK = 500_000
#: Distances below count as this, so that equal rows have a density.
LEAST = 1e-12
_OUT = "kind string, node long, other long, size long, cluster long, total double, best double, flag boolean"


def _round(edges: pd.DataFrame, states: pd.DataFrame, least: int) -> pd.DataFrame:
    """Join components along their edges in order; what happens to clusters of ``least`` rows and more.

    ``exit``: the rows of component ``node`` leave cluster ``other``.  ``cluster``: cluster ``node`` ends below ``other``; ``flag``
    says whether it is more stable than those below it.  ``state``: a component as it is now.  ``moved``: component ``node`` is now ``other``.
    """
    known = {r.comp: (int(r.size), r.cluster, r.total, r.best) for r in states.itertuples() if r.size == r.size}
    root: dict[int, int] = {}
    held: dict[int, list] = {}
    out: list[tuple] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in {*edges["ca"].tolist(), *edges["cb"].tolist()}:
        size, cluster, total, best = known.get(x, (1, None, 0.0, 0.0))
        cluster = None if cluster is None or cluster != cluster else int(cluster)
        root[x], held[x] = x, [size, cluster, total, best, [x] if cluster is None else []]
    for e in edges.sort_values("place").itertuples():
        x, y = find(e.ca), find(e.cb)
        a, b, density = held[x], held[y], 1 / max(e.d, LEAST)
        size, place = a[0] + b[0], int(e.place)
        if a[1] is not None and b[1] is not None:
            value = 0.0
            for c in (a, b):
                stable = c[2] - c[0] * density
                out.append(("cluster", c[1], place, c[0], None, stable, c[3], stable >= c[3]))
                value += max(stable, c[3])
            new = [size, place, size * density, value, []]
        elif a[1] is None and b[1] is None:
            born = size >= least
            new = [size, place if born else None, size * density if born else 0.0, 0.0, [] if born else a[4] + b[4]]
            gone = a[4] + b[4] if born else []
            out += [("exit", n, place, None, None, None, None, None) for n in gone]
        else:
            big, few = (a, b) if a[1] is not None else (b, a)
            out += [("exit", n, big[1], None, None, None, None, None) for n in few[4]]
            new = [size, big[1], big[2] + few[0] * density, big[3], []]
        low, high = min(x, y), max(x, y)
        root[high] = low
        held[low] = new
        del held[high]
    for x in list(root):
        if find(x) != x:
            out.append(("moved", x, find(x), None, None, None, None, None))
    out += [("state", x, None, s[0], s[1], s[2], s[3], None) for x, s in held.items()]
    frame = pd.DataFrame(out, columns=["kind", "node", "other", "size", "cluster", "total", "best", "flag"])
    for c in ("node", "other", "size", "cluster"):
        frame[c] = frame[c].astype("Int64")
    return frame.astype({"flag": "boolean", "total": "float64", "best": "float64"})


def condensed(ids: DataFrame, edges: DataFrame, least: int, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """((id, cluster), (cluster, parent, stability, flag)): the condensed tree of a spanning forest (a, b, d).

    Edges are taken by weight in rounds of ``chunk``.  In a round the components that its edges join are groups
    of their own, so a task has at most one round's edges; a component is carried on as its size and the sums of its
    cluster.  Rows belong to the cluster that they leave as the density rises.
    """
    order = checkpointed(by_columns(edges.filter("a is not null and b is not null").select("a", "b", "d").distinct(), ["d", "a", "b"], "place"))
    labels = checkpointed(ids.select(F.col("id"), F.col("id").alias("comp")))
    states = ids.select(F.col("id").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("cluster"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best")).limit(0)
    states = checkpointed(states)
    exits, clusters = None, None
    for n in range(-(-order.count() // chunk)):
        mine = order.filter((F.col("place") >= n * chunk) & (F.col("place") < (n + 1) * chunk))
        at = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))  # noqa: B023, E731
        joined = checkpointed(mine.join(at("a"), "a").join(at("b"), "b").select("place", "d", "ca", "cb"))
        roots = checkpointed(components(joined.select("ca", "cb")))
        grouped = joined.join(roots.select(F.col("node").alias("ca"), "root"), "ca")
        own = roots.join(states, roots["node"] == states["comp"], "left").select(F.col("root").alias("at"), F.col("node").alias("comp"), "size", "cluster", "total", "best")
        done = checkpointed(grouped.groupBy("root").cogroup(own.groupBy("at")).applyInPandas(lambda e, s: _round(e, s, least), _OUT))
        of = lambda kind: done.filter(F.col("kind") == kind)  # noqa: B023, E731
        left = of("exit").select(F.col("node").alias("comp"), F.col("other").alias("cluster")).join(labels, "comp").select("id", "cluster")
        ended = of("cluster").select(F.col("node").alias("cluster"), F.col("other").alias("parent"), F.col("total").alias("stability"), "flag")
        exits = checkpointed(left if exits is None else exits.unionByName(left))
        clusters = checkpointed(ended if clusters is None else clusters.unionByName(ended))
        moved = of("moved").select(F.col("node").alias("comp"), F.col("other").alias("to"))
        labels = checkpointed(labels.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
        fresh = of("state").select(F.col("node").alias("comp"), "size", "cluster", "total", "best")
        states = checkpointed(states.join(roots.select(F.col("node").alias("comp")), "comp", "left_anti").unionByName(fresh))
    if exits is None:
        none = ids.select("id", F.lit(None).cast("long").alias("cluster")).limit(0)
        return none, none.select("cluster", F.col("cluster").alias("parent"), F.lit(0.0).alias("stability"), F.lit(False).alias("flag"))
    # what is left at the end is a root, which is no cluster itself
    top = states.filter("cluster is not null").select("cluster", F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("stability"), F.lit(False).alias("flag"))
    return exits, clusters.unionByName(top)


def chosen(clusters: DataFrame) -> DataFrame:
    """(cluster, top): the highest cluster above or at each that has the flag, by doubling of pointers."""
    held = checkpointed(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("flag"), F.col("cluster")).alias("top")))
    while not held.filter("up is not null").isEmpty():
        above = held.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        held = checkpointed(held.join(above, "up", "left").select("cluster", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top")))
    return held.select("cluster", "top")


def hdbscan(df: DataFrame, min_cluster_size: int = 5, min_samples: int = 5, id_col: str = "vec_id", vec: str = "embedding", by: Metric = COSINE, limit: float = float("inf"), chunk: int = CHUNK) -> DataFrame:
    """(id, label): the most stable density clusters, named by their smallest id; -1 for noise.

    A row's core distance is that to its ``min_samples``-th nearest, itself the first.  Rows without so many within
    ``limit``, and null or undefined vectors, are noise; pairs beyond ``limit`` are not joined, which
    keeps far cells from being compared.  The whole table is never one cluster.  Ids are whole numbers and distinct.
    """
    cores = checkpointed(core_distances(df, min_samples, limit, id_col, vec, by))
    edges = checkpointed(spanning_forest(df, limit, id_col, vec, by, cores))
    exits, clusters = condensed(cores.select(F.col("id").cast("long").alias("id")), edges, min_cluster_size, chunk)
    member = exits.join(small(chosen(clusters)), "cluster").filter("top is not null")
    named = member.groupBy("top").agg(F.min("id").alias("label"))
    found = member.join(small(named), "top").select("id", "label")
    return df.select(F.col(id_col).alias("id")).join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))
