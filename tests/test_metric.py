"""Close pairs, density clusters and spanning forests in cells against all pairs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillshift.functions.text import collapse
from quillshift.operators import cluster, hierarchy, metric, spanning

SHARES = {"cosine": metric.COSINE, "euclidean": metric.EUCLIDEAN, "mixed": metric.Metric(0.4)}


def plain_distance(m, x, y):
    (a, b), (c, d) = x, y
    near = far = 0.0
    if m.share > 0:
        size = math.hypot(*a) * math.hypot(*c)
        if not size:
            return math.inf
        near = 1 - float(np.dot(a, c)) / size
    if m.share < 1:
        far = math.dist(b, d)
    return m.share * near + (1 - m.share) * far


def sample(n, seed, clusters=12, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    rows = []
    for i in range(n):
        c = centres[rng.integers(clusters)]
        a = c + rng.normal(scale=0.03, size=dims) if i % 9 else rng.normal(size=dims)
        rows.append((i, [float(x) for x in a], [float(x) for x in a[:2]]))
    return rows


def frame(spark, rows, m):
    df = spark.createDataFrame(rows, "vec_id long, a array<double>, b array<double>").withColumn("cell", F.lit("clash"))
    return df.withColumn("embedding", F.struct(F.col("a").alias("e"), F.col("b").alias("f")) if 0 < m.share < 1 else F.col("a" if m.share else "b")).drop("a", "b")


def plain_pairs(rows, m, eps):
    return {(x[0], y[0]) for x, y in itertools.combinations(sorted(rows), 2) if plain_distance(m, x[1:], y[1:]) <= eps}


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(metric, "BLOCK", 64)
    monkeypatch.setattr(metric, "DEAL", 100)


@pytest.mark.parametrize(("name", "eps"), [("cosine", 0.01), ("cosine", 0.4), ("euclidean", 0.1), ("euclidean", 0.0), ("mixed", 0.05)])
def test_pairs_equal_all_pairs(spark, tiny_blocks, name, eps):
    m, rows = SHARES[name], sample(400, 1)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(2000 + i, [1.0] * 6, [1.0, 1.0]) for i in range(90)]
    got = cluster.close_pairs(frame(spark, rows, m), eps, "vec_id", "embedding", m)
    found = [(r["a"], r["b"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_pairs(rows, m, eps)


def test_blocks_copy_no_rows_for_the_pairs(spark, tiny_blocks):
    """Parts of a cell meet in a product: a copy of each row for each part would grow with the square of a cell."""
    rows = [(i, x, y) for i, x, y in sample(500, 7, clusters=1)]
    placed = metric.points(frame(spark, rows, metric.COSINE), metric.COSINE, "vec_id", "embedding").withColumn("guest", F.lit(0).cast("long"))
    made = metric.pairs_within(placed, metric.COSINE, 0.3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in plan
    assert {(r["a"], r["b"]) for r in made.collect()} == plain_pairs(rows, metric.COSINE, 0.3)


def test_cells_meet_their_pivots_in_many_partitions(spark, monkeypatch):
    """Rows and pivots of a cell meet in one task, however many partitions there are; some salts have no rows."""
    monkeypatch.setattr(metric, "BLOCK", 32)
    monkeypatch.setattr(metric, "DEAL", 2)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(kept, ("16", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        rows = sample(150, 8)
        found = [(r["a"], r["b"]) for r in cluster.close_pairs(frame(spark, rows, metric.COSINE), 0.02, "vec_id", "embedding").collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(found) == len(set(found)) and set(found) == plain_pairs(rows, metric.COSINE, 0.02)


def test_rows_without_distances_are_in_no_pair(spark):
    rows = [(1, [0.0, 0.0], []), (2, [1.0, float("nan")], []), (3, [1.0, None], []), (4, None, []), (5, [1.0, 0.0], []), (6, [2.0, 0.0], []), (None, [1.0, 0.0], []), (7, [float("inf"), 1.0], []), (8, [], [])]
    df = frame(spark, rows, metric.COSINE)
    assert [tuple(r) for r in cluster.close_pairs(df, 0.1, "vec_id", "embedding").collect()] == [(5, 6)]
    assert cluster.close_pairs(df.limit(0), 0.1, "vec_id", "embedding").count() == 0
    assert {(r["id"], r["label"]) for r in cluster.dbscan(df, 0.1, 2).collect()} == {(5, 5), (6, 5), *((i, -1) for i in (1, 2, 3, 4, 7, 8, None))}


def test_clustered_rows_are_compared_with_few(spark):
    rows = [(i, r[1], r[2]) for i, r in enumerate(sample(6000, 2, clusters=40, dims=16))]
    placed = metric.cells(metric.points(frame(spark, rows, metric.COSINE), metric.COSINE, "vec_id", "embedding"), metric.COSINE, 0.02, whole=128)
    assert metric.compared_pairs(placed) < 0.1 * 6000 * 5999 / 2


def plain_dbscan(rows, m, eps, least):
    near = {x[0]: {x[0]} for x in rows}
    for a, b in plain_pairs(rows, m, eps):
        near[a].add(b)
        near[b].add(a)
    core = {x for x, ns in near.items() if len(ns) >= least}
    label = {x: x for x in core}
    moved = True
    while moved:
        moved = False
        for x in core:
            low = min(label[y] for y in near[x] & core)
            moved |= low < label[x]
            label[x] = min(label[x], low)
    return {x: label[x] if x in core else min((label[y] for y in ns & core), default=-1) for x, ns in near.items()}


@pytest.mark.parametrize(("name", "eps"), [("cosine", 0.01), ("euclidean", 0.1), ("mixed", 0.05)])
def test_dbscan_equals_plain(spark, tiny_blocks, name, eps):
    m, rows = SHARES[name], sample(300, 3)
    got = {r["id"]: r["label"] for r in cluster.dbscan(frame(spark, rows, m), eps, 4, distance=m).collect()}
    assert got == plain_dbscan(rows, m, eps, 4)


def test_links_of_a_dense_cluster_are_as_many_as_its_rows(spark, tiny_blocks):
    """A task gives one forest of all its blocks, not one of each."""
    rows = [(i, [1.0, 0.0], [0.0, 0.0]) for i in range(200)]
    df = frame(spark, rows, metric.COSINE)
    placed = metric.points(df, metric.COSINE, "vec_id", "embedding").withColumn("guest", F.lit(0).cast("long"))
    assert metric.core_links(placed, df.select(F.col("vec_id").alias("id")), metric.COSINE, 0.1).count() == 199
    assert {r["others"] for r in metric.neighbour_weights(placed, metric.COSINE, 0.1).collect()} == {199}


def test_within_and_weights(spark):
    rows = [(1, [1.0, 0.0], []), (2, [1.0, 0.001], []), (3, [1.0, 0.002], []), (4, [0.0, 1.0], [])]
    df = frame(spark, rows, metric.COSINE).withColumn("g", F.when(F.col("vec_id") != 2, "x").otherwise("y")).withColumn("n", F.when(F.col("vec_id") == 4, 5).otherwise(1))
    assert [tuple(r) for r in cluster.close_pairs(df, 0.1, "vec_id", "embedding", within="g").collect()] == [(1, 3)]
    assert {r["id"]: r["label"] for r in cluster.dbscan(df, 0.1, 4, weight="n").collect()} == {1: -1, 2: -1, 3: -1, 4: 4}


# ---- forests


def plain_forest(rows, m, limit, cores=None):
    edges = sorted(
        (max(plain_distance(m, x[1:], y[1:]), *((cores[x[0]], cores[y[0]]) if cores else (0.0,))), x[0], y[0])
        for x, y in itertools.combinations(sorted(rows), 2)
    )
    root, out = {r[0]: r[0] for r in rows}, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, a, b in edges:
        if d <= limit and find(a) != find(b):
            root[find(a)] = find(b)
            out.append(round(d, 9))
    return sorted(out)


@pytest.mark.parametrize(("name", "limit"), [("cosine", 2.0), ("cosine", 0.05), ("euclidean", 0.3)])
def test_forest_equals_plain(spark, tiny_blocks, name, limit):
    m, rows = SHARES[name], sample(200, 4)
    got = spanning.spanning_forest(frame(spark, rows, m), limit, by=m).collect()
    assert sorted(round(r["d"], 9) for r in got) == plain_forest(rows, m, limit)


@pytest.mark.parametrize("share", [500_000, 150])
def test_forests_of_tasks_are_joined_by_shares(spark, tiny_blocks, monkeypatch, share):
    """What fits a share is joined there; rounds are for larger forests only."""

    def rounds(edges):
        assert share < 200, "a round for a forest of one share"
        return lightest(edges)

    lightest = spanning.lightest
    monkeypatch.setattr(spanning, "CHUNK", share)
    monkeypatch.setattr(spanning, "lightest", rounds)
    rows = sample(190, 6) + [(500 + i, [1.0] * 6, [0.0, 0.0]) for i in range(10)]
    got = spanning.spanning_forest(frame(spark, rows, metric.COSINE), 2.0).collect()
    assert np.allclose(sorted(r["d"] for r in got), plain_forest(rows, metric.COSINE, 2.0), atol=1e-8)


def test_core_distances_and_their_forest(spark, tiny_blocks):
    rows = sample(150, 5)
    df = frame(spark, rows, metric.COSINE)
    cores = spanning.core_distances(df, 4, 2.0)
    plain = {x[0]: sorted(plain_distance(metric.COSINE, x[1:], y[1:]) for y in rows)[3] for x in rows}
    assert {r["id"]: round(r["core"], 9) for r in cores.collect()} == {k: round(v, 9) for k, v in plain.items()}
    got = spanning.spanning_forest(df, 2.0, cores=cores).collect()
    assert sorted(round(r["d"], 9) for r in got) == plain_forest(rows, metric.COSINE, 2.0, plain)


# ---- knees and strategies


def plain_knee(rows):
    xs = [round(0.1 + 0.1 * i, 6) for i in range(10)]
    counts = [len(set(plain_dbscan(rows, metric.COSINE, x, 2).values())) for x in xs]
    return cluster.knee(xs, counts) or 0.5


def grouped(labels):
    out = {}
    for i, label in labels.items():
        out.setdefault(label, set()).add(i)
    return {frozenset(g) for g in out.values()}


def test_strategies_equal_plain(spark):
    """Each format has a knee of its own; sparse clusters go to the nearest centroid."""
    rows = sample(90, 6, clusters=5, dims=4)
    texts = {i: ("ab 12", "AB-1", "x.y", f"q{'!' * (i % 3)}")[i % 4] for i, *_ in rows}
    df = frame(spark, rows, metric.COSINE)
    df = df.join(spark.createDataFrame(list(texts.items()), "vec_id long, input string"), "vec_id").withColumnRenamed("vec_id", "row_id")
    forms = {r[0]: r[1] for r in df.select("row_id", collapse(F.col("input"))).collect()}
    by_form = {}
    for r in rows:
        by_form.setdefault(forms[r[0]], []).append(r)
    split = set()
    for own in by_form.values():
        split |= grouped(plain_dbscan(own, metric.COSINE, plain_knee(own), 3))
    of = lambda made: grouped({r["row_id"]: r["cluster_id"] for r in made.collect()})
    assert of(cluster.cluster(df, "collapse_split")) == split
    vectors = {r[0]: np.array(r[1]) for r in rows}
    dense = {c: np.mean([vectors[i] for i in c], axis=0) for c in split if len(c) >= 3}
    far = lambda a, b: round(1 - float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b)), 12)
    merged = {c: set(c) for c in dense}
    for i in (i for c in split if len(c) < 3 for i in c):
        merged[min(dense, key=lambda c: far(vectors[i], dense[c]))].add(i)
    assert of(cluster.cluster(df, "collapse_embedding")) == {frozenset(c) for c in merged.values()}
    assert of(cluster.cluster(df, "embedding")) == grouped(plain_dbscan(rows, metric.COSINE, plain_knee(rows), 3))


# ---- hierarchical density clusters


def plain_hdbscan(rows, least, k, m=metric.COSINE):
    """From the top: take the heaviest edge out, again and again."""
    d = lambda x, y: plain_distance(m, x[1:], y[1:])
    cores = {x[0]: sorted(d(x, y) for y in rows)[k - 1] for x in rows}
    edges = sorted((max(d(x, y), cores[x[0]], cores[y[0]]), min(x[0], y[0]), max(x[0], y[0])) for x, y in itertools.combinations(rows, 2))
    root, tree = {r[0]: r[0] for r in rows}, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for w, a, b in edges:
        if find(a) != find(b):
            root[find(a)] = find(b)
            tree.append((w, a, b))

    def parts(nodes, own):
        side, grown = {own[-1][1]}, True
        while grown:
            grown = False
            for _, a, b in own[:-1]:
                if (a in side) != (b in side):
                    side |= {a, b}
                    grown = True
        cut = lambda s: [e for e in own[:-1] if e[1] in s]
        return (side, cut(side)), (nodes - side, cut(nodes - side))

    def grow(nodes, own, birth):
        """(value, clusters) of the cluster born at ``birth`` with these rows."""
        stability = 0.0
        while True:
            if not own:
                return stability, [nodes0] if nodes0 else []
            density = 1 / max(own[-1][0], 1e-12)
            (x, ex), (y, ey) = parts(nodes, own)
            big = [p for p in ((x, ex), (y, ey)) if len(p[0]) >= least]
            stability += (density - birth) * (len(nodes) if len(big) != 1 else len(nodes) - len(big[0][0]))
            if len(big) == 2:
                below = [grow_from(p, e, density) for p, e in big]
                value = sum(v for v, _ in below)
                return (value, [c for _, cs in below for c in cs]) if value > stability or nodes0 is None else (stability, [nodes0])
            if not big:
                return (stability, [nodes0]) if nodes0 else (0.0, [])
            nodes, own = big[0]

    def grow_from(nodes, own, birth):
        nonlocal nodes0
        before, nodes0 = nodes0, nodes
        made = grow(nodes, own, birth)
        nodes0 = before
        return made

    nodes0 = None
    _, clusters = grow({r[0] for r in rows}, tree, 0.0)
    label = {r[0]: -1 for r in rows}
    for c in clusters:
        label |= {i: min(c) for i in c}
    return label


@pytest.mark.parametrize(("chunk", "least", "k"), [(10_000, 5, 5), (45, 3, 5)])
def test_hdbscan_equals_plain(spark, chunk, least, k):
    rows = sample(120, 7, clusters=6, dims=3)
    got = {r["id"]: r["label"] for r in hierarchy.hdbscan(frame(spark, rows, metric.COSINE), least, k, chunk=chunk).collect()}
    want = plain_hdbscan(rows, least, k)
    assert got == want and len(set(want.values())) > 2
