"""Exact top-k by inner product with multi-resolution segment statistics.

For a segment of w components, Cauchy-Schwarz on the centred parts gives
``x.y <= w * (mean_x * mean_y + dev_x * dev_y)``; summed over segments this bounds the score
from above, that is the distance from below.  Components are first turned to the candidates' own
principal axes, which changes no inner product, so that segments can be short where the vectors
differ and long where they hardly do.  Levels run coarse to fine, each on what the last left
over, against the best k so far; exact integer scores are computed for the survivors only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillshift.llm.common import checkpointed, table

#: Share of the components that are segments of their own at each level, coarse to fine.
LEVELS = (0.0, 0.25, 0.5, 0.75)


def segment_cuts(d: int, alone: float) -> list[int]:
    """Ends of the segments of d components: some alone, then segments that double in length."""
    cuts, width = list(range(int(d * alone) + 1)), 1 if alone == 0 else max(1, d // 8)
    while cuts[-1] < d:
        cuts.append(min(d, cuts[-1] + width))
        width *= 2
    return cuts


def segment_stats(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Scaled segment means and deviations: the dot product of two rows bounds their score."""
    single = sum(b - a == 1 for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    out = [m[:, :single]] if cuts[: single + 1] == list(range(single + 1)) else []
    for a, b in zip(cuts[single if out else 0 : -1], cuts[single + 1 if out else 1 :], strict=True):
        part, root = m[:, a:b], np.sqrt(b - a)
        out += [part.mean(axis=1, keepdims=True) * root, part.std(axis=1, keepdims=True) * root]
    return np.concatenate(out, axis=1)


def _matrix(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact_pairs(q: np.ndarray, c: np.ndarray, alive: np.ndarray, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, candidate row, score) of the pairs that are alive; only those are computed."""
    rows, cols = np.nonzero(alive)
    whole = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] >= 2**52
    for lo in range(0, len(rows), at_once):
        r, j = rows[lo : lo + at_once], cols[lo : lo + at_once]
        a, b = (q[r].astype(np.int64), c[j].astype(np.int64)) if whole else (q[r], c[j])
        yield r, j, np.einsum("ij,ij->i", a, b).astype(np.int64)


def block_topk(
    q_key: np.ndarray, q_id: np.ndarray, q: np.ndarray, c_key: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int,
    start: np.ndarray | None = None, chunk: int = 256, seen: dict[str, int] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one block of candidates for each query: (query row, id, score).

    A candidate with the id and key of a query is the query itself.  ``start`` are scores that a
    candidate must reach, known from other blocks; ``seen`` counts pairs and exact scores.
    """
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    turned_q, turned_c = q @ axes, c @ axes
    levels = [segment_cuts(q.shape[1], s) for s in LEVELS]
    stats_q = [segment_stats(turned_q, cuts) for cuts in levels]
    low = np.iinfo(np.int64).min
    best_s = np.full((len(q), k), low, dtype=np.int64)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max, dtype=np.int64)
    kth = np.full(len(q), -np.inf) if start is None else start.copy()
    # long vectors first: their scores raise the bar for the others
    order = np.argsort(-(c * c).sum(axis=1), kind="stable")
    for lo in range(0, len(c), chunk):
        part = order[lo : lo + chunk]
        cid, cm = c_id[part], c[part]
        alive = (cid[None, :] != q_id[:, None]) | (c_key[part][None, :] != q_key[:, None])
        if seen is not None:
            seen["pairs"] = seen.get("pairs", 0) + int(alive.sum())
        for cuts, sq in zip(levels, stats_q, strict=True):
            live_q, live_c = alive.any(axis=1) & np.isfinite(kth), alive.any(axis=0)
            if not live_q.any():
                break
            bound = sq[live_q] @ segment_stats(turned_c[part[live_c]], cuts).T
            alive[np.ix_(live_q, live_c)] &= bound + 1e-6 * (1 + np.abs(bound)) >= kth[live_q, None]
        if seen is not None:
            seen["exact"] = seen.get("exact", 0) + int(alive.sum())
        score = np.full(alive.shape, low, dtype=np.int64)
        for r, j, s in _exact_pairs(q, cm, alive):
            score[r, j] = s
        rows = np.flatnonzero(alive.any(axis=1))
        s = np.concatenate([best_s[rows], score[rows]], axis=1)
        i = np.concatenate([best_i[rows], np.broadcast_to(cid, score.shape)[rows]], axis=1)
        # descending scores are ascending complements, exact for any integer
        first = np.lexsort((i, ~s), axis=1)[:, :k]
        best_s[rows], best_i[rows] = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
        full = best_s[:, k - 1] != low
        kth[full] = np.maximum(kth[full], best_s[full, k - 1].astype(float))
    r, j = np.nonzero(best_s != low)
    return r, best_i[r, j], best_s[r, j]


def exact_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: float = 64.0,
    query_block: int = 2048,
    candidate_block: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Components become floor(scale * x).  Candidates are all rows but the query's own: another
    vector of the same id is one, rows equal in id and vector count once.  Vectors that are null,
    hold a null or non-finite component, or have a null id take no part.  Shorter vectors count as
    padded with zeros.  Ties go to the smaller id; with fewer than k candidates all are returned.
    Empty input gives no rows; other columns are ignored.

    Queries and candidates are dealt into blocks of bounded size and each pair of blocks is
    one group; only k rows per query leave it.  The first block's k-th best scores are what
    candidates of the other blocks must reach.
    """
    whole = f"transform({vec_col}, x -> floor({scale}D * cast(x as double)))"
    ok = f"{id_col} is not null and {vec_col} is not null and not exists({vec_col}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('Infinity'))"

    def ready(df: DataFrame) -> DataFrame:
        rows = df.filter(ok).select(F.col(id_col).cast("long").alias("vid"), F.expr(whole).alias("v"))
        return rows.distinct().withColumn("vkey", F.xxhash64("v"))

    n_c, n_q = vectors.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n_c // candidate_block)), max(1, -(-n_q // query_block))
    deal = lambda n, seed: F.pmod(F.xxhash64("vid", "vkey", F.lit(seed)), F.lit(n)).cast("int")
    cand = ready(vectors).withColumn("cb", deal(c_blocks, 1))
    quer = ready(queries).withColumn("qb", deal(q_blocks, 2))
    schema = "query_id long, query_key long, vec_id long, score long"

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        is_q = pdf["is_q"].to_numpy() == 1
        if is_q.all() or not is_q.any():
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "query_key", "vec_id", "score")})
        ids, keys, vs = pdf["vid"].to_numpy(dtype=np.int64), pdf["vkey"].to_numpy(dtype=np.int64), pdf["v"].to_numpy()
        dim = max(1, max(len(v) for v in vs))
        start = pdf["bar"].fillna(-np.inf).to_numpy(dtype=float)[is_q]
        r, i, s = block_topk(keys[is_q], ids[is_q], _matrix(vs[is_q], dim), keys[~is_q], ids[~is_q], _matrix(vs[~is_q], dim), k, start)
        return pd.DataFrame({"query_id": ids[is_q][r], "query_key": keys[is_q][r], "vec_id": i, "score": s})

    def searched(some: DataFrame, asked: DataFrame, blocks: range) -> DataFrame:
        """Each query against the candidates of some blocks."""
        each = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi)))
        left = some.select("vid", "v", "vkey", "cb", each(0, q_blocks - 1).alias("qb"), F.lit(0).alias("is_q"), F.lit(None).cast("double").alias("bar"))
        right = asked.select("vid", "v", "vkey", each(blocks[0], blocks[-1]).alias("cb"), "qb", F.lit(1).alias("is_q"), "bar")
        return left.unionByName(right).groupBy("cb", "qb").applyInPandas(search, schema)

    part = searched(cand.filter("cb = 0"), quer.withColumn("bar", F.lit(None).cast("double")), range(1))
    if c_blocks > 1:
        part = checkpointed(part)
        # fewer than k scores set no bar
        bars = part.groupBy("query_id", "query_key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("bar"))
        asked = quer.join(bars, (F.col("vid") == F.col("query_id")) & (F.col("vkey") == F.col("query_key")), "left").drop("query_id", "query_key")
        part = part.unionByName(searched(cand.filter("cb > 0"), asked, range(1, c_blocks)))
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``embeddings`` for every row whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter("vec_id % 20 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, q.e AS own, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id OR q.e <> c.e
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) <= 20
"""
