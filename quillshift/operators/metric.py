"""Close pairs, neighbour counts and spanning forests without comparing all rows.

Rows are laid out by a Euclidean metric that bounds the distance asked for.  A cell takes some of its
rows as pivots, gives each row to its nearest pivot, and copies it to those whose side of
the bisector it may reach within the radius.  Cells are split again while that saves work; what stays
is compared as blocks of a matrix.  Every pair within the radius meets in exactly one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillshift.sources.shared import checkpointed, small

#: Rows of a block of the matrix; cells of up to half as many are left whole.
BLOCK = 1024
#: Pivots of a cell at most.
PIVOTS = 64
#: Parts of one side that a task of the product holds, about a megabyte each.
SIDE = 64
#: Rows that one task deals to pivots.
DEAL = 8192
#: Rounding of distances, which are 1 at the radius.
SLACK = 1e-6


def padded(values: Sequence) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(values), max((len(v) for v in values), default=0)))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


@dataclass(frozen=True)
class Metric:
    """A distance of rows with the vectors ``a`` and ``b``: ``share`` times the cosine distance of ``a``, and
    the rest times the Euclidean distance of ``b``.

    Cosine and Euclidean distance are the cases 1 and 0.  A row whose distance to any is undefined (a zero vector under
    a cosine, nulls, infinite or no numbers) is in no pair.
    """

    share: float = 1.0

    def laid_out(self, a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
        """Points such that a distance of at most ``eps`` puts them at most 1 apart."""
        eps = max(eps, 1e-12)
        parts = []
        if self.share > 0:
            # the chord c between unit vectors has c * c / 2 as cosine distance
            parts.append(a / np.linalg.norm(a, axis=1)[:, None] * np.sqrt(self.share / (2 * eps)))
        if self.share < 1:
            parts.append(b * ((1 - self.share) / eps))
        return np.concatenate(parts, axis=1)

    def between(self, a: np.ndarray, b: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
        """Distances of all rows to all; ``a`` and ``a2`` are ``directions``."""
        if self.share == 1:
            near = a @ a2.T
            return np.subtract(1, near, out=near)
        # differences, not products: equal distances stay equal to the last bit
        far = np.zeros((len(b), len(b2)))
        for d in range(b.shape[1]):
            far += (b[:, d, None] - b2[None, :, d]) ** 2
        np.sqrt(far, out=far)
        return self.share * (1 - a @ a2.T) + (1 - self.share) * far if self.share > 0 else far


def directions(a: np.ndarray) -> np.ndarray:
    """Unit vectors; rows of no numbers for vectors without a direction."""
    if not a.shape[1]:
        return a
    with np.errstate(invalid="ignore", divide="ignore"):
        scaled = a / np.abs(a).max(axis=1)[:, None]
        return scaled / np.linalg.norm(scaled, axis=1)[:, None]


COSINE, EUCLIDEAN = Metric(1.0), Metric(0.0)


def points(df: DataFrame, metric: Metric, id_col: str, vec: str, within: str | None = None, weight: str | None = None, limit: str | None = None) -> DataFrame:
    """(id, a, b, w, lim, cell): the rows that can be in a pair; ``vec`` is an array, or a struct (e, f) for a mixed metric.

    ``limit`` is a column of greatest distances, one for all rows of a value of ``within``.
    """
    mixed = 0 < metric.share < 1
    none = F.array().cast("array<double>")
    of = lambda c: F.col(c).cast("array<double>")
    a = of(f"{vec}.e") if mixed else of(vec) if metric.share == 1 else none
    b = of(f"{vec}.f") if mixed else of(vec) if metric.share == 0 else none
    finite = lambda v: ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(
        F.col(id_col).alias("id"), a.alias("a"), b.alias("b"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("w"),
        (F.col(limit).cast("double") if limit else F.lit(float("inf"))).alias("lim"), (F.col(within).cast("string") if within else F.lit("")).alias("cell"),
    ).filter("id is not null and cell is not null")
    rows = rows.filter(finite(F.col("a")) & finite(F.col("b")))
    return rows.filter(F.exists("a", lambda x: x != 0)) if metric.share > 0 else rows


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return padded(list(pdf["a"])), padded(list(pdf["b"]))


def _width(rows: DataFrame) -> tuple[int, int]:
    """The longest vectors, to which all are padded."""
    n = rows.agg(F.max(F.size("a")), F.max(F.size("b"))).first()
    return (n[0] or 0, n[1] or 0)


def _spread(p: np.ndarray, apart: float = 4.0) -> np.ndarray:
    """Of the pivots those that are ``apart`` from all kept before: near ones would share all their rows."""
    kept = [0]
    for i in range(1, len(p)):
        if ((p[kept] - p[i]) ** 2).sum(1).min() >= apart * apart:
            kept.append(i)
    return p[kept]


def split_once(rows: DataFrame, metric: Metric, eps: float, level: int, whole: int) -> tuple[DataFrame, DataFrame] | None:
    """(rows of cells that were split, rows of the others); None if there is nothing to split.

    A cell of more than ``whole`` rows is split if that at least halves its comparisons.  ``guest`` marks
    copies: two rows that are copies at the same level are compared in another cell.
    """
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole)
    big = checkpointed(sizes.withColumn("k", F.least(F.lit(PIVOTS), F.ceil(2 * F.col("n") / whole) + 1).cast("int")).withColumn("salts", F.ceil(F.col("n") / DEAL).cast("int")))
    if big.isEmpty():
        return None
    held = rows.join(small(big), "cell")
    # a row of each of k hash classes
    chosen = held.groupBy("cell", "salts", F.pmod(F.xxhash64("id"), F.col("k")).alias("class")).agg(F.min_by(F.struct("a", "b"), F.xxhash64(F.lit(level), "id")).alias("p"))
    dealt = chosen.select(F.col("cell").alias("pcell"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("psalt"), "class", "p.a", "p.b")
    # of one type with psalt: keys of a cogroup are not cast, and hashes of an int and a long differ
    asked = held.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "id"), F.col("salts")).cast("int")).drop("k", "salts")
    kind = rows.schema["id"].dataType.simpleString()
    wide = _width(rows)

    def deal(mine: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if mine.empty:  # no row has this salt
            return mine.drop(columns="salt").assign(kids=pd.Series(dtype=object))
        both = pd.concat([mine[["a", "b"]], pivots.sort_values("class")[["a", "b"]]])
        a, b = (np.pad(m, ((0, 0), (0, w - m.shape[1]))) for m, w in zip(_rows(both), wide, strict=True))
        z = metric.laid_out(a, b, eps)
        x, p = z[: len(mine)], _spread(z[len(mine) :])
        square = np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T)
        home = square.argmin(1)
        apart = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(2)) if len(p) > 1 else np.zeros((1, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            over = (square - square[np.arange(len(x)), home][:, None]) / (2 * apart[home])
            # squares are rounded as the points are large
            slack = SLACK * (1 + ((x * x).sum(1)[:, None] + (p * p).sum(1).max()) / apart[home] * 1e-6)
        reach = over <= 1 + slack
        reach &= np.arange(len(p))[None, :] < home[:, None]
        kids = [[int(h), *np.flatnonzero(r).tolist()] for h, r in zip(home, reach, strict=True)]
        return mine.drop(columns="salt").assign(kids=pd.Series(kids, index=mine.index, dtype=object))

    schema = f"cell string, id {kind}, a array<double>, b array<double>, w long, lim double, guest long, kids array<int>"
    placed = checkpointed(asked.select("cell", "id", "a", "b", "w", "lim", "guest", "salt").groupBy("cell", "salt").cogroup(dealt.groupBy("pcell", "psalt")).applyInPandas(deal, schema))
    cost = placed.select("cell", F.explode("kids").alias("kid")).groupBy("cell", "kid").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost"))
    worth = checkpointed(big.join(cost, "cell").select("cell", (F.col("cost") <= 0.5 * F.col("n").cast("double") * F.col("n")).alias("worth")))
    judged = placed.join(small(worth), "cell")
    moved = judged.filter("worth").select("id", "a", "b", "w", "lim", "guest", "cell", F.posexplode("kids").alias("pos", "kid"))
    split = moved.select("id", "a", "b", "w", "lim", F.concat_ws(".", "cell", "kid").alias("cell"), F.when(F.col("pos") > 0, F.col("guest").bitwiseOR(F.lit(1 << level))).otherwise(F.col("guest")).alias("guest"))
    left = rows.join(small(big.select("cell")), "cell", "left_anti").unionByName(judged.filter("not worth").select("id", "a", "b", "w", "lim", "cell", "guest"))
    return split, left


def cells(rows: DataFrame, metric: Metric, eps: float, whole: int | None = None, levels: int = 12) -> DataFrame:
    """``rows`` with copies, in cells such that rows within ``eps`` of each other meet once without a common bit in ``guest``."""
    whole = whole or BLOCK // 2
    todo, done = checkpointed(rows.withColumn("guest", F.lit(0).cast("long"))), []
    for level in range(levels):
        made = split_once(todo, metric, eps, level, whole)
        if made is None:
            break
        todo = checkpointed(made[0])
        done.append(checkpointed(made[1]))
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, [todo, *done])


def compared_pairs(placed: DataFrame) -> int:
    """How many pairs of rows the blocks of ``placed`` compare."""
    n = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    return int(n or 0)


@dataclass
class Part:
    """Rows of a cell, by their ids; ``a`` are directions, ``core`` is what the caller knows of each row."""

    id: np.ndarray
    a: np.ndarray
    b: np.ndarray
    w: np.ndarray
    lim: np.ndarray
    guest: np.ndarray
    core: np.ndarray | None

    def __len__(self) -> int:
        return len(self.id)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists as rows; shorter ones end in zeros."""
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    if not len(sizes) or (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1) if len(flat) else np.zeros((len(sizes), 0))
    return padded(np.split(flat, np.cumsum(sizes)[:-1]))


def _part(rows: pa.StructArray) -> Part:
    held = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
    ids = held["id"].to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    plain = lambda c: held[c].to_numpy(zero_copy_only=False)[order]
    return Part(ids[order], directions(_matrix(held["a"])[order]), _matrix(held["b"])[order], plain("w"), plain("lim"), plain("guest"), plain("core") if "core" in held else None)


#: Rows of results that a task keeps before it folds them.
FOLD = 1 << 20
#: Bytes of parts that a task keeps as matrices.
SEEN = 96 << 20
#: Parts of a cell that one task may compare.
FEW = 6


def in_blocks(placed: DataFrame, see: Callable[[Part, Part, bool], pd.DataFrame], schema: str, fold: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """``see(left, right, same)`` for each pair of parts of each cell, a part having at most about ``BLOCK`` rows.

    Within one part ``left`` and ``right`` are the same rows; a cell of one part is one block.  A part is one row of a table
    that is written once; parts of larger cells meet in a product that reads them again, so nothing on disk grows with
    the pairs.  ``fold`` makes fewer of the results that a task has so far.
    """
    sizes = placed.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("parts"))
    held = placed.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    row = F.struct(*[c for c in ("id", "a", "b", "w", "lim", "guest", "core") if c in placed.columns])
    parts = checkpointed(held.groupBy("cell", "own", "parts").agg(F.collect_list(row).alias("rows")))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Part] = {}
        kept: list[pd.DataFrame] = []

        def part(cell: str, own: int, rows: pa.StructArray) -> Part:
            if (cell, own) not in known:
                if sum(x.a.nbytes + x.b.nbytes for x in known.values()) > SEEN:
                    known.clear()
                known[cell, own] = _part(rows)
            return known[cell, own]

        def out(some: list[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
            if some and sum(map(len, some)):
                yield pa.RecordBatch.from_pandas(pd.concat(some)[names], schema=form, preserve_index=False)

        for batch in batches:
            cells, i, j = (batch.column(c).to_pylist() for c in ("cell", "i", "j"))
            lefts, rights = batch.column("left"), batch.column("right")
            for n, cell in enumerate(cells):
                left = part(cell, i[n], lefts[n].values)
                same = i[n] == j[n]
                kept.append(see(left, left if same else part(cell, j[n], rights[n].values), same))
                if sum(map(len, kept)) > FOLD:
                    if fold is None:
                        yield from out(kept)
                        kept = []
                    elif len(kept) > 1:
                        kept = [fold(pd.concat(kept))]
        yield from out([fold(pd.concat(kept))] if fold is not None and kept else kept)

    form = to_arrow_schema(StructType.fromDDL(schema))
    names = form.names
    none = F.lit(None).cast(parts.schema["rows"].dataType)
    done = parts.filter("parts = 1").select("cell", F.col("own").alias("i"), F.col("own").alias("j"), F.col("rows").alias("left"), none.alias("right")).mapInArrow(blocks, schema)
    side = lambda which, own, rows: parts.filter(which).select("cell", F.col("own").alias(own), F.col("rows").alias(rows))
    some, large = f"parts between 2 and {FEW}", f"parts > {FEW}"
    pair = lambda left, right: left.join(right.withColumnRenamed("cell", "cell2"), (F.col("cell") == F.col("cell2")) & (F.col("i") <= F.col("j"))).select("cell", "i", "j", "left", "right")
    few, many = parts.agg(F.count_if(F.expr(some)), F.count_if(F.expr(large))).first()
    if few:
        done = done.unionByName(pair(side(some, "i", "left"), side(some, "j", "right")).mapInArrow(blocks, schema))
    if not many:
        return done
    # of the product of two parts half the pairs are blocks; a side of a task has about SIDE parts at most
    cores = parts.sparkSession.sparkContext.defaultParallelism
    k = min(many, max(-(-many // SIDE), math.ceil(math.sqrt(8 * cores))))
    met = pair(side(large, "i", "left").repartition(k), side(large, "j", "right").repartition(k).hint("shuffle_replicate_nl"))
    return done.unionByName(met.mapInArrow(blocks, schema))


def block_distances(metric: Metric, left: Part, right: Part, same: bool) -> np.ndarray:
    """Distances of a block; infinite for a row itself, for pairs of another block, and undefined ones.

    Within one part only the half above the diagonal counts.
    """
    fit = lambda x, y: np.pad(x, ((0, 0), (0, max(0, y.shape[1] - x.shape[1])))) if x.shape[1] < y.shape[1] else x
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        d = metric.between(fit(left.a, right.a), fit(left.b, right.b), fit(right.a, left.a), fit(right.b, left.b))
    for side, at in ((left, lambda x: (x, slice(None))), (right, lambda x: (slice(None), x))):
        odd = ~np.isfinite(side.a).all(1)
        if odd.any():
            d[at(odd)] = np.inf
    if left.guest.any() and right.guest.any():
        d[(left.guest[:, None] & right.guest[None, :]) != 0] = np.inf
    if np.isfinite(left.lim).any():
        d[d > left.lim[:, None]] = np.inf
    if same:
        d[np.tril_indices(len(d))] = np.inf
    return d


def pairs_within(placed: DataFrame, metric: Metric, eps: float) -> DataFrame:
    """(a, b, d) with a < b of all pairs at a distance of at most ``eps``."""
    kind = placed.schema["id"].dataType.simpleString()

    def see(left: Part, right: Part, same: bool) -> pd.DataFrame:
        d = block_distances(metric, left, right, same)
        r, c = np.nonzero(d <= eps)
        x, y = left.id[r], right.id[c]
        swap, other = x > y, x != y
        return pd.DataFrame({"a": np.where(swap, y, x)[other], "b": np.where(swap, x, y)[other], "d": d[r, c][other]})

    return in_blocks(placed, see, f"a {kind}, b {kind}, d double")


def neighbour_weights(placed: DataFrame, metric: Metric, eps: float) -> DataFrame:
    """(id, others): the weights of the other rows within ``eps``, summed; rows without any are left out."""
    kind = placed.schema["id"].dataType.simpleString()

    def see(left: Part, right: Part, same: bool) -> pd.DataFrame:
        r, c = np.nonzero(block_distances(metric, left, right, same) <= eps)
        of, to = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        np.add.at(of, r, right.w[c])
        np.add.at(to, c, left.w[r])
        return pd.DataFrame({"id": np.concatenate([left.id[of > 0], right.id[to > 0]]), "others": np.concatenate([of[of > 0], to[to > 0]])})

    summed = lambda some: some.groupby("id", as_index=False)["others"].sum()
    return in_blocks(placed, see, f"id {kind}, others long", summed).groupBy("id").agg(F.sum("others").alias("others"))


def first_joining(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the edges, in order, that join what those before them don't; the lightest spanning forest if they are sorted.

    In a round each component takes its first edge that leaves it.
    """
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, at = both[: len(a)], both[len(a) :], np.arange(len(a))
    root, taken = np.arange(len(nodes)), []
    while True:
        p, q = root[x], root[y]
        some = p != q
        if not some.any():
            return np.sort(np.concatenate(taken)) if taken else np.empty(0, int)
        x, y, at, p, q = x[some], y[some], at[some], p[some], q[some]
        first = np.full(len(nodes), -1)
        for end in (p, q):  # the last to be written stays
            before = first.copy()
            first[end[::-1]] = np.arange(len(end))[::-1]
            first = np.where((before >= 0) & ((first < 0) | (before < first)), before, first)
        have = np.flatnonzero(first >= 0)
        e = first[have]
        up = np.arange(len(nodes))
        up[have] = np.where(p[e] == have, q[e], p[e])
        # two components that take the same edge
        ends = (up[up] == np.arange(len(nodes))) & (np.arange(len(nodes)) < up)
        up[ends] = np.flatnonzero(ends)
        taken.append(at[np.unique(e)])
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def lightest_edges(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    """(a, b, d): the minimum spanning forest of edges, ties by ids."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low, d))
    kept = order[first_joining(low[order], high[order])]
    return pd.DataFrame({"a": low[kept], "b": high[kept], "d": d[kept]})


def forest(d: np.ndarray, ids: np.ndarray, ids2: np.ndarray, limit: float = np.inf) -> pd.DataFrame:
    """Lightest edges (a, b, d) that join what the finite distances up to ``limit`` join; ties by ids, which are in order on both sides.

    What is as near as the row or column whose nearest is the farthest is sorted, and mostly joins all; then each row and
    column gives its nearest in another component.
    """
    open_ = np.where(d <= limit, d, np.inf)
    rows, columns = open_.min(1, initial=np.inf), open_.min(0, initial=np.inf)
    near = np.concatenate([rows[np.isfinite(rows)], columns[np.isfinite(columns)]])
    if not len(near):
        return pd.DataFrame({"a": ids[:0], "b": ids[:0], "d": np.empty(0)})
    r, c = np.nonzero(open_ <= near.max())
    made = lightest_edges(ids[r], ids2[c], open_[r, c])
    names = np.unique(np.concatenate([ids, ids2]))
    mine, other = np.searchsorted(names, ids), np.searchsorted(names, ids2)
    while True:
        root = _roots(len(names), np.searchsorted(names, made["a"].to_numpy()), np.searchsorted(names, made["b"].to_numpy()))
        open_[root[mine][:, None] == root[other][None, :]] = np.inf
        c, r = open_.argmin(1), open_.argmin(0)
        one, two = np.flatnonzero(np.isfinite(open_[np.arange(len(ids)), c])), np.flatnonzero(np.isfinite(open_[r, np.arange(len(ids2))]))
        if not len(one):
            return made
        i, j = np.concatenate([one, r[two]]), np.concatenate([c[one], two])
        # a component's lightest edges are in the forest; all of these together have no lighter way but through each other
        more = _leaving(names, root, ids[i], ids2[j], open_[i, j])
        made = pd.concat([made, more], ignore_index=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least that the edges of a forest join it with."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while (low[low] != low).any():
            low = low[low]
        if (low[root] == root).all():
            return root
        root = low[root]


def _leaving(names: np.ndarray, root: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    """Of edges between components the lightest of each component, ties by ids."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low, d))
    low, high, d = low[order], high[order], d[order]
    ends = np.concatenate([root[np.searchsorted(names, low)], root[np.searchsorted(names, high)]])
    place = np.concatenate([np.arange(len(d))] * 2)
    by = np.lexsort((place, ends))
    first = by[np.concatenate([[True], ends[by][1:] != ends[by][:-1]])]
    kept = np.unique(place[first])
    return pd.DataFrame({"a": low[kept], "b": high[kept], "d": d[kept]})


def core_links(placed: DataFrame, cores: DataFrame, metric: Metric, eps: float) -> DataFrame:
    """(a, b, core): links that join cores as all pairs of cores within ``eps`` do, and all pairs of another row ``a`` and a core ``b``.

    A task gives the forest of its cores, so a dense cluster gives as many links as it has rows.
    """
    kind = placed.schema["id"].dataType.simpleString()
    flagged = placed.join(cores.select("id", F.lit(True).alias("core")), "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))

    def joined(some: pd.DataFrame) -> pd.DataFrame:
        inner = some[some["core"].to_numpy(bool)]
        a, b = inner["a"].to_numpy(), inner["b"].to_numpy()
        kept = first_joining(a, b)
        return pd.concat([pd.DataFrame({"a": a[kept], "b": b[kept], "core": True}), some[~some["core"].to_numpy(bool)]])

    def see(left: Part, right: Part, same: bool) -> pd.DataFrame:
        r, c = np.nonzero(block_distances(metric, left, right, same) <= eps)
        core, core2, x, y = left.core.astype(bool)[r], right.core.astype(bool)[c], left.id[r], right.id[c]
        both, of, to = core & core2, ~core & core2, core & ~core2
        out = pd.DataFrame({
            "a": np.concatenate([x[both], x[of], y[to]]), "b": np.concatenate([y[both], y[of], x[to]]),
            "core": np.repeat([True, False], [both.sum(), of.sum() + to.sum()]),
        })
        return joined(out) if both.sum() > len(left) + len(right) else out

    return in_blocks(flagged, see, f"a {kind}, b {kind}, core boolean", joined)
