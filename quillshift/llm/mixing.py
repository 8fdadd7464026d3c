"""Mixing sources to target weights by fitting each source's word budget as a subset sum.

Documents are counted by exact length; whole passes and a proportional share of every length
come first, bounded-knapsack dynamic programming settles what remains of the budget, and
seeded documents are then picked by their length's count.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillshift.llm.common import checkpointed, table

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def fit_targets(sizes: Sequence[float], weights: Sequence[float], repeats: float = 3.0) -> list[float]:
    """Share the sum of sizes by weight; what exceeds ``repeats`` times a size is reshared."""
    targets, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > repeats * sizes[i]]
        for i in over or open_:
            targets[i] = repeats * sizes[i] if over else left * weights[i] / total
        if not over:
            break
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return targets


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: float, capacity: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that their sum comes nearest to ``budget``.

    Budgets over ``capacity`` first take a proportional share of every length, then the
    longest that still fit; what is left is a bounded knapsack over the lengths up to it.  An overshoot is chosen where it is nearer.  Memory is O(capacity).
    Documents without words fit any budget in any number: none is taken.
    """
    lengths, counts = np.asarray(lengths).astype(np.int64), np.asarray(counts).astype(np.int64)
    take = np.zeros(len(lengths), dtype=np.int64)
    worded = lengths > 0
    if not worded.all():
        take[worded] = fit_budget(lengths[worded], counts[worded], budget, capacity)
        return take
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    if budget > capacity:
        take = np.floor(counts * (budget / total)).astype(np.int64)
    left = int(budget) - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= capacity:
            break
        n = min(int(counts[i] - take[i]), (left - capacity // 2) // int(lengths[i]))
        if n > 0:
            take[i] += n
            left -= n * int(lengths[i])
    free = counts - take
    usable = np.flatnonzero(free > 0)
    if left < 0 or not len(usable):
        return take
    if left > 2 * capacity:
        # only documents longer than what is left: none, or the shortest of them
        return take if 2 * left < int(lengths[usable].min()) else _one_more(take, usable, lengths)
    # sums up to the budget and, past it, by no more than taking nothing falls short
    top = left + min(left + 2, int(lengths[usable].max()))
    step = 0
    for i in usable:
        step = gcd(step, int(lengths[i]))
    goal, slots = (left + budget - int(budget)) / step, top // step + 1
    first = np.full(slots + 1, -1, dtype=np.int64)
    reach = np.zeros(slots + 1, dtype=bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    hit = round(goal)  # nothing is nearer
    for i in sorted(usable, key=lambda i: -int(lengths[i])):
        n, size = int(free[i]), int(lengths[i]) // step
        n, power = min(n, slots // size), 1
        while n > 0:
            k = min(power, n)
            n, power = n - k, power * 2
            w = k * size
            if w > slots:
                break
            new = np.zeros_like(reach)
            new[w:] = reach[:-w] & ~reach[w:]
            first[new] = len(items)
            reach |= new
            items.append((i, k))
        if reach[hit]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    while at:
        i, k = items[first[at]]
        take[i] += k
        at -= k * int(lengths[i]) // step
    return take


def _one_more(take: np.ndarray, usable: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    take[usable[np.argmin(lengths[usable])]] += 1
    return take


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    repeats: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_salt: int = 20_000,
    broadcast_sources: int = 100_000,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of ``docs``.

    Sources, by code point and null last, take the weights in turn.  A document is taken
    whole, 0 to ``repeats`` times; ``taken`` is its words times that.  A null text has no
    words and is taken with none.  Which documents of a length are taken is decided by a
    seeded hash of the id, so reruns agree; rows that repeat an id and a length are alike and
    any of them may be taken.  An empty table gives an empty table; other columns are ignored.

    A row for each source reaches the driver, where targets are shared out; it is broadcast up
    to ``broadcast_sources`` of them and shuffled beyond.  Only (id, source, length) is shuffled.  Length counts of one source are fitted in one
    task; their number is that of distinct lengths, not of documents.  Ranks are taken within
    (source, length, salt), and only in the salt where the count runs out.
    """
    sized = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ))
    salts = max(1, -(-sized.count() // rows_per_salt))
    sized = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(salts)).cast("int"))
    counts = checkpointed(sized.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")))

    # one row per source reaches the driver, in the order of their UTF-8 bytes, that is of code points
    per_source = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words")).collect()
    ranked = sorted(per_source, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["words"] or 0) for r in ranked]
    targets = fit_targets(sizes, [weights[i % len(weights)] for i in range(len(ranked))], float(repeats))
    plan = docs.sparkSession.createDataFrame(
        [(r["source"], s, t) for r, s, t in zip(ranked, sizes, targets, strict=True)], "p_source string, source_size long, target double"
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(repeats, int(target // size)) if size else 0
        extra = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), target - whole * size) if size and whole < repeats else np.zeros(len(pdf), dtype=np.int64)
        return pd.DataFrame({"f_source": pdf["source"], "f_size": pdf["size"], "passes": whole, "extra": extra})

    by_length = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    hist = by_length.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    fitted = hist.groupBy("source").applyInPandas(fit, "f_source string, f_size long, passes int, extra long")

    # per salt: all, none, or some of the documents of a length get an extra pass
    w = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .join(fitted, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("size") == F.col("f_size")))
        .join(F.broadcast(plan) if len(ranked) <= broadcast_sources else plan, F.col("source").eqNullSafe(F.col("p_source")))
        .select(F.col("source").alias("s_source"), F.col("size").alias("s_size"), F.col("salt").alias("s_salt"), "n", "passes", "source_size", "target",
                F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("some"))
    )
    each = sized.join(shares, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("salt") == F.col("s_salt")))
    some = (F.col("some") > 0) & (F.col("some") < F.col("n"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))
    picked = each.filter(some).withColumn("one", (rank <= F.col("some")).cast("long")).unionByName(
        each.filter(~some).withColumn("one", (F.col("some") > 0).cast("long"))
    )
    return picked.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("one"))).alias("taken"))


def expand_mix(docs: DataFrame, mix: DataFrame, broadcast_rows: int = 500_000, text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns), each row as many times as ``mix`` takes it.

    A row is known by its id and size; documents without words are taken once.  Rows that
    repeat an id and a size share the sum of their times, which differ by one at most.  Up to
    ``broadcast_rows`` documents the repeats are broadcast (28 bytes each) and no text is
    shuffled; beyond, both sides are.  Null and empty texts and null ids are rows like others; an
    empty table gives an empty table; other columns are kept.
    """
    times = mix.groupBy(F.col("doc_id").alias("_qs_id"), F.col("size").alias("_qs_size")).agg(
        F.when(F.col("_qs_size") > 0, F.sum("taken") / F.col("_qs_size")).otherwise(F.count(F.lit(1))).cast("long").alias("_qs_times"),
        F.count(F.lit(1)).alias("_qs_rows"),
    )
    times = checkpointed(times.filter("_qs_times > 0"))
    total, uneven = times.agg(F.count(F.lit(1)), F.count_if(F.col("_qs_times") % F.col("_qs_rows") != 0)).first()
    hint = F.broadcast if total <= broadcast_rows else (lambda d: d)
    sized = docs.withColumn("_qs_words", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
    out = sized.join(hint(times), sized["doc_id"].eqNullSafe(times["_qs_id"]) & (F.col("_qs_words") == F.col("_qs_size")))
    each = F.floor(F.col("_qs_times") / F.col("_qs_rows")).cast("int")
    if uneven:
        rest = F.col("_qs_times") % F.col("_qs_rows")
        nth = F.row_number().over(Window.partitionBy("_qs_id", "_qs_size").orderBy(F.xxhash64(text_col)))
        out = out.filter(rest == 0).withColumn("_qs_n", each).unionByName(out.filter(rest != 0).withColumn("_qs_n", each + (nth <= rest).cast("int")))
        out = out.filter("_qs_n > 0")
    else:
        out = out.withColumn("_qs_n", each)
    return out.withColumn("_qs_nth", F.explode(F.sequence(F.lit(1), F.col("_qs_n")))).select(*[docs[c] for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents`` by the weights 5, 2, 1, at most three times each."""
    return mix_sources(table(spark, sf_dir, "documents"))
