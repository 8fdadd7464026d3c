"""Word n-gram Jaccard self-join by chosen paths.

Sets are embedded as min-hash coordinates, so that to agree on a coordinate is to share the
token it samples.  Each run splits the sets, level by level, on coordinates sampled for the
node (1/threshold of them on average), until a bucket is small; small buckets are searched by
brute force on the sketches, runs repeat until the target recall.  A bucket that stays large to
the last level is a candidate as a whole: its members hang on the least of them, one row each.
What a sketch lets pass is joined to candidate components, and each component is verified exactly
on the sets themselves: in one task, or, beyond a bound of rows and bytes, part by part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshift.llm.common import by_bytes, checkpointed, connected_components, release, table

COORDINATES = 64
_ODD = np.random.default_rng(20_240_501).integers(1 << 62, size=(2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; cleared at 150,000 words (some 30 MB)."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        self[word] = h
        return h


_WORDS = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that all bits depend on all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words (lower case, cut at white space).

    A text of fewer words is one shingle; a text without words has none.
    """
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * _MUL + h[i : i + len(out)]
    return np.unique(mixed(out + np.uint64(k)))


def sketch(s: np.ndarray) -> np.ndarray:
    """Min-hash coordinates of a set; the empty set has zeros."""
    low = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint32)
    if not len(s):
        return np.zeros(COORDINATES, dtype=np.uint32)
    for i in range(0, len(s), 2048):
        part = (s[i : i + 2048, None] * _ODD[0] + _ODD[1]) >> np.uint64(32)
        low = np.minimum(low, part.min(axis=0).astype(np.uint32))
    return low


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _grouped(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], dict | None], columns: list[str], schema: str) -> DataFrame:
    """Run ``fn`` on each group of rows with equal keys; groups are small by construction."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def done(pdf: pd.DataFrame, cuts: list[int]) -> Iterator[pd.DataFrame]:
            found = [x for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if (x := fn(pdf.iloc[lo:hi])) is not None]
            if found:
                yield pd.DataFrame({c: [v for x in found for v in x[c]] for c in columns})

        for pdf in batches:
            if rest is not None and len(rest):
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(new).tolist()]
            if len(starts) > 1:
                yield from done(pdf, starts)
            rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from done(rest, [0, len(rest)])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def stars(linked: np.ndarray, names: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The components of a symmetric relation, each as edges from its members to the least name.

    Tasks that see the same group then mostly emit the same edges, which combine.
    """
    seen = np.zeros(len(linked), dtype=bool)
    ends: list[bytes] = []
    heads: list[bytes] = []
    for root in np.flatnonzero(linked.any(axis=1)):
        if seen[root]:
            continue
        inside = np.zeros(len(linked), dtype=bool)
        front = np.array([root])
        while len(front):
            inside[front] = True
            front = np.flatnonzero(linked[front].any(axis=0) & ~inside)
        seen |= inside
        group = sorted(names[inside])
        ends += group[1:]
        heads += [group[0]] * (len(group) - 1)
    return ends, heads


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(len(column), COORDINATES)


def _agree(a: np.ndarray) -> np.ndarray:
    same = np.zeros((len(a), len(a)), dtype=np.uint8)
    for c in range(COORDINATES):
        col = a[:, c]
        same += col[:, None] == col[None, :]
    return same


def intersections(sets: list[np.ndarray], rare: int = 16, cells: int = 1 << 21) -> np.ndarray:
    """Sizes of all pairwise intersections of different sets.

    Tokens of few sets are counted pair by pair along their postings; the others are columns of
    matrix products, by slabs of about ``cells`` cells.
    """
    n = len(sets)
    inter = np.zeros((n, n), dtype=np.float32)
    token = np.concatenate(sets)
    if not len(token):
        return inter
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    col = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
    held = np.bincount(col)[col]
    few = (held > 1) & (held <= rare)
    c, o = col[few], owner[few]
    for step in range(1, rare):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        # owners ascend within a token, so each pair is counted once, above the diagonal
        np.add.at(inter, (o[same], o[same + step]), np.float32(1))
    inter += inter.T
    c, o = col[held > rare], owner[held > rare]
    if len(c):
        c = np.cumsum(np.concatenate([[0], c[1:] != c[:-1]]))
        slab = max(128, cells // n)
        for lo in range(0, int(c[-1]) + 1, slab):
            i, j = np.searchsorted(c, [lo, lo + slab])
            m = np.zeros((n, slab), dtype=np.float32)
            m[o[i:j], c[i:j] - lo] = 1
            inter += m @ m.T
    return inter


def linked_pairs(sets: list[np.ndarray], threshold: float, rows: int = 256) -> np.ndarray:
    """Which pairs of different sets have a Jaccard similarity of ``threshold`` or more."""
    inter, size = intersections(sets), np.array([len(s) for s in sets], dtype=np.float64)
    out = np.empty(inter.shape, dtype=bool)
    for lo in range(0, len(sets), rows):
        part = inter[lo : lo + rows].astype(np.float64)
        out[lo : lo + rows] = part >= threshold * (size[lo : lo + rows, None] + size[None, :] - part) - 1e-9
    np.fill_diagonal(out, False)
    return out


def survival(threshold: float, depth: int) -> float:
    """The chance that a pair at the threshold still shares a node after ``depth`` levels of one run.

    Each level takes one coordinate and, with the rest of 1/threshold as its chance, a second;
    a pair agrees on a coordinate with the probability ``threshold``.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - (1 - threshold * alive) * (1 - (1 / threshold - 1) * threshold * alive)
    return alive


def jaccard_classes(
    docs: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    target_recall: float = 0.9995,
    bucket: int = 128,
    block: int = 1024,
    block_bytes: int = 4 << 20,
    depth: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of n-word shingles is
    ``threshold`` or more.  ``n_links`` counts the other documents a document is linked to, equal
    sets included; ``class_id`` is the smallest id of its connected component.  Null texts and
    texts without words have equal, empty sets and are one class; texts of fewer than n words
    are one shingle.  Rows that repeat an id count as documents of their own.  Null ids are
    never a class id unless the class has no other.  An empty table gives an empty table.

    Texts of any length are read whole; other columns are ignored.

    Documents of equal sets are one node (never expanded to pairs).  A candidate component of up
    to ``block`` nodes and ``block_bytes`` of sets is verified in one task; larger ones are dealt into
    parts of that size and verified by pairs of parts, as an exact number of links needs.  A task
    emits one edge and one count for each node at most, never its pairs.
    """
    runs = math.ceil(math.log(1 - target_recall) / math.log(1 - survival(threshold, depth)))
    # five standard deviations of the estimate below the threshold
    loose = (threshold - 0.25) * COORDINATES

    def sets_of(batches: Iterator[pd.DataFrame], whole: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, n) for t in pdf["text"]]
            out = {"rid": [set_key(s) for s in sets], "content": [s.tobytes() if whole else sketch(s).tobytes() for s in sets]}
            yield pd.DataFrame(out if whole else {"doc_id": pdf["doc_id"].astype("Int64"), **out, "tokens": [len(s) for s in sets]})

    rows = by_bytes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    each = checkpointed(rows.mapInPandas(lambda b: sets_of(b, False), "doc_id long, rid binary, content binary, tokens long"))
    reps = checkpointed(
        each.groupBy("rid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("content").alias("sketch"), F.first("tokens").alias("tokens"))
    )

    # ---- chosen paths: (node, rid), split until buckets are small
    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Children of each row's node; rows without a node start every run."""
        for pdf in batches:
            if not len(pdf):
                continue
            sig = _sketches(pdf["sketch"]).astype(np.uint64)
            rid, node = pdf["rid"].to_numpy(), pdf["node"].to_numpy().astype(np.int64).view(np.uint64)
            for run in range(runs) if pdf["level"].iloc[0] == 0 else [0]:
                at = mixed(node + np.uint64((run + 1) * int(_MUL) & (1 << 64) - 1))
                first = (at % np.uint64(COORDINATES)).astype(np.int64)
                # one coordinate always, a second with the rest of 1/threshold as its chance
                also = mixed(at + np.uint64(7)) % np.uint64(1 << 20) < np.uint64((1 / threshold - 1) * (1 << 20))
                for nth, who in ((0, np.ones(len(sig), dtype=bool)), (1, also)):
                    c = (first + nth * 31) % COORDINATES
                    value = sig[np.arange(len(sig)), c]
                    child = mixed(at ^ mixed(value + (c.astype(np.uint64) + np.uint64(1)) * _MUL))
                    yield pd.DataFrame({"node": child[who].view(np.int64), "rid": rid[who]})

    level = reps.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), "rid", "sketch")
    buckets: list[DataFrame] = []
    for d in range(depth):
        split = level.mapInPandas(paths, "node long, rid binary")
        if d:
            split = checkpointed(split)
        sizes = checkpointed(
            split.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("rid").cast("decimal(20,0)")).alias("who")).filter("size > 1")
        )
        last = d == depth - 1
        # members met again, in another run, are searched once; large nodes split each in its own way
        small = sizes if last else sizes.filter(F.col("size") <= bucket)
        buckets.append(split.join(small.groupBy("size", "who").agg(F.min("node").alias("node")).select("node", "size"), "node"))
        if last or sizes.filter(F.col("size") > bucket).isEmpty():
            break
        large = split.join(sizes.filter(F.col("size") > bucket).select("node"), "node")
        level = large.join(reps.select("rid", "sketch"), "rid").select(F.lit(d + 1).alias("level"), "node", "rid", "sketch")
    members = buckets[0]
    for more in buckets[1:]:
        members = members.unionByName(more)

    def search(pdf: pd.DataFrame) -> dict | None:
        if len(pdf) < 2:
            return None
        near = _agree(_sketches(pdf["sketch"])) >= loose
        np.fill_diagonal(near, False)
        ends, heads = stars(near, pdf["rid"].to_numpy())
        return {"a": ends, "b": heads} if ends else None

    members = checkpointed(members)
    release(docs.sparkSession)
    held = members.filter(F.col("size") <= bucket).join(reps.select("rid", "sketch"), "rid")
    candidates = _grouped(held, ["node"], search, ["a", "b"], "a binary, b binary")
    dense = members.filter(F.col("size") > bucket)
    heads = dense.groupBy("node").agg(F.min("rid").alias("b"))
    candidates = candidates.unionByName(dense.join(heads, "node").filter("rid <> b").select(F.col("rid").alias("a"), "b"))
    loosely = checkpointed(connected_components(candidates.distinct()))

    # ---- exact verification of each candidate component, on the sets of its members
    named = checkpointed(loosely.join(reps.select(F.col("rid").alias("node"), "rep", "copies", "tokens"), "node"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("tokens") * 8 / block_bytes), F.lit(1))
    suspects = named.join(named.groupBy("comp").agg(parts.cast("int").alias("parts")), "comp")
    wanted = named.select(F.col("rep").alias("w_rep")).distinct()
    wanted = F.broadcast(wanted) if named.count() <= broadcast_rows else wanted
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_rep")), "left_semi")
    sets = texts.mapInPandas(lambda b: sets_of(b, True), "rid binary, content binary")
    # a repeated id may bring the same set twice, or sets that are not wanted
    wholes = suspects.join(sets.dropDuplicates(["rid"]), F.col("node") == F.col("rid")).select("comp", "parts", "rid", "copies", "content")
    # each part meets itself and every other (i <= j); most components have one part
    own = F.pmod(F.xxhash64("rid", F.lit(3)), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = wholes.withColumn("own", own).withColumn("pair", F.explode(meets)).select("comp", "pair.i", "pair.j", "own", "parts", "rid", "copies", "content")

    def verify(pdf: pd.DataFrame) -> dict | None:
        linked = linked_pairs([np.frombuffer(b, dtype=np.uint64) for b in pdf["content"]], threshold)
        i, j, own = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), pdf["own"].to_numpy()
        # pairs within one part belong to the block (i, i) alone
        across = linked if i == j else linked & (own[:, None] != own[None, :])
        copies = pdf["copies"].to_numpy().astype(np.int64)
        count = np.array([copies[r].sum() for r in across])
        rid, has = pdf["rid"].to_numpy(), np.flatnonzero(count)
        ends, heads = stars(linked, rid)
        if not len(has) and not ends:
            return None
        return {
            "a": [*rid[has], *ends],
            "b": [*[None] * len(has), *heads],
            "links": [*count[has].tolist(), *[0] * len(ends)],
            "whole": [bool(pdf["parts"].iloc[0] == 1)] * (len(has) + len(ends)),
        }

    found = checkpointed(_grouped(dealt, ["comp", "i", "j"], verify, ["a", "b", "links", "whole"], "a binary, b binary, links long, whole boolean"))
    release(docs.sparkSession)
    # a component verified in one task needs no more: its members hang on their class's least
    hung = found.filter("b is not null")
    classes = hung.filter("whole").select(F.col("a").alias("node"), F.col("b").alias("comp"))
    several = hung.filter("not whole").select("a", "b").distinct()
    if not several.isEmpty():
        classes = classes.unionByName(connected_components(several))
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    owned = (
        reps.select("rid", "rep", "copies")
        .join(classes.withColumnRenamed("node", "rid"), "rid", "left").join(links.withColumnRenamed("a", "rid"), "rid", "left")
        .select("rid", "rep", F.coalesce("comp", "rid").alias("comp"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    owned = checkpointed(owned)
    least = owned.groupBy("comp").agg(F.min("rep").alias("class_id"))
    named = owned.join(least, "comp").select("rid", "class_id", "n_links")
    return each.select("doc_id", "rid").join(named, "rid").select("doc_id", "class_id", "n_links")


def keep_one_of_each_class(docs: DataFrame, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """``docs`` (all its columns) without the documents that are not the first of their class.

    Rows that repeat an id and a text are one document.  Rows without an id stay.  Null and empty
    texts are of one class, of which one stays; an empty table gives an empty table.
    """
    found = checkpointed(jaccard_classes(docs, broadcast_rows=broadcast_rows, **options))
    gone = found.filter("doc_id <> class_id").select(F.col("doc_id").alias("_qs_gone")).distinct()
    hint = F.broadcast if gone.count() <= broadcast_rows else (lambda d: d)
    kept = docs.join(hint(gone), docs["doc_id"] == gone["_qs_gone"], "left_anti")
    twice = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_qs_twice"))
    twice = checkpointed(twice)
    if twice.isEmpty():
        return kept
    again = kept.join(twice, kept["doc_id"] == twice["_qs_twice"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, kept["doc_id"] == twice["_qs_twice"], "left_anti").unionByName(again)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every row of ``documents``: five words, similarity of 0.8 or more."""
    return jaccard_classes(table(spark, sf_dir, "documents"))
