"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by documents: a block of some 8 MB of text holds, for each of its terms, the
positions of the term in the block.  A benchmark window is looked up from its rarest terms on:
their lists, each less the term's place in the window, are intersected block by block, and only
windows that survive two lists ask for the others.  No list is copied for a window, and no task
holds more than a block and a bounded share of the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from quillshift.llm.common import checkpointed, scratch, slices, small, table

#: Words are runs of these after A-Z become a-z; all other bytes part them.
_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_SPLIT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Positions left free between two documents of a block, so that no match crosses; bounds ``slop``.
GAP = 64
#: From a term's positions to the next term's, more than any block has.
APART = 1 << 40
#: Windows that one task looks up in a block.
SHARD = 8192

INDEX = "block long, term string, n int, positions binary, doc_ids array<long>, n_words array<int>"
_ARROW = pa.schema([("block", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32()))])


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(WORD_PATTERN), F.lit(0))


def postings(block: int, doc_ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    """The lists of one block, terms in order; the empty term lists the documents' starts."""
    cleaned = pa.array([(t or b"").translate(_SPLIT).strip() for t in texts], pa.string())
    parted = pc.ascii_split_whitespace(cleaned)
    # a text without words gives one empty string
    sizes = np.where(pc.equal(cleaned, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(parted).to_numpy())
    flat = parted.flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    by_rank = pc.sort_indices(coded.dictionary)
    terms = coded.dictionary.take(by_rank)
    rank = np.empty(len(terms), np.int64)
    rank[by_rank.to_numpy()] = np.arange(len(terms))
    owner = rank[coded.indices.to_numpy()]
    starts = np.cumsum(sizes + GAP) - (sizes + GAP)
    places = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    order = np.argsort(owner, kind="stable")
    counts = np.concatenate([[len(texts)], np.bincount(owner, minlength=len(terms))]).astype(np.int64)
    ends = np.cumsum(counts)
    listed = np.concatenate([starts, places[order]])
    steps = np.diff(listed, prepend=0)
    firsts = (ends - counts)[counts > 0]
    steps[firsts] = listed[firsts]
    offsets = np.concatenate([[0], ends * 4]).astype("<i4")
    lists = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(steps.astype("<u4").tobytes())])
    rest = pa.nulls(len(terms))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(counts), block)), pa.concat_arrays([pa.array([""]), terms]), pa.array(counts.astype(np.int32)), lists,
        pa.concat_arrays([pa.ListArray.from_arrays([0, len(texts)], doc_ids), rest.cast(pa.list_(pa.int64()))]),
        pa.concat_arrays([pa.ListArray.from_arrays([0, len(texts)], pa.array(sizes, pa.int32())), rest.cast(pa.list_(pa.int32()))]),
    ], schema=_ARROW)


def places_of(lists: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(lists, "<u4"), dtype=np.int64)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Write the positional index of all words of ``docs`` to ``path``, a folder that all executors share.

    Rows are (block, term, n, positions as steps); a block's row of the empty term has the starts,
    ids and word counts of its documents.  A text is never cut: a longer one is a block of its
    own.  Null and empty texts are documents without words; repeated rows, ids and null ids are
    documents of their own; an empty table gives an empty index; other columns are ignored.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, block_bytes):
                yield postings(block, part.column(0), part.column(1).to_pylist())
                block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows.mapInArrow(index, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def item_windows(index: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(wid, shard, item, length, terms): each window's terms with their places, rarest in the index first.

    Windows with a word that no document has can't match and are left out.
    """
    texts = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0).distinct()
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))).alias("at")
    cut = checkpointed(texts.select("item", first, "w").select("item", F.slice("w", F.col("at") + 1, window).alias("w")).distinct().withColumn("wid", F.monotonically_increasing_id()))
    each = cut.select("wid", "item", F.size("w").alias("length"), F.posexplode("w").alias("place", "term"))
    asked = each.select("term").distinct()
    seen = index.join(small(asked), "term").groupBy("term").agg(F.sum("n").alias("n"))
    ranked = each.join(seen, "term").groupBy("wid", "item", "length").agg(F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("t"))
    whole = ranked.filter(F.size("t") == F.col("length"))
    terms = F.transform("t", lambda x: F.struct(x["term"].alias("term"), x["place"].cast("int").alias("place")))
    held = checkpointed(whole.select("wid", "item", "length", terms.alias("terms")))
    shards = max(1, -(-held.count() // SHARD))
    return held.withColumn("shard", F.pmod(F.xxhash64("wid"), F.lit(shards)).cast("int"))


def _meet(bases: np.ndarray, listed: np.ndarray, place: int, slop: int) -> np.ndarray:
    """Which of ``bases`` have an element of the ascending ``listed`` from ``place`` to ``place`` + ``slop`` above them."""
    if not len(listed):
        return np.zeros(len(bases), bool)
    asked = bases + place
    at = np.searchsorted(listed, asked)
    return (at < len(listed)) & (listed[np.minimum(at, len(listed) - 1)] <= asked + slop)


def _tables(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {t: places_of(p) for t, p in zip(pdf["term"], pdf["positions"], strict=True)}


def windows_in_block(asks: pd.DataFrame, have: pd.DataFrame, slop: int) -> pd.DataFrame:
    """(block, row, item, length, exact, near) of a block's lists ``have`` for the windows ``asks`` (block, item, length, bases, names, places).

    The lists follow each other in one array, ``APART`` from term to term, so that the bases of all windows meet their next term in one search.
    """
    code = {t: i for i, t in enumerate(have["term"])}
    lists = [places_of(p) for p in have["positions"]]
    listed = np.concatenate([p + i * APART for i, p in enumerate(lists)])
    starts = lists[code[""]]
    # -1: a term that the block doesn't have; -2: the window has no such term
    widest = max(map(len, asks["names"]))
    terms, offsets = np.full((len(asks), widest), -2), np.zeros((len(asks), widest), np.int64)
    for i, (names, places) in enumerate(zip(asks["names"], asks["places"], strict=True)):
        terms[i, : len(names)] = [code.get(t, -1) for t in names]
        offsets[i, : len(places)] = places
    bases, window = np.concatenate(list(asks["bases"])).astype(np.int64), np.repeat(np.arange(len(asks)), [len(b) for b in asks["bases"]])
    exact, tight = np.ones(len(bases), bool), np.zeros(len(bases), bool)
    for j in range(widest):
        term = terms[window, j]
        asked = term * APART + bases + offsets[window, j]
        over = listed[np.minimum(np.searchsorted(listed, asked), len(listed) - 1)] - asked
        met, free = (term >= 0) & (over >= 0) & (over <= slop), term == -2
        exact &= free | (over == 0)
        tight |= met & (over == 0)
        keep = met | free
        bases, window, exact, tight = bases[keep], window[keep], exact[keep], tight[keep]
    bases, window, exact = bases[tight], window[tight], exact[tight]
    row = np.searchsorted(starts, bases + slop, side="right") - 1
    at = bases - starts[row]
    kinds, items = pd.factorize(asks["item"])
    kind, length = kinds[window], asks["length"].to_numpy()[window]
    order = np.lexsort((at, length, kind, row))
    row, kind, length, at, exact = row[order], kind[order], length[order], at[order], exact[order]
    new = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(kind, prepend=-1) | np.diff(length, prepend=-1))
    block, out = asks["block"].iloc[0], []
    for i, k in zip(new, [*new[1:], len(row)] if len(new) else [], strict=True):
        out.append((block, row[i], items[kind[i]], length[i], np.unique(at[i:k][exact[i:k]]), np.unique(at[i:k])))
    return pd.DataFrame(out, columns=["block", "row", "item", "length", "exact", "near"])


def _by_block(asks: DataFrame, lists: DataFrame) -> PandasCogroupedOps:
    """Both by block and shard, the lists' keys renamed, as they may come from the same rows."""
    other = lists.select(F.col("block").alias("_b"), F.col("shard").alias("_s"), "term", "positions")
    return asks.groupBy("block", "shard").cogroup(other.groupBy("_b", "_s"))


def find_matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, slop: int = 0) -> DataFrame:
    """(block, row, item, length, exact, near): where windows of the items occur in documents.

    A window is ``window`` consecutive words of an item, or all words of a shorter one.  ``exact``
    has the positions in the document at which one begins.  ``near`` has the positions p such
    that each word of a window, k words from its begin, stands from p + k to p + k + ``slop``, one of them
    at p + k itself: all exact matches, and those with words between or exchanged.  Two equal words of a
    window may be the same word of the document there.  Both are ascending; rows without either are left out.
    Items are told apart by ``id_col`` as a string, null being ''; rows of one id count together; null
    and empty texts match nothing; empty tables give an empty table.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    asked = item_windows(index, items, id_col, text_col, window)
    two = asked.select("wid", "shard", "item", "length", F.col("terms")[0].alias("a"), F.try_element_at("terms", F.lit(2)).alias("b"))
    seeds = checkpointed(two.select(F.explode(F.array("a.term", "b.term")).alias("term")).filter("term is not null").distinct())
    lists = checkpointed(index.select("block", "term", "positions").join(small(seeds), "term"))
    # a block is asked for the windows whose rarest term it has
    begun = lists.select("block", F.col("term").alias("t")).join(two, F.col("t") == F.col("a.term"))
    begun = begun.select("block", "shard", "wid", F.col("a.term").alias("t1"), F.col("a.place").alias("o1"), F.col("b.term").alias("t2"), F.col("b.place").alias("o2"))
    needed = begun.select("block", "shard", F.explode(F.array("t1", "t2")).alias("term")).distinct().join(lists, ["block", "term"])

    def start(asks: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        known, out = _tables(have), []
        for wid, t1, o1, t2, o2 in zip(asks["wid"], asks["t1"], asks["o1"], asks["t2"], asks["o2"], strict=True):
            bases = known[t1] - o1
            if slop:
                bases = np.unique(bases[:, None] - np.arange(slop + 1))
            if t2 is not None:
                bases = bases[_meet(bases, known[t2], int(o2), slop)] if t2 in known else bases[:0]
            if len(bases):
                out.append((wid, bases))
        pdf = pd.DataFrame(out, columns=["wid", "bases"])
        return pdf.assign(block=asks["block"].iloc[0] if len(asks) else 0, shard=asks["shard"].iloc[0] if len(asks) else 0)

    alive = checkpointed(_by_block(begun, needed).applyInPandas(start, "wid long, bases array<long>, block long, shard int"))
    rest = alive.join(small(asked.select("wid", "item", "length", F.col("terms.term").alias("names"), F.col("terms.place").alias("places"))), "wid")
    terms = checkpointed(rest.select("block", "shard", F.explode(F.concat(F.array(F.lit("")), "names")).alias("term")).distinct())
    have = index.select("block", "term", "positions").join(small(terms), ["block", "term"])

    made = _by_block(rest, have).applyInPandas(lambda asks, have: windows_in_block(asks, have, slop), "block long, row int, item string, length int, exact array<int>, near array<int>")
    # shards may know the same item by other windows
    merged = made.groupBy("block", "row", "item", "length")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return merged.agg(union("exact"), union("near"))


def indexed_documents(index: DataFrame) -> DataFrame:
    """(block, row, doc_id, n_words) of every document of the index."""
    return index.filter("term = ''").select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("row", "d")).select("block", "row", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))


def covered(spans: Column) -> Column:
    """How many positions the (start, length) spans cover together."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))

    def add(acc: Column, s: Column) -> Column:
        end = (s["start"] + s["length"]).cast("long")
        gained = F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], s["start"].cast("long")))
        return F.struct((acc["n"] + gained).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), begin, add)["n"]


def contamination(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near_items), a row for each document of the index.

    ``n_hit`` counts the words inside any exact occurrence of a window; ``items`` and ``near_items`` are the
    sorted ids of items with exact and with near occurrences.
    """
    found = find_matches(index, items, id_col, text_col, window, slop)
    spans = F.transform("exact", lambda p: F.struct(p.alias("start"), F.col("length").alias("length")))
    # a document's matches are no more than its words times the items that share them
    hits = found.groupBy("block", "row").agg(
        covered(F.flatten(F.collect_list(spans))).alias("n_hit"),
        F.array_sort(F.collect_set(F.when(F.size("exact") > 0, F.col("item")))).alias("items"), F.array_sort(F.collect_set("item")).alias("near_items"),
    )
    none = F.array().cast("array<string>")
    return indexed_documents(index).join(hits, ["block", "row"], "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold in windows of 10 words; near: up to 2 words more or exchanged."""
    index = build_index(table(spark, sf_dir, "documents"), scratch(spark, "postings"))
    found = contamination(index, table(spark, sf_dir, "benchmark"), slop=2)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )


#: Words at one distance from their places in an item (``q``, or up to two above it for near ones), in runs as long as a window.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
t AS (SELECT row_number() OVER () AS tid, item, w, least(len(w), 10) AS size FROM i WHERE len(w) > 0),
dw AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
tw AS (SELECT tid, item, size, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM t),
met AS (SELECT rid, tid, item, size, j, pos, pos - j AS q FROM dw JOIN tw USING (word)),
near AS (SELECT DISTINCT rid, tid, item, size, j, q - s AS q FROM met, (SELECT unnest([0, 1, 2]) AS s)),
near_runs AS (SELECT rid, item FROM (SELECT *, j - row_number() OVER (PARTITION BY rid, tid, q ORDER BY j) AS run FROM near) GROUP BY rid, tid, item, size, q, run HAVING count(*) >= size),
runs AS (SELECT *, count(*) OVER (PARTITION BY rid, tid, q, run) AS n FROM (SELECT *, j - row_number() OVER (PARTITION BY rid, tid, q ORDER BY j) AS run FROM met)),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM runs WHERE n >= size GROUP BY rid),
of AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT rid, item FROM runs WHERE n >= size) GROUP BY rid),
about AS (SELECT rid, count(DISTINCT item) AS n_near_items FROM near_runs GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hit USING (rid) LEFT JOIN of USING (rid) LEFT JOIN about USING (rid)
"""
