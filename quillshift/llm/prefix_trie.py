"""Prefix trie of conversations by a global range sort and a sweep over common prefixes.

Turn arrays are range-sorted over all partitions.  In each, the common prefix of neighbours
drives a stack: what is deeper than it is a finished node.  Prefixes of a partition's first and last array
stay open; these stacks, one row for each partition, are stitched in the order of the partitions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshift.llm.common import checkpointed, scratch, small, table
from quillshift.llm.mixing import WORD

#: Conversation ids that one row of a run's text holds.
RUN_IDS = 1 << 16
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
DONE, OPEN_PARENT, STACKS, RUN = range(4)
SWEPT = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part long, side int, at long, said string"
_COLUMNS = [c.split()[0] for c in SWEPT.split(", ")]
_NONE = hashlib.sha256(b"").hexdigest()


def crc_depth(conv_id: Column) -> Column:
    """How many turns of a conversation come from the one it branches off: the CRC-32 of its id, mod 4."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def turn_arrays(turns: DataFrame, branch: int = 20, most: int = 3) -> DataFrame:
    """(conv_id, path, words): each conversation rebuilt, turns as digests and word counts.

    The first h (``crc_depth``, at most ``most``) turns come from conversation c - c % ``branch``.  Turns are ordered by turn,
    null first, then role, then the digest of the text; null roles and texts are empty; rows without
    conv_id are left out.  A conversation is a row: 40 bytes a turn, whatever the texts.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    each = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("given"), "turn", role.alias("role"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    ).withColumn("base", F.col("conv_id") - F.col("conv_id") % branch)
    # dealt once by the conversation branched off, for the grouping and for the join
    own = each.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(F.struct("given", "turn", "role", "digest", "words"))).alias("t"))
    own = own.select("base", "conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("t"))
    heads = own.filter("base = conv_id").select("base", F.slice("t", 1, most).alias("head"))
    h = crc_depth(F.col("conv_id"))
    no_turns = F.array().cast("array<struct<digest:binary,words:bigint>>")
    rebuilt = F.concat(F.slice(F.coalesce("head", no_turns), F.lit(1), h), F.slice("t", h + 1, F.size("t")))
    return own.join(heads, "base", "left").select("conv_id", rebuilt.alias("t")).select("conv_id", F.col("t.digest").alias("path"), F.col("t.words").alias("words"))


def common_prefix(a: list, b: list) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


@dataclass
class Node:
    """An entry of the stack.  Members count all below; children, leaves and saved only what is finished."""

    words: int
    spine: bool
    conv_id: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ends: str | None = None
    held: list[list] = field(default_factory=list)

    def gain(self, conv_id: int, n: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n_convs += n

    def total(self) -> tuple[int, int]:
        return max(self.n_leaves, int(not self.n_children)), self.saved + (self.n_convs - 1) * self.words


class Sweep:
    """One partition's arrays in order; ``rows`` yields what is known so far."""

    def __init__(self, part: int) -> None:
        self.part = part
        self.first: list[bytes] | None = None
        self.path: list[bytes] = []
        self.stack: list[Node] = []
        self.run: list[int] = []
        self.runs = [0, 0]
        self.spine: list[list] = []
        self.out: list[dict] = []

    def _put(self, kind: int, values: list, **more: object) -> None:
        self.out.append({"kind": kind, **dict(zip(NODE, values, strict=False)), **more})

    def _flush(self, side: int) -> None:
        """Part of a run that may go on in another partition."""
        self._put(RUN, [], part=self.part, side=side, at=self.runs[side], said=",".join(map(str, self.run)))
        self.runs[side] += 1
        self.run = []

    def _end_run(self) -> None:
        """The ids of conversations that are the whole path end here."""
        if self.path == self.first:
            self._flush(0)
        elif self.run:
            self.stack[-1].ends = hashlib.sha256(",".join(map(str, self.run)).encode()).hexdigest()
        self.run = []

    def _pop(self) -> None:
        depth, node = len(self.stack) - 1, self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        if parent:
            parent.gain(node.conv_id, node.n_convs)
        if node.spine:
            self._keep(0, depth, node)
            return
        leaves, saved = node.total()
        row = [node.conv_id, depth, None, node.n_convs, node.n_children, leaves, saved]
        for child, ends in node.held:
            child[2] = node.conv_id
            self._put(DONE, child, ends_sha256=ends)
        if parent.spine:
            self._put(OPEN_PARENT, row, ends_sha256=node.ends or _NONE, part=self.part, side=0, at=depth - 1)
        else:
            parent.held.append([row, node.ends or _NONE])
        parent.n_children += 1
        parent.n_leaves += leaves
        parent.saved += saved

    def _keep(self, side: int, depth: int, node: Node) -> None:
        self.spine.append([side, depth, node.conv_id, node.n_convs, node.n_children, node.n_leaves, node.saved, node.words, node.ends])

    def add(self, conv_id: int, path: list[bytes], words: list[int]) -> None:
        if self.first is None:
            self.first, self.path, self.stack = path, path, [Node(w, True) for w in [0, *words]]
        elif path != self.path:
            self._end_run()
            common = common_prefix(path, self.path)
            while len(self.stack) > common + 1:
                self._pop()
            self.stack += [Node(w, False) for w in words[common:]]
            self.path = path
        self.stack[-1].gain(conv_id, 1)
        self.run.append(conv_id)
        if len(self.run) >= RUN_IDS and self.path == self.first:
            self._flush(0)

    def finish(self) -> None:
        if self.first is None:
            return
        last = self.path
        if last != self.first:
            while self.run:
                rest, self.run = self.run[RUN_IDS:], self.run[:RUN_IDS]
                self._flush(1)
                self.run = rest
        elif self.run:
            self._flush(0)
        for depth in range(len(self.stack) - 1, -1, -1):
            node = self.stack[depth]
            if depth:
                self.stack[depth - 1].gain(node.conv_id, node.n_convs)
            side = int(not node.spine)
            for child, ends in node.held:
                self._put(OPEN_PARENT, child, ends_sha256=ends, part=self.part, side=side, at=depth)
            self._keep(side, depth, node)
        paths = [[x.hex() for x in p] for p in (self.first, last)]
        self._put(STACKS, [], part=self.part, said=json.dumps({"paths": paths, "nodes": self.spine}))

    def take(self) -> pa.RecordBatch:
        columns = {c: [r.get(c) for r in self.out] for c in _COLUMNS}
        self.out = []
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c.split()[0]], kinds[c.split()[1]]) for c in SWEPT.split(", ")], names=_COLUMNS)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        for part, conv_id, path, words in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "path", "words")), strict=True):
            state = state or Sweep(part)
            state.add(conv_id, path, words)
            if len(state.out) >= 10_000:
                yield state.take()
    if state:
        state.finish()
        yield state.take()


STITCHED = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, run string, refs array<struct<part:long,side:int,at:long>>, runs array<struct<part:long,side:int>>"


def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Finished nodes out of all partitions' open stacks, a row a partition, swept in their order.

    ``refs`` are the entries that a node is made of; ``runs`` the pieces of the run of its own members.
    """
    stack: list[tuple[Node, list, list]] = []
    path: list[str] = []
    out: list[list] = []

    def pop() -> None:
        depth, (node, refs, runs) = len(stack) - 1, stack.pop()
        leaves, saved = node.total()
        row = [node.conv_id, depth, None, node.n_convs, node.n_children, leaves, saved, node.ends, f"{runs[0][0]}/{runs[0][1]}" if runs else None, refs, runs]
        for child in node.held:
            child[2] = node.conv_id
        if stack:
            parent = stack[-1][0]
            parent.held.append(row)
            parent.n_children += 1
            parent.n_leaves += leaves
            parent.saved += saved
        out.append(row)

    for part, said in sorted((int(p), said) for pdf in batches for p, said in zip(pdf["part"], pdf["said"], strict=True)):
        found = json.loads(said)
        nodes = {(side, depth): rest for side, depth, *rest in found["nodes"]}
        first, last = found["paths"]
        for side, new in enumerate([first, last] if first != last else [first]):
            common = common_prefix(new, path)
            while len(stack) > common + 1:
                pop()
            stack += [(Node(0, True), [], []) for _ in range(len(new) + 1 - len(stack))]
            path = new
            for depth in range(len(new) + 1):
                if (side, depth) not in nodes:
                    continue
                node, refs, _ = stack[depth]
                conv_id, n_convs, children, leaves, saved, words, ends = nodes[side, depth]
                node.gain(conv_id, n_convs)
                node.n_children, node.n_leaves, node.saved, node.words = node.n_children + children, node.n_leaves + leaves, node.saved + saved, words
                node.ends = node.ends or ends
                refs.append((part, side, depth))
            stack[-1][2].append((part, side))
    while stack:
        pop()
    frame = pd.DataFrame(out, columns=[*NODE, "ends_sha256", "run", "refs", "runs"])
    for c in NODE:
        frame[c] = frame[c].astype("Int64")
    yield frame


def hash_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each run's texts, which come in order, joined by commas; a text is held at a time."""
    run, state = None, None
    for pdf in batches:
        done = []
        for name, said in zip(pdf["run"], pdf["said"], strict=True):
            if name != run:
                if state:
                    done.append((run, state.hexdigest()))
                run, state = name, hashlib.sha256(said.encode())
            else:
                state.update(b"," + said.encode())
        yield pd.DataFrame(done, columns=["run", "whole"])
    if state:
        yield pd.DataFrame([(run, state.hexdigest())], columns=["run", "whole"])


def prefix_trie(arrays: DataFrame, at: str) -> DataFrame:
    """A row for each distinct prefix of the arrays (conv_id, path, words), ids being distinct; see ``op13_prefix_trie``.

    ``at`` is a new folder that all executors share.  Equal arrays are sorted by id and so spread over
    partitions; what a task holds grows with its partition's rows, not with a node's.  The stitching task gets one row for each
    partition, as long as the partition's first and last array.  An empty table gives an empty table.
    """
    ranged = checkpointed(arrays).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    ranged.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(sweep, SWEPT).write.parquet(at)
    swept = arrays.sparkSession.read.parquet(at)
    stacks = swept.filter(F.col("kind") == STACKS).select("part", "said")
    spine = checkpointed(stacks.repartition(1).mapInPandas(stitch, STITCHED))
    parents = spine.select(F.col("conv_id").alias("parent"), F.explode("refs").alias("r")).select("parent", "r.part", "r.side", "r.at")
    pieces = spine.filter("run is not null").select("run", F.explode("runs").alias("r")).select("run", "r.part", "r.side")
    texts = swept.filter(F.col("kind") == RUN).join(small(pieces), ["part", "side"]).select("run", "part", "side", "at", "said")
    whole = texts.repartition("run").sortWithinPartitions("run", "part", "side", "at").select("run", "said").mapInPandas(hash_runs, "run string, whole string")
    done = swept.filter(F.col("kind") == DONE).select(*NODE, "ends_sha256")
    hung = swept.filter(F.col("kind") == OPEN_PARENT).join(small(parents), ["part", "side", "at"]).select(*[F.col("parent").alias(c) if c == "parent_conv_id" else F.col(c) for c in NODE], "ends_sha256")
    ends = F.coalesce("whole", "ends_sha256", F.lit(_NONE)).alias("ends_sha256")
    return done.unionByName(hung).unionByName(spine.drop("refs", "runs").join(whole, "run", "left").select(*NODE, ends))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt ``conversations``: its smallest member, parent, members, children, leaves, and the
    words that members share in it and below, with the hash of the ids of members that end there."""
    return prefix_trie(turn_arrays(table(spark, sf_dir, "conversations")), scratch(spark, "trie"))


def _nibble_table() -> list[int]:
    """CRC-32 by four bits: entry i is what the remainder i becomes."""
    out = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 * (i & 1))
        out.append(i)
    return out


_STEP = "xor({0} >> 4, " + str(_nibble_table()) + "[({0} & 15) + 1]::BIGINT)"
OP13_SQL = rf"""
WITH o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_transform(list_transform([xor(c, b)], lambda x: {_STEP.format("x")}), lambda y: {_STEP.format("y")})[1]), 4294967295) % 4 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.t, [])[1 : h.h], h.t[h.h + 1 :]) AS t FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, len(t) AS n, d, t[1 : d] AS path FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY path, d),
c AS (SELECT path[1 : d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS own FROM n LEFT JOIN c USING (path)),
s AS (SELECT path[1 : a] AS path, count_if(n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM k) GROUP BY 1)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (path) LEFT JOIN n p ON k.d > 0 AND p.path = k.path[1 : k.d - 1]
"""
