"""Alignment of the tokens of two tokenizers on the bytes that they both cover.

Documents of an Arrow batch are laid end to end.  The ends of all tokens of either tokenizer are
counted once by byte offset, and the text is cut where both have one; prefix sums over
the offsets, taken apart at the documents' bounds, give each document's results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillshift.llm.common import scratch, slices, table
from quillshift.llm.word_cache import byte_letters

#: Bytes of text that are laid end to end at a time; a longer text is taken by itself.
BATCH = 1 << 20
#: Pairs whose counts the workers hold in memory (16 bytes each); beyond, counts are joined by shuffles.
HELD_PAIRS = 2_000_000

GROUPS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


class ByteLevel:
    """A byte-level BPE file: ids and each id's bytes; special tokens' strings are plain text."""

    def __init__(self, path: str, fast: str | None = None, pattern: str = "") -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = {c: b for b, c in byte_letters().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.parts = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.parts[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        # the same merges as ranks, several times as fast; used only if it has the same ids
        self.ranks = None
        if fast:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(fast, "rb"))}  # noqa: SIM115
            if all(self.parts[i] == part for part, i in ranks.items()):
                self.ranks = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        if self.ranks is not None:
            return [self.ranks.encode_ordinary(" " + t) if len(t) < 1_000_000 else self._whole(" " + t) for t in texts]
        return [self._whole(" " + t) for t in texts]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model: ids and each id's bytes; the model adds the space itself."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.parts = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self.model.encode(list(texts), num_threads=1)


@cache
def _tools(a_path: str, b_path: str, fast: str | None, pattern: str) -> tuple:
    """A worker's tokenizers; lengths of their tokens; ids as text by whether a group's half ends there."""
    a, b = ByteLevel(a_path, fast, pattern), Pieces(b_path)
    sizes = tuple(np.array([len(p) for p in t.parts], dtype=np.int64) for t in (a, b))
    spelt = [s for i in range(len(a.parts)) for s in (f"{i},", f"{i}|")] + [s for i in range(len(b.parts)) for s in (f"{i},", f"{i};")]
    return a, b, *sizes, spelt


def covers(parts: Sequence[bytes], ids: Sequence[int], text: bytes) -> bool:
    return b"".join(map(parts.__getitem__, ids)) == text


def aligned(a_ids: Sequence[Sequence[int]], b_ids: Sequence[Sequence[int]], a_size: np.ndarray, b_size: np.ndarray) -> dict[str, np.ndarray]:
    """Groups and links of documents whose tokens cover the same bytes.

    Per document ``n_groups`` and ``n_links``; over all, each token's group, and the links' ids and documents.
    """
    a, b = (np.fromiter((i for ids in each for i in ids), np.int64, sum(map(len, each))) for each in (a_ids, b_ids))
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    total = int(a_end[-1]) if len(a_end) else 0
    at_a, at_b = np.bincount(a_end, minlength=total + 1), np.bincount(b_end, minlength=total + 1)
    both = (at_a > 0) & (at_b > 0)
    groups, links = np.cumsum(both), np.cumsum(at_a * at_b)
    # a document ends where its last token does
    bounds = a_end[np.cumsum([len(x) for x in a_ids]) - 1] if len(a_ids) else np.empty(0, np.int64)
    per_doc = lambda sums: np.diff(sums[bounds], prepend=0)
    # a token's group is the number of cuts before its end
    a_group, b_group = (groups[end] - both[end] for end in (a_end, b_end))
    linked = np.flatnonzero(both[a_end])
    times = at_b[a_end[linked]]
    first = np.searchsorted(b_end, a_end[linked])
    left = np.repeat(linked, times)
    right = np.repeat(first, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    return {"a": a, "b": b, "n_groups": per_doc(groups), "n_links": per_doc(links), "a_group": a_group, "b_group": b_group, "link_a": a[left], "link_b": b[right]}


def _spelling(m: dict[str, np.ndarray], spelt: Sequence[str], a_kinds: int) -> list[str]:
    """All tokens as text, group by group: A's ids, then B's."""
    a, b, ga, gb = m["a"], m["b"], m["a_group"], m["b_group"]
    n = int(ga[-1]) + 1 if len(ga) else 0
    of_a, of_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    last_a, last_b = np.append(ga[1:] != ga[:-1], True)[: len(a)], np.append(gb[1:] != gb[:-1], True)[: len(b)]
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + (np.cumsum(of_b) - of_b)[ga]] = 2 * a + last_a
    codes[np.arange(len(b)) + np.cumsum(of_a)[gb]] = 2 * (a_kinds + b) + last_b
    return list(map(spelt.__getitem__, codes.tolist()))


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", fast: str | None = None, pattern: str = "") -> DataFrame:
    """Per document its groups and links; ``pairs`` are its distinct linked ids (a * kinds of B + b) with their ``times``.

    Null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no
    tokens.  Texts are read whole; repeated rows and ids are documents of their own; an empty table
    gives an empty table; other columns are ignored.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, a_size, b_size, spelt = _tools(a_path, b_path, fast, pattern)
        kinds = len(b.parts)
        for batch in batches:
            for part in slices(batch, BATCH):
                texts = part.column(1).to_pylist()
                some = [i for i, t in enumerate(texts) if t]
                a_ids, b_ids = a.encode([texts[i] for i in some]), b.encode([texts[i] for i in some])
                good = [k for k, i in enumerate(some) if covers(a.parts, a_ids[k], raw := (" " + texts[i]).encode()) and covers(b.parts, b_ids[k], raw)]
                a_ids, b_ids, some = [a_ids[k] for k in good], [b_ids[k] for k in good], [some[k] for k in good]
                m = aligned(a_ids, b_ids, a_size, b_size)
                said = _spelling(m, spelt, len(a.parts))
                out = {c: [0] * len(texts) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * len(texts), "pairs": [b""] * len(texts), "times": [b""] * len(texts)}
                links = m["link_a"] * kinds + m["link_b"]
                to_token = list(accumulate((len(x) + len(y) for x, y in zip(a_ids, b_ids, strict=True)), initial=0))
                to_link = np.concatenate([[0], np.cumsum(m["n_links"])]).astype(int)
                for k, i in enumerate(some):
                    out["n_a"][i], out["n_b"][i] = len(a_ids[k]), len(b_ids[k])
                    out["n_groups"][i], out["n_links"][i] = int(m["n_groups"][k]), int(m["n_links"][k])
                    out["groups_sha256"][i] = hashlib.sha256("".join(said[to_token[k] : to_token[k + 1]])[:-1].encode()).hexdigest()
                    pairs, times = np.unique(links[to_link[k] : to_link[k + 1]], return_counts=True)
                    out["pairs"][i], out["times"][i] = pairs.astype("<u8").tobytes(), times.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[f.name], f.type) for f in list(_ARROW)[1:])], schema=_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(align, GROUPS)


def _packed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all rows and their times, end to end."""
    join = lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind).astype(np.int64)
    return join("pairs", "<u8"), join("times", "<u4")


def pair_counts(groups: DataFrame, kinds: int) -> DataFrame:
    """(pair, n, best): how often a pair is linked in all documents, and whether no pair of its B id is linked more often."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 << 20, 0):
                pairs, times = _packed(part)
                known, at = np.unique(pairs, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(np.bincount(at, times, len(known)).astype(np.int64))], names=["pair", "n"])

    partial = groups.select("pairs", "times").mapInArrow(tally, "pair long, n long")
    counts = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    top = counts.groupBy((F.col("pair") % kinds).alias("b")).agg(F.max("n").alias("top"))
    return counts.join(top, F.col("pair") % kinds == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def score_links(groups: DataFrame, counts: DataFrame, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` from the counts of all documents, and drop the pairs.

    Up to ``held_pairs`` counts go to the workers, 16 bytes each; more are joined to the
    documents' distinct pairs, where hot pairs are left to the join's splitting of skewed partitions.
    """
    names = [f.name for f in _SCORED if f.name in groups.columns]
    if counts.limit(held_pairs + 1).count() <= held_pairs:
        found = counts.toPandas().sort_values("pair")
        known = groups.sparkSession.sparkContext.broadcast((found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64), found["best"].to_numpy(bool)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, n, best = known.value
            for batch in batches:
                for part in slices(batch, 8 << 20, batch.schema.get_field_index("pairs")):
                    pairs, times = _packed(part)
                    at = np.searchsorted(pair, pairs)
                    ends = np.cumsum([len(x) // 8 for x in part.column("pairs").to_pylist()])
                    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends], prepend=0).astype(np.int64)  # noqa: B023, E731
                    made = {"n_best": total(times * best[at]), "count_sum": total(times * n[at])}
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name]) if f.name in made else part.column(f.name) for f in _SCORED], schema=_SCORED)

        return groups.mapInArrow(score, ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in _SCORED))
    keyed = groups.withColumn("_row", F.monotonically_increasing_id())

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 << 20):
                pairs, times = _packed(part)
                each = [len(x) // 8 for x in part.column("pairs").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("_row").to_numpy(), each)), pa.array(pairs), pa.array(times)], names=["_row", "pair", "times"])

    rows = keyed.select("_row", "pairs", "times").mapInArrow(unpack, "_row long, pair long, times long")
    sums = rows.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return keyed.join(sums, "_row", "left").select(*names[:-1], zero("n_best"), zero("count_sum"), names[-1])


def align_tokens(docs: DataFrame, a_path: str, b_path: str, at: str, id_col: str = "doc_id", text_col: str = "text", fast: str | None = None, pattern: str = "", held_pairs: int = HELD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    Documents' groups are written to ``at``, a folder that all executors share, counted, and read again
    with the counts.  For nulls, empty texts, repeats and empty tables see ``token_groups``.
    """
    token_groups(docs, a_path, b_path, id_col, text_col, fast, pattern).write.option("compression", "zstd").parquet(at)
    groups = docs.sparkSession.read.parquet(at)
    kinds = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    return score_links(groups, pair_counts(groups, kinds), held_pairs)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and piece tokens of every document, aligned on their bytes, with link counts of all documents."""
    import public_tokenizers as public

    paths = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
    return align_tokens(table(spark, sf_dir, "documents"), *paths, scratch(spark, "groups"), fast=public.path("byte_bpe_50k.tiktoken"), pattern=public.PATTERN)
