"""Edit-aware token counts.

Each document keeps a segment tree over runs of pre-tokens (characters and tokens per run,
sums above).  An edit walks down to the runs it touches, takes boundary context along,
re-encodes until the new pre-token boundaries meet the old ones, and repairs the sums.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshift.llm.common import by_bytes, table

#: Pre-tokens of byte-level BPE: contractions, letters, digits, other marks, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ANY = regex.compile(PATTERN)
#: The same over characters whose classes are certain, for the faster engine.
_SURE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*+")
_FAST = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


class PieceCounter(dict):
    """Tokens of a pre-token, encoded once; the later half is forgotten past ``max_pieces`` (some 30 MB)."""

    def __init__(self, ranks_path: str, max_pieces: int = 150_000) -> None:
        super().__init__()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.max_pieces = max_pieces

    def __missing__(self, piece: str) -> int:
        n = len(self.coding.encode_ordinary(piece))
        if len(piece) <= 64:
            if len(self) >= self.max_pieces:
                kept = dict(islice(self.items(), self.max_pieces // 2))
                self.clear()
                self.update(kept)
            self[piece] = n
        return n


def pre_tokens(text: str) -> list[str]:
    return (_FAST if _SURE.fullmatch(text) else _ANY).findall(text)


class TokenTree:
    """A document's text, its leaves (pre-token runs) and the sums over them."""

    def __init__(self, text: str, counter: PieceCounter, leaf_pieces: int = 64, leaves: tuple[list[int], list[int]] | None = None) -> None:
        self.text, self.counter, self.leaf_pieces = text, counter, leaf_pieces
        self.encoded_chars = self.rebuilt = 0
        self.chars, self.tokens = (list(leaves[0]), list(leaves[1])) if leaves else self._leaves(pre_tokens(text))
        self._build()

    def _leaves(self, pieces: list[str], into: int = 0) -> tuple[list[int], list[int]]:
        """Characters and tokens of runs of ``leaf_pieces``, or of ``into`` runs as even as can be."""
        k, count = self.leaf_pieces, self.counter.__getitem__
        self.encoded_chars += sum(map(len, pieces))
        cuts = [i * len(pieces) // into for i in range(into + 1)] if into else [*range(0, len(pieces), k), len(pieces)]
        runs = [pieces[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return [sum(map(len, r)) for r in runs], [sum(map(count, r)) for r in runs]

    def _build(self) -> None:
        n = 1
        while n < max(1, len(self.chars)):
            n *= 2
        self.base = n
        self.sum_chars, self.sum_tokens = [0] * (2 * n), [0] * (2 * n)
        self.sum_chars[n : n + len(self.chars)] = self.chars
        self.sum_tokens[n : n + len(self.tokens)] = self.tokens
        for i in range(n - 1, 0, -1):
            self.sum_chars[i] = self.sum_chars[2 * i] + self.sum_chars[2 * i + 1]
            self.sum_tokens[i] = self.sum_tokens[2 * i] + self.sum_tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sum_tokens[1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds ``char``; the last one past the end."""
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if char - start >= self.sum_chars[i] and self.sum_chars[i + 1]:
                start += self.sum_chars[i]
                i += 1
        return i - self.base, start

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace ``length`` characters from ``start``; both are held within the text."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(start + max(0, length), len(self.text)))
        old, self.text = self.text, self.text[:start] + replacement + self.text[end:]
        if not self.chars:
            self.chars, self.tokens = self._leaves(pre_tokens(self.text))
            return self._build()
        # a boundary depends on up to three characters after it, never on any before it
        left, left_at = self.leaf_at(max(0, start - 3))
        right, right_at = self.leaf_at(end)
        right, right_at = right + 1, right_at + self.chars[right]
        shift = len(self.text) - len(old)
        while True:
            # one leaf more as context: its first boundary must be met by the new cut
            pieces = pre_tokens(self.text[left_at : (right_at + self.chars[right] if right < len(self.chars) else right_at) + shift])
            if right >= len(self.chars):
                kept = pieces
                break
            goal, at, kept = right_at + shift - left_at, 0, []
            for p in pieces:
                if at >= goal:
                    break
                kept.append(p)
                at += len(p)
            if at == goal:
                break
            right, right_at = right + 1, right_at + self.chars[right]
        leaves, k = right - left, self.leaf_pieces
        # leaves take up to twice their pieces before they split, and a quarter before they merge
        roomy = leaves <= len(kept) <= 2 * k * leaves and (leaves == 1 or 4 * len(kept) >= k * leaves)
        chars, tokens = self._leaves(kept, leaves if roomy else 0)
        self.rebuilt += not roomy
        if roomy:
            # as many leaves as before: repair the sums on their paths only
            self.chars[left:right], self.tokens[left:right] = chars, tokens
            touched = range(self.base + left, self.base + right)
            for i, c, t in zip(touched, chars, tokens, strict=True):
                self.sum_chars[i], self.sum_tokens[i] = c, t
            up = {i // 2 for i in touched}
            while up and up != {0}:
                for i in up:
                    self.sum_chars[i] = self.sum_chars[2 * i] + self.sum_chars[2 * i + 1]
                    self.sum_tokens[i] = self.sum_tokens[2 * i] + self.sum_tokens[2 * i + 1]
                up = {i // 2 for i in up if i > 1}
        else:
            self.chars[left:right], self.tokens[left:right] = chars, tokens
            self._build()


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


TREE = "leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, encoded_chars long"


def _edits_of(value: Iterable | None) -> list[tuple[int, int, str]]:
    if value is None or isinstance(value, float):
        return []
    return [(int(e["start"] or 0), int(e["length"] or 0), e["replacement"] or "") for e in value if e is not None]


def build_trees(docs: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", leaf_pieces: int = 64) -> DataFrame:
    """The columns ``keep``, the text, and its tree: leaves, token total, characters encoded.

    A null text counts as empty: no leaves, 0 tokens.  An empty table gives an empty table; repeated
    rows have a tree each; texts of any length are read whole.  A kept column of the name of a
    result gives way to it; other columns are left out.
    """
    keep = tuple(c for c in keep if c not in ("text", *(x.split()[0] for x in TREE.split(", "))))
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = counter(ranks_path)
        for pdf in batches:
            trees = [TokenTree(t, known, leaf_pieces) for t in pdf["text"]]
            yield pdf.assign(leaf_chars=[t.chars for t in trees], leaf_tokens=[t.tokens for t in trees], n_tokens=[t.total for t in trees], encoded_chars=[t.encoded_chars for t in trees])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return by_bytes(rows).mapInPandas(build, f"{own}, {TREE}")


def apply_edits(trees: DataFrame, ranks_path: str, edits_col: str = "edits", leaf_pieces: int = 64) -> DataFrame:
    """Apply an array of (start, length, replacement) to each document, one after the other.

    Text, leaves and total are those of the edited text; ``encoded_chars`` tells how many
    characters were encoded again.  Offsets count code points and are held within the text;
    null edits, lengths and replacements do nothing.  Leaves grow to twice their size before they
    split, so that most edits repair the sums above the leaves they touch and no others.
    Repeated rows, empty tables and other columns are as they come.
    """

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = counter(ranks_path)
        for pdf in batches:
            trees = []
            for text, chars, tokens, edits in zip(pdf["text"], pdf["leaf_chars"], pdf["leaf_tokens"], pdf[edits_col], strict=True):
                tree = TokenTree(text, known, leaf_pieces, ([int(c) for c in chars], [int(t) for t in tokens]))
                for one in _edits_of(edits):
                    tree.edit(*one)
                trees.append(tree)
            yield pdf.drop(columns=edits_col).assign(text=[t.text for t in trees], leaf_chars=[t.chars for t in trees], leaf_tokens=[t.tokens for t in trees], n_tokens=[t.total for t in trees], encoded_chars=[t.encoded_chars for t in trees])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trees.schema.fields if f.name != edits_col)
    return by_bytes(trees).mapInPandas(edit, kept)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of every document before and after three edits: a cut, a change, an insertion."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    trees = build_trees(table(spark, sf_dir, "documents"), path).withColumnRenamed("n_tokens", "tokens")
    size = F.length("text")

    def one(start, length: int, replacement: str):
        return F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), F.lit(replacement).alias("replacement"))

    edits = F.array(one(size / 3, 12, ""), one(size / 2, 5, "rewritten"), one(F.lit(0), 0, "Title.\n"))
    edited = apply_edits(trees.withColumn("n_tokens", F.col("tokens")).withColumn("edits", edits), path)
    return edited.select("doc_id", "tokens", F.size("leaf_chars").alias("leaves"), F.col("n_tokens").alias("edited_tokens"), F.length("text").alias("edited_chars"), F.col("encoded_chars").alias("reencoded_chars"))
