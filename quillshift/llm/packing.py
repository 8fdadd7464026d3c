"""Sequence packing: best-fit decreasing over a segment tree of remaining capacities.

Documents become token pieces where they are read; only piece lengths are shuffled.  Pieces
are dealt into groups of bounded size, and each group is packed by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshift.llm.common import by_bytes, checkpointed, table
from quillshift.llm.word_cache import encoder

WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Stacks of open windows by remaining capacity; the tree finds the tightest that fits."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.some = [False] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.size
        while i and not self.some[i]:
            self.some[i] = True
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of least capacity that is at least ``need``."""
        i = need + self.size
        if not self.some[i]:
            while True:
                if i <= 1:
                    return None
                if i % 2 == 0 and self.some[i + 1]:
                    i += 1
                    break
                i //= 2
            while i < self.size:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        capacity = i - self.size
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            self.some[i] = False
            i //= 2
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = False
                i //= 2
        return capacity, window


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece, longest first into the tightest open window."""
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, windows = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found, windows = (window, windows), windows + 1
        left, where[i] = found
        offset[i] = window - left
        if left > n:
            tree.add(left - n, found[1])
    return where, offset


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of each document: its ids and the end id, cut into full windows and a rest.

    A null text counts as empty and gives one piece of one token.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, limit = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes(), 4 * window
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = enc.encode(text or "") + end
                for at in range(0, len(ids), limit):
                    part = ids[at : at + limit]
                    row = (None if pd.isna(doc) else doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)
                    out.append((*row, np.frombuffer(part, dtype="<u4").astype(np.int64)) if with_ids else row)
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return by_bytes(rows).mapInPandas(cut, PIECES + ", ids array<long>" * with_ids)


def pack(pieces: DataFrame, window: int = WINDOW, pieces_per_group: int = 50_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``window`` tokens.

    Pieces of a full window are sequences as they are; the others are dealt by a hash of
    document and start into groups of about ``pieces_per_group`` rows and packed best fit
    decreasing.  A group leaves about one window open, so padding stays little at any size.
    """
    held = checkpointed(pieces)
    n = held.filter(F.col("length") < window).count()
    groups = max(1, -(-n // pieces_per_group))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        where, offset = best_fit(pdf["length"].to_numpy(), window)
        group = int(pdf["bin"].iloc[0])
        return pdf.drop(columns="bin").assign(sequence_id=(np.int64(group + 1) << 32) + where, offset=offset)

    rest = held.filter(F.col("length") < window).withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    packed = rest.groupBy("bin").applyInPandas(fit, f"{names}, sequence_id long, offset long")
    # ids of full windows are negative, those of packed ones positive
    full = held.filter(F.col("length") >= window).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    Every row of ``docs`` is a document of its own, repeated rows too; an empty table gives an
    empty table; other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer_path, window), window)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
