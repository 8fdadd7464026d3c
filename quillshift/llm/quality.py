"""Quality classifier: regularised quadratic discriminant over document statistics.

Class means and covariances are sums, so they come from one distributed aggregation over all
labelled rows; no sample is drawn.  Each covariance is shrunk towards the pooled one and its
diagonal, its Cholesky factor is computed once, and scoring is a triangular product per batch.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshift.llm.common import by_bytes, checkpointed, table

#: Common function words, as in running text of four languages.
COMMON = frozenset(
    "the of and to in a is that for it was with be on by at from this are or der die das und ist von den zu mit nicht ein auf "
    "le la les de des et en un une que qui est pour pas sur el los y por con no su del al".split()
)
FEATURES = (
    "same_as_last", "repeated_words", "repeated_pairs", "upper", "symbols", "bars", "exclaims", "stops", "digits",
    "letters", "word_length", "top_word", "size", "line_size",
)
_SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"!|-()?"]


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; additive smoothing draws short texts to the usual."""
    text = text or ""
    words = text.split()
    n, raw = len(words), text.encode("utf-8", "replace")
    h = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = max(1, int(h.sum()))
    upper, lower, high = int(h[65:91].sum()), int(h[97:123].sum()), int(h[192:].sum())
    letters = upper + lower + high
    same = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    counts = Counter(words)
    distinct = len(counts)
    pairs = len(set(zip(words, words[1:], strict=False)))
    top = max(counts.values(), default=0)
    stops = sum(map(COMMON.__contains__, words))

    def part(x: float, of: float, usual: float, weight: float) -> float:
        return math.log((x + usual * weight) / (of + weight))

    return [
        part(same, n, 0.01, 40),
        # distinct words fall with the length as a power of it, which is the usual share here
        math.log((distinct + 30) / (n + 30)) + 0.25 * math.log1p(n / 30),
        math.log((pairs + 30) / (n + 30)),
        part(upper, letters, 0.03, 200),
        part(int(h[_SYMBOLS].sum()), chars, 0.002, 300),
        part(int(h[124]), n, 0.002, 50),
        part(int(h[33]), n, 0.005, 50),
        part(stops, n, 0.25, 40),
        part(int(h[48:58].sum()), chars, 0.005, 300),
        part(letters, chars, 0.82, 300),
        part(letters, n, 5.0, 40),
        part(top, n, 0.02, 60),
        math.log1p(n),
        part(chars, int(h[10]) + 1, 250.0, 2),
    ]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t) for t in pdf["text"]]})


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return by_bytes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInPandas(_features, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Means, whitening factors (inverse Cholesky) and log normalisers of both classes."""

    mean: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    offset: tuple[float, float]
    centre: np.ndarray
    scale: np.ndarray
    limit: float
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        z = np.clip((x - self.centre) / self.scale, -self.limit, self.limit)
        log = [o - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.mean, self.whiten, self.offset, strict=True)]
        return 1 / (1 + np.exp(np.clip((log[0] - log[1]) * self.temper, -700, 700)))


def fit(labelled: DataFrame, to_pooled: float = 0.2, to_diagonal: float = 0.05, limit: float = 12.0, temper: float = 0.5) -> Model | None:
    """Fit on (x array<double>, label 0/1); None if no row is labelled.

    Sums are taken about the first pass's mean, so nothing cancels.  A class without rows
    takes the pooled moments.
    """
    d = len(FEATURES)
    at = [F.col("x")[i] for i in range(d)]
    first = labelled.agg(F.count(F.lit(1)), *(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at)).first()
    if not first[0]:
        return None
    centre = np.array(first[1 : d + 1], dtype=float)
    scale = np.maximum(np.array(first[d + 1 :], dtype=float), 1e-6)
    z = labelled.select("label", F.array(*(F.greatest(F.lit(-limit), F.least(F.lit(limit), (c - float(m)) / float(s))) for c, m, s in zip(at, centre, scale, strict=True))).alias("z"))
    up = [(i, j) for i in range(d) for j in range(i, d)]
    sums = {
        int(r[0]): r
        for r in z.groupBy("label").agg(F.count(F.lit(1)), *(F.sum(F.col("z")[i]) for i in range(d)), *(F.sum(F.col("z")[i] * F.col("z")[j]) for i, j in up)).collect()
    }
    n, mean, cov = {}, {}, {}
    for c, r in sums.items():
        n[c], mean[c] = r[1], np.array(r[2 : 2 + d]) / r[1]
        second = np.zeros((d, d))
        for (i, j), v in zip(up, r[2 + d :], strict=True):
            second[i, j] = second[j, i] = v / r[1]
        cov[c] = second - np.outer(mean[c], mean[c])
    total = sum(n.values())
    pooled = sum(n[c] / total * cov[c] for c in n) + 1e-3 * np.eye(d)
    offset, whiten, means = [], [], []
    for c in (0, 1):
        s = (1 - to_pooled) * cov.get(c, pooled) + to_pooled * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(d)
        factor = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(factor))
        means.append(mean.get(c, np.zeros(d)))
        offset.append(-float(np.log(np.diag(factor)).sum()) + math.log((n.get(c, 0) + 1) / (total + 2)))
    return Model((means[0], means[1]), (whiten[0], whiten[1]), (offset[0], offset[1]), centre, scale, limit, temper)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """Fit on the features ``rows`` of labelled documents that are not held out."""
    seen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").distinct()
    return fit(checkpointed(rows.join(seen.filter(~held_out(F.col("doc_id"))), "doc_id").select("x", "label")))


def scorer(model: Model | None, of_text: bool):
    """A column function from features, or from text, to scores; 0.5 without a model."""

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        if model is None or not len(x):
            return pd.Series([0.5] * len(x), dtype="float64")
        return pd.Series(model.score(np.vstack([statistics(t) for t in x] if of_text else x.to_numpy())))

    return scored


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    ``held_out`` is crc32(id as text) mod 5 = 0; labels of held-out rows are never read.  Null
    texts count as empty and are scored like any other; rows with a null id are scored and
    are not held out.  Labels that are null or neither 0 nor 1 are ignored; a document
    labelled twice counts once for each label; repeated rows give repeated results.  Without
    any label every score is 0.5.  An empty table gives an empty table.  Texts of any length are
    read whole; other columns, lang and source among them, are never read.
    """
    rows = checkpointed(features(docs, id_col, text_col))
    model = fit_labels(rows, labels, id_col, label_col)
    done = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model, False)("x").alias("score"))
    return done.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all its columns) that score ``threshold`` or more.

    Texts are scored where they are read, in a second pass, so none is shuffled.  Null and empty
    texts, null ids, repeated rows and empty tables are as in ``score_quality``.
    """
    model = fit_labels(features(docs), labels)
    return by_bytes(docs).filter(scorer(model, True)(F.col("text")) >= threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from the labels of those that are not held out."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
