"""Hashed word n-grams and logistic regression by follow-the-regularised-leader updates, for small models over large tables.

A feature's value is its number of times in the text, so a score is a sum of weights over a text's n-grams: no sorting
and no dictionary while scoring. Models are trained in tasks on a bounded sample; a model is one vector of 2**bits weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LETTERS, LOWER, encoded, grams, slices, words, words_of

#: How bytes look in a word's shape: lower-case letters and bytes beyond ASCII a, capitals A, digits 0, others as they are.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = SHAPE[128:] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")


class Features(NamedTuple):
    """n: words in an n-gram at most; shapes: also n-grams of word shapes with repeated letters as one; bits: of a hash;
    rooted: values are divided by the root of their sum in the text; letters: ASCII other than letters parts words;
    presence: values are 1."""

    n: int = 1
    shapes: bool = False
    bits: int = 18
    rooted: bool = False
    letters: bool = False
    presence: bool = False

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features of the texts, and the text of each."""
        found = [grams(w, k) for w in [words(texts, fold=LETTERS if self.letters else LOWER)] for k in range(1, self.n + 1)]
        if self.shapes:
            data = SHAPE[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
            keep = np.ones(len(data), dtype=bool)
            keep[1:] = data[1:] != data[:-1]
            ends = np.cumsum([len(t) + 1 for t in texts])
            sizes = np.diff(np.concatenate([[0], np.cumsum(keep)[ends - 1]]))
            found += [grams(w, k) for w in [words_of(data[keep], sizes)] for k in range(1, self.n + 1)]
        salts = np.arange(len(found), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        index = np.concatenate([(h + salt) >> np.uint64(64 - self.bits) for (h, _), salt in zip(found, salts, strict=True)])
        return index.astype(np.int64), np.concatenate([o for _, o in found])

    def sums(self, texts: list[bytes], weights: np.ndarray) -> np.ndarray:
        """For each text the product of its features with each row of weights: [texts, models]."""
        index, owner = self.of(texts)
        if self.presence:
            both = np.unique(owner << self.bits | index)
            index, owner = both & ((1 << self.bits) - 1), both >> self.bits
        out = np.stack([np.bincount(owner, weights=w[index], minlength=len(texts)) for w in weights], axis=1)
        if self.rooted:
            out = out / np.sqrt(np.maximum(np.bincount(owner, minlength=len(texts)), 1))[:, None]
        return out

    def rows(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the distinct features and their values."""
        for t in texts:
            index, count = np.unique(self.of([t])[0], return_counts=True)
            yield index, np.ones(len(index)) if self.presence else count / (np.sqrt(count.sum()) if self.rooted else 1.0)


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; the last coordinate is the bias, which is not regularised."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0  # the bias is always last
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: float, weight: float = 1.0) -> float:
        """One example; returns the probability before the update."""
        index, value = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(index)
        p = sigmoid(w @ value)
        g = (p - label) * weight * value
        n = self.n[index]
        after = n + g * g
        self.z[index] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[index] = after
        return float(p)


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo `by`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def drawn(rows: DataFrame, draw: Column, bound: int) -> DataFrame:
    """`bound` rows at most, those with the least draws (a 64-bit hash), ties by doc_id. Only rows below a threshold are
    ordered, some more than `bound`."""
    total, some = rows.count(), bound + 6 * bound**0.5 + 10
    most = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, some / max(total, 1)) * (1 << 64)))
    return rows.withColumn("__draw", draw).where(F.col("__draw") <= F.lit(most)).orderBy("__draw", "doc_id").limit(bound).drop("__draw")


def labelled_sample(labels: DataFrame, targets: list[str], held_out: Callable[[Column], Column], bound: int) -> DataFrame:
    """`bound` label rows at most, chosen by a hash of doc_id, held-out and null ids left out: doc_id and targets (0 or 1).

    Rows that repeat a doc_id become one with the mean label rounded; null labels count as 0 if another target has one."""
    doc = F.col("doc_id")
    known = labels.where(doc.isNotNull() & ~held_out(doc) & F.coalesce(*targets).isNotNull())
    known = known.groupBy("doc_id").agg(*[F.round(F.avg(F.coalesce(F.col(t), F.lit(0)))).cast("int").alias(t) for t in targets])
    return drawn(known, F.xxhash64(F.lit("sample"), doc), bound)


def sampled_features(docs: DataFrame, sample: DataFrame, features: Features, text: str = "text") -> DataFrame:
    """Features of the sampled documents: doc_id, index, value and the targets, one row for each id; of rows that repeat an id
    the least text. The sample is bounded, so it is broadcast."""

    @F.pandas_udf("index array<int>, value array<float>")
    def cut(texts):
        import pandas as pd

        rows = [r for x in texts for r in features.rows([(x or "").encode()])]
        return pd.DataFrame({"index": [i.astype(np.int32) for i, _ in rows], "value": [v.astype(np.float32) for _, v in rows]})

    targets = [c for c in sample.columns if c != "doc_id"]
    own = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    found = own.join(F.broadcast(sample), "doc_id").groupBy("doc_id", *targets).agg(F.min("text").alias("text"))
    return found.withColumn("f", cut("text")).select("doc_id", "f.*", *targets)


def scores_udf(features: Features, weights: np.ndarray, biases: np.ndarray, names: list[str], spark, chain: np.ndarray | None = None):
    """struct<names...> of probabilities of a text column. chain[i, j]: weight of model j's probability in model i, j < i."""
    held = spark.sparkContext.broadcast((weights.astype(np.float32), biases, chain))

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def score(texts: pa.Array) -> pa.Array:
        w, b, c = held.value
        found, out = encoded(texts), []
        for s in slices(found):
            x = features.sums(found[s], w) + b
            p = np.zeros_like(x)
            for i in range(x.shape[1]):
                p[:, i] = sigmoid(x[:, i] + (p[:, :i] @ c[i, :i] if c is not None and i else 0))
            out.append(p)
        p = np.concatenate(out) if out else np.zeros((0, len(names)))
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(len(names))], names=names)

    return score


__all__ = ["Features", "Ftrl", "drawn", "labelled_sample", "remainder", "sampled_features", "scores_udf", "sigmoid"]
