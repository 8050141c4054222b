"""Toxicity by classifier chains: categories are predicted in order, each linear model also fed the probabilities of the
categories before it. Later models are trained with out-of-fold probabilities, so they see earlier models as they are
on texts that these have not learned.

Training uses a bounded sample of labelled rows (`bound`). For each category one task fits each fold's model, and one
the model over all folds; a model is one vector of weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Features, Ftrl, labelled_sample, remainder, sampled_features, scores_udf, sigmoid
from .quality import hash_of
from .storage import written

FEATURES = Features(n=1, bits=20, letters=True, presence=True)
BOUND, FOLDS, PASSES = 16_000, 3, 4
#: Weight of an update by a row that has the category.
POSITIVE = 2.0


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 5) == 0


def sparse(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values other than zero; the last place always."""
    at = np.union1d(np.flatnonzero(m), [len(m) - 1])
    return at.astype(np.int32), m[at]


def dense(m: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(int(m[0][-1]) + 1)
    out[m[0]] = m[1]
    return out


def _fit_category(rows: DataFrame, earlier: list[dict[int, np.ndarray]], target: str, before: list[str], features: Features, folds: int, passes: int) -> dict[int, np.ndarray]:
    """Models of one category by fold; at `folds` the model of all rows. A vector holds the weights, one weight for each
    earlier category, and the bias. earlier: the models of the categories before, in order."""
    size, k, session = 1 << features.bits, len(before), rows.sparkSession
    held = session.sparkContext.broadcast([{f: sparse(m) for f, m in x.items()} for x in earlier])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = [{f: dense(m) for f, m in x.items()} for x in held.value]
        by: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                index, value = np.array(r["index"], dtype=np.int64), np.array(r["value"])
                p: list[float] = []
                for i, models in enumerate(chain):  # of a model that has not seen this row
                    m = models.get(r["fold"], models[folds])
                    p.append(float(sigmoid(m[index] @ value + m[size : size + i] @ np.array(p[:i]) + m[-1])))
                by.setdefault(r["model"], []).append((r["doc_id"], np.concatenate([index, np.arange(size, size + k)]), np.concatenate([value, p]), r[target]))
        for model, own in by.items():
            own.sort(key=lambda x: (hash_of(x[0]), x[0]))
            ftrl = Ftrl(size + k, alpha=0.5, l1=10.0, l2=0.1)
            for _ in range(passes):
                for _, index, value, label in own:
                    ftrl.learn(index, value, label, POSITIVE if label else 1.0)
            at, w = sparse(ftrl.weights())
            yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.int32()), "at": pa.array([at], pa.list_(pa.int32())), "w": pa.array([w], pa.list_(pa.float64()))})

    models = F.filter(F.array(*[F.lit(i) for i in range(folds + 1)]), lambda m: m != F.col("fold"))
    dealt = rows.withColumn("model", F.explode(models)).repartitionByRange(folds + 1, "model")
    out = {}
    for r in dealt.mapInArrow(fit, "model int, at array<int>, w array<double>").collect():  # one sparse vector for each model
        m = np.zeros(size + k + 1)
        m[r["at"]] = r["w"]
        out[r["model"]] = m
    return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], features: Features = FEATURES, bound: int = BOUND, folds: int = FOLDS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights [categories, 2**bits], biases, and the weights of earlier probabilities [categories, categories]. Zeros
    without labelled rows."""
    size, k = 1 << features.bits, len(categories)
    sample = labelled_sample(labels, categories, held_out, bound)
    rows = sampled_features(docs, sample, features).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int"))
    rows = written(rows)
    weights, biases, chain, done = np.zeros((k, size)), np.zeros(k), np.zeros((k, k)), []
    for i, target in enumerate(categories):
        models = _fit_category(rows, done, target, categories[:i], features, folds, passes)
        zero = np.zeros(size + i + 1)
        models = {f: models.get(f, models.get(folds, zero)) for f in range(folds + 1)}
        m = models[folds]
        weights[i], chain[i, :i], biases[i] = m[:size], m[size : size + i], m[-1]
        done.append(models)
    return weights, biases, chain


def score(docs: DataFrame, labels: DataFrame, categories: list[str], threshold: float = 0.5, text: str = "text", **how) -> DataFrame:
    """Adds the struct column `toxicity` with the probability of each category, and toxic_pred: 1 if the last category's
    reaches the threshold. Every row stays, repeated rows too; null and empty texts get the scores of no features; an
    empty table stays empty; without labels all probabilities are 0.5. Columns of the added names are replaced."""
    weights, biases, chain = train(docs, labels, categories, **how)
    udf = scores_udf(how.get("features", FEATURES), weights, biases, categories, docs.sparkSession, chain)
    out = docs.withColumn("toxicity", udf(F.col(f"`{text}`")))
    return out.withColumn("toxic_pred", (F.col("toxicity")[categories[-1]] >= F.lit(threshold)).cast("int"))
