"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader updates.

The model is fitted on a bounded sample of labelled rows (`bound`), dealt to `shards` tasks; each task runs several
passes of updates over its rows, and the shards' weights are averaged. Scoring is a sparse dot product per text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Features, Ftrl, labelled_sample, remainder, sampled_features, scores_udf

FEATURES = Features(n=2, shapes=True, bits=18, rooted=True)
BOUND, SHARDS, PASSES = 12_000, 8, 3


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 5) == 0


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", features: Features = FEATURES, bound: int = BOUND, shards: int = SHARDS, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias, averaged over the shards. Without labelled rows all are 0, so every score is 0.5."""
    size = 1 << features.bits

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (hash_of(r["doc_id"]), r["doc_id"]))
        for shard in sorted({r["shard"] for r in rows}):
            own = [(np.array(r["index"], dtype=np.int64), np.array(r["value"]), r[target]) for r in rows if r["shard"] == shard]
            model = Ftrl(size, alpha=0.3, l1=0.01, l2=0.1)
            for _ in range(passes):
                for index, value, label in own:
                    model.learn(index, value, label)
            w = model.weights()
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(own)], pa.int64()), "at": pa.array([at.astype(np.int32)], pa.list_(pa.int32())), "w": pa.array([w[at].astype(np.float32)], pa.list_(pa.float32()))})

    sample = labelled_sample(labels, [target], held_out, bound)
    rows = sampled_features(docs, sample, features).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    fitted = rows.repartitionByRange(shards, "shard").mapInArrow(fit, "shard int, n long, at array<int>, w array<float>")
    total, out = 0, np.zeros(size + 1)
    for row in sorted(fitted.collect(), key=lambda r: r["shard"]):  # one sparse vector of at most 2**bits weights for each shard
        out[row["at"]] += np.array(row["w"]) * row["n"]
        total += row["n"]
    out /= max(total, 1)
    return out[:-1], float(out[-1])


def hash_of(doc_id: int) -> int:
    """Gives the order in which a shard's rows are learned."""
    return zlib.crc32(b"order" + str(doc_id).encode())


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", **how) -> DataFrame:
    """Adds quality_score (0 to 1) and quality_pred (1 from `threshold` on). Learns from texts of labelled, not held-out
    ids only. Every row stays, repeated rows too; null and empty texts get the score of no features; an empty table
    stays empty; without labels all scores are 0.5. Columns of the added names are replaced."""
    weights, bias = train(docs, labels, **how)
    udf = scores_udf(how.get("features", FEATURES), weights[None, :], np.array([bias]), ["p"], docs.sparkSession)
    return docs.withColumn("quality_score", udf(F.col(f"`{text}`"))["p"]).withColumn("quality_pred", (F.col("quality_score") >= F.lit(threshold)).cast("int"))
