"""Near-duplicate removal by one-permutation MinHash with optimal densification.

One hash of each shingle is enough: its upper half names one of BINS bins, and a bin keeps its least hash. A bin that stays
empty takes over that of another one, which is drawn by bin and attempt only until a full one is met, so two sets draw alike and
bins agree with the chance of their Jaccard similarity, for small sets too. Bands of ROWS bins are bucket keys. A bucket is not
turned into pairs: it gives a star of edges from one hub, the same one in all buckets of a group of copies, so that pairs are
in proportion to members (`jaccard_join.links`). What the stars have not joined comes last: pairs of one bucket in different
stars, without those that parity bitmaps rule out. Edges are confirmed on whole shingle sets. Two sets at the limit of 0.85 meet in no band with a
chance of about 2 in 10 million (26 bands of 5 rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .jaccard_join import links, sets_udf
from .storage import lasting, salted_join, split_by, temporary, written
from .text import distinct_grams, encoded, mixed, slices

WORDS, PERCENT = 3, 85
BANDS, ROWS = 26, 5
BINS = BANDS * ROWS
HALF = np.uint64(32)


def draws(bins: np.ndarray, attempt: int) -> np.ndarray:
    """The bin that each empty bin looks into at an attempt."""
    seed = (np.uint64(attempt) << HALF) + bins.astype(np.uint64)
    return ((mixed(seed + np.uint64(1)) >> HALF) * np.uint64(BINS) >> HALF).astype(np.int64)


def signatures(hashes: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Densified minima [rows, BINS] of sets, and which sets are not empty. hashes: ascending within a set; owner: their set."""
    out = np.zeros((rows, BINS), dtype=np.uint64)
    full = np.zeros((rows, BINS), dtype=bool)
    place = owner * BINS + ((hashes >> HALF) * np.uint64(BINS) >> HALF).astype(np.int64)
    first = np.ones(len(place), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    out.ravel()[place[first]] = hashes[first]
    full.ravel()[place[first]] = True
    some = full.any(axis=1)
    row, at = np.nonzero(~full & some[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        source = draws(at, attempt)
        met = full[row, source]
        out[row[met], at[met]] = out[row[met], source[met]]
        row, at = row[~met], at[~met]
    return out, some


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Keys [rows, BANDS] of the buckets."""
    parts = signature.reshape(-1, BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(parts), 1))
    for k in range(ROWS):
        key = mixed(key * np.uint64(ROWS + 1) + parts[:, :, k])
    return key.view(np.int64)


def bands_udf(n: int):
    """struct<n, bands> of texts: the number of distinct shingles, and the keys of the bands, none for a text without words."""

    @F.arrow_udf("n long, bands array<long>")
    def bands(texts: pa.Array) -> pa.Array:
        held, sizes, keys = encoded(texts), [], []
        for s in slices(held):
            hashes, owner = distinct_grams(held[s], n)
            rows = s.stop - s.start
            signature, some = signatures(hashes, owner, rows)
            sizes += np.bincount(owner, minlength=rows).tolist()
            keys += [k if x else [] for k, x in zip(band_keys(signature), some.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["n", "bands"])

    return bands


def deduplicated(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) and kept (whether that is its
    own) for each row of docs.

    Every row stays. Null and empty texts, and texts without words, have no shingles and link with nothing; texts of fewer
    than n words are one shingle; equal sets are linked. Rows that repeat a doc_id are one document: they share its
    component. A null doc_id links with nothing, has a null component and is kept. An empty table stays empty; other
    columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    with temporary(docs.sparkSession):
        signed = written(rows.select("doc_id", "key", bands_udf(n)("text").alias("s")).select("doc_id", "key", "s.*"))
        counts = lasting(signed.select("doc_id", F.col("n").alias("n_shingles")))
        named = lasting(_components(rows, signed.where("n > 0 AND doc_id IS NOT NULL"), n, percent))
    out = counts.join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _components(rows: DataFrame, signed: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id and component_id of the documents whose component has a smaller id. signed: doc_id, key (of the text), bands."""
    one = written(signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))  # of equal texts
    met = one.select("key", F.explode("bands").alias("band"))
    shared = written(met.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band"))
    maybe, _ = split_by(met, shared, ["band"])
    met = written(salted_join(maybe, shared, ["band"], "key", "inner"))
    some = written(met.select("key").distinct().join(one.select("key", "doc_id"), "key"))
    texts, _ = split_by(rows, some, ["doc_id", "key"])
    members = written(texts.join(some, ["doc_id", "key"]).select("key", sets_udf(n)("text").alias("s")).select("key", "s.*"))
    classes = written(members.groupBy("cid").agg(F.first("shingles").alias("shingles")).withColumn("n", F.size("shingles")))
    named = written(members.select("key", "cid").distinct())
    buckets = met.join(named, "key").select(F.col("band").alias("key"), "cid").distinct().join(classes.select("cid", "n"), "cid")
    lists = written(buckets.select("key", "cid", "n", F.lit(True).alias("heavy")))
    found = links(classes, percent, hub_rounds=1, lists=lists)
    ids = salted_join(signed.select("doc_id", "key"), named, ["key"], "doc_id", "left")
    ids = written(ids.select("doc_id", F.coalesce("cid", "key").alias("cid")).distinct())  # a text without candidates by itself
    twin = ids.groupBy("doc_id").agg(F.min("cid").alias("a"), F.count("*").alias("times")).where("times > 1")
    twins = ids.join(twin.select("doc_id", "a"), "doc_id").select("a", F.col("cid").alias("b"))
    groups = connected(found.union(twins))
    placed = salted_join(ids, groups.withColumnRenamed("node", "cid"), ["cid"], "doc_id", "left").withColumn("component", F.coalesce("component", "cid"))
    placed = written(placed)
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size")
    out = salted_join(placed, least, ["component"], "doc_id", "inner").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return out.where("component_id < doc_id")


def first_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that `deduplicated` keeps, with all their columns; rows that repeat a kept id all stay."""
    gone = deduplicated(docs, **how).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn("__id", F.col("doc_id").cast("long")).join(gone, "__id", "left_anti").select(*columns)
