"""Document fingerprints: MinHash with universal hash permutations over word shingles, in vectorised numpy.

A fingerprint has PERMUTATIONS minima, of which 16 bits each are kept. Two fingerprints are as alike as the share of equal
parts, which estimates the Jaccard similarity of the shingle sets. For near-copies, bands of whole minima are joined in
Spark, list by list against hubs, and candidates are verified on whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .jaccard_join import links, set_id, sets_udf
from .storage import lasting, salted_join, split_by, temporary, written
from .text import distinct_grams, encoded, grams, rested, resting, slices, words

WORDS, PERMUTATIONS = 5, 128
BANDS, BAND_ROWS = 24, 4
#: Bytes of text in a range of ids, and ranges at most.
RANGE_BYTES, RANGES = 4 << 20, 100_000
_RNG = np.random.default_rng(1990)
_A = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
EMPTY = np.uint32(0xFFFFFFFF)


def signatures(texts: list[bytes], n: int = WORDS) -> np.ndarray:
    """Minima of each text: [texts, PERMUTATIONS]; all EMPTY for a text without words."""
    return minima(*grams(words(texts), n), len(texts))


def minima(hashes: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Minima of sets of hashes: [rows, PERMUTATIONS]; all EMPTY for an empty set. owner: the set of each hash, ascending."""
    out = np.full((rows, PERMUTATIONS), EMPTY, dtype=np.uint32)
    if len(hashes):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        some = owner[starts]
        for k in range(PERMUTATIONS):
            out[some, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    return out


def kept(signature: np.ndarray) -> np.ndarray:
    """The 16 bits of each minimum that a fingerprint has."""
    return (signature & np.uint32(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal parts of two fingerprints (`kept`), row by row. Of two empty texts it is 1."""
    return (a == b).mean(axis=1)


def names(parts: np.ndarray) -> list[str]:
    """Fingerprints as text: 4 hexadecimal digits for each part."""
    return [row.tobytes().hex() for row in parts]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FIELDS from rows (range, ahead, doc_id, text, component), where a range's rows come one after another and one
    row from ahead of it last. A row with a component has no text and stands before the rows of its id."""
    rows: list[tuple] = []
    known: tuple = (None, None)

    def emit(some: list[tuple]) -> pa.RecordBatch:
        own = [i for i in range(len(some) - 1) if not some[i][1]]
        after = [some[i + 1] for i in own]
        texts = [some[i][3] for i in own]
        changed = [edited(t, x[3]).encode() for t, x in zip(texts, after, strict=True)]
        sign = kept(signatures([x[3].encode() for x in some]))
        mine, theirs, new = sign[own], sign[[i + 1 for i in own]], kept(signatures(changed))
        columns = [
            pa.array([some[i][2] for i in own], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
            pa.array(names(mine), pa.string()),
            pa.array(names(new), pa.string()),
            pa.array(likeness(mine, new), pa.float64()),
            pa.array(likeness(mine, theirs), pa.float64()),
            pa.array([some[i][4] for i in own], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FIELDS.split(", ")])

    for b in batches:
        for range_, ahead, doc, text, component in zip(*(b.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text", "component")), strict=True):
            if component is not None:
                known = (doc, component)
            else:
                rows.append((range_, ahead, doc, text or "", known[1] if doc is not None and known[0] == doc else doc))
        for s in list(slices([r[3] for r in rows]))[:-1]:
            yield emit(rows[s.start : s.stop + 1])
        rows = rows[list(slices([r[3] for r in rows]))[-1].start :] if rows else rows
    if len(rows) > 1:
        yield emit(rows)
    rested()


def with_next(docs: DataFrame, components: DataFrame, text: str = "text") -> DataFrame:
    """Rows (range, ahead, doc_id, text, component) sorted for `compare`. The ids are cut in ranges of about RANGE_BYTES of text, so
    one shuffle of the texts is enough; each range also gets the first rows of the range after it, the last one those of
    the first. Only the ranges' bounds and first ids, a bounded number, are known to the driver."""
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(RANGES, max(1, total // RANGE_BYTES)))
    shares = ", ".join(f"{i / n}D" for i in range(1, n)) or "0.5D"
    cuts = rows.agg(F.expr(f"percentile_approx(place, array({shares}), {2 * RANGES})")).first()[0] or []
    bounds = np.unique(np.array(cuts, dtype=np.int64)) if n > 1 else np.empty(0, dtype=np.int64)

    @F.arrow_udf("int")
    def range_of(place: pa.Array) -> pa.Array:
        return pa.array(len(bounds) - np.searchsorted(bounds, place.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    ranged = rows.withColumn("range", range_of("place"))
    heads = sorted((r["range"], r["head"]) for r in ranged.select("range", "place").groupBy("range").agg(F.max("place").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}  # of the first: the last range

    @F.arrow_udf("array<int>")
    def ranges_of(place: pa.Array) -> pa.Array:
        places = place.to_numpy(zero_copy_only=False)
        own = len(bounds) - np.searchsorted(bounds, places, side="right")
        return pa.array([[2 * o] + ([2 * before[p] + 1] if p in before else []) for o, p in zip(own.tolist(), places.tolist(), strict=True)], pa.list_(pa.int32()))

    dealt = rows.withColumn("to", F.explode(ranges_of("place"))).select(F.shiftright("to", 1).alias("range"), (F.col("to") % 2 == 1).alias("ahead"), "place", "doc_id", "text", F.lit(None).cast("long").alias("component"))
    known = components.select(range_of("doc_id").alias("range"), F.lit(False).alias("ahead"), F.col("doc_id").alias("place"), "doc_id", F.lit(None).cast("string").alias("text"), F.col("component_id").alias("component"))
    dealt = dealt.union(known).repartition(max(1, len(heads)), "range").sortWithinPartitions("range", "ahead", F.desc("place"), F.col("component").desc_nulls_last(), "text")
    return dealt.select("range", "ahead", "doc_id", "text", "component")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of FIELDS: each document's fingerprint, that of its text edited with the next document's, in descending order of
    doc_id, how alike they are, and the smallest doc_id among its near-copies (`near_copies`), its own if there is none.

    Every row stays. Null texts count as empty; rows that repeat an id follow one another by text; null ids come last and
    have no component; a single document is its own next; an empty table stays empty; other columns are not read."""
    return with_next(docs, near_copies(docs, text=text), text).mapInArrow(compare, FIELDS)


def fingerprint_udf():
    """The fingerprint of a text column, null as the empty text."""

    @F.arrow_udf("string")
    def fingerprint(texts: pa.Array) -> pa.Array:
        held = encoded(texts)
        return pa.array([x for s in slices(held) for x in names(kept(signatures(held[s])))], pa.string())

    return fingerprint


def signed_udf(n: int):
    """struct<cid, n, bands> of texts: a hash of the distinct shingles (as `sets_udf`), their number, and the keys of the bands,
    none for a text without words."""

    @F.arrow_udf("cid long, n int, bands array<long>")
    @resting
    def signed(texts: pa.Array) -> pa.Array:
        held, cids, sizes, out = encoded(texts), [], [], []
        for s in slices(held):
            rows = s.stop - s.start
            hashes, owner = distinct_grams(held[s], n)
            sizes += (counts := np.bincount(owner, minlength=rows)).tolist()
            cids += [set_id(part) for part in np.split(hashes, np.cumsum(counts)[:-1])]
            sign = minima(hashes, owner, rows)[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
            key = np.tile(np.arange(BANDS, dtype=np.uint64), (rows, 1))
            for k in range(BAND_ROWS):
                key = (key ^ sign[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out += [k if some else [] for some, k in zip(counts.tolist(), key.view(np.int64), strict=True)]
        columns = [pa.array(cids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, names=["cid", "n", "bands"])

    return signed


def near_copies(docs: DataFrame, percent: int = 75, text: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest doc_id that verified links reach) of documents whose component has a smaller id.

    Texts that share a band are candidates, whose whole shingle sets are compared; a pair at the limit meets in no band with
    a chance of about 1 in 9,000 (24 bands of 4 rows). Equal texts are linked; texts without words and null ids are left
    out; rows that repeat an id are one document."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    with temporary(docs.sparkSession):
        signed = written(rows.select("doc_id", "key", signed_udf(WORDS)("text").alias("s")).select("doc_id", "key", "s.*"))
        ids = signed.where("n > 0")
        # of equal sets one, with a row that has it
        one = written(ids.groupBy("cid").agg(F.min(F.struct("doc_id", "key")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands")))
        met = one.select("cid", "n", "row.*", F.explode("bands").alias("band"))
        shared = written(met.groupBy("band").agg(F.count("*").alias("times")).where("times > 1").select("band"))
        maybe, _ = split_by(met, shared, ["band"], once=True)
        met = written(salted_join(maybe, shared, ["band"], "cid", "inner"))
        texts, _ = split_by(rows, met, ["doc_id", "key"], once=True)
        texts = texts.join(met.select("doc_id", "key", "cid").distinct(), ["doc_id", "key"])
        sets = texts.select("cid", sets_udf(WORDS)("text")["shingles"].alias("shingles"))
        classes = written(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")).withColumn("n", F.size("shingles")))
        lists = met.select(F.col("band").alias("key"), "cid", "n", F.lit(True).alias("heavy"))
        found = links(classes, percent, hub_rounds=1, lists=lists)
        twin = ids.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z")
        twins = ids.join(twin.select("doc_id", "a"), "doc_id").select("a", F.col("cid").alias("b")).distinct()
        groups = connected(found.union(twins))
        placed = salted_join(ids.select("doc_id", "cid"), groups.withColumnRenamed("node", "cid"), ["cid"], "doc_id", "left")
        placed = written(placed.withColumn("component", F.coalesce("component", "cid")))
        least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("most")).where("component_id < most").drop("most")
        out = salted_join(placed, least, ["component"], "doc_id", "inner").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        return lasting(out.where("component_id < doc_id"))
