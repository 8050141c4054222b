"""N-gram Jaccard join: a size-aware heavy-light join of documents' sets of word shingles.

Exact: all links of two texts with 100 * |A and B| >= percent * |A or B| count. What the stages drop cannot be in a link.

1. Repeats. Each task takes the lower half, by hash, of its texts' shingles; those that are once in its chunk go, as packed
   40-bit remainders by bucket, to the bucket's group, which finds those that other chunks have too. Linked sets share a
   quarter of their size in their lower halves at least, so most documents end here with nothing but counts moved.
2. Of equal texts among the rest one stays. Its shingles are ordered by hash, but those that very many documents have come
   last: a bounded list of the most frequent ones, which the buckets' groups count.
3. Candidates. Two linked sets share at least k shingles in prefixes of n - ceil(share * n) + k. Light sets, up to a
   boundary, enumerate the pairs (k = 2) of their prefix and meet where they share one; heavy sets stand in the inverted
   lists of their prefix (k = 1), which are scanned for all pairs with a heavy set. The boundary is the size at which
   enumerating and scanning together cost least. Shingles of one prefix only take no part.
4. Links. A list is not turned into all its pairs: its members are compared to a hub, then those outside of the hub's
   component to another member of it; what is left are the pairs between components, by size. Such a pair is made in one of
   the longest lists that it shares only, and not at all if parity bitmaps differ in more bits than linked sets can differ
   in shingles. Candidates are verified on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .storage import lasting, salted_join, split_by, temporary, written
from .text import distinct_grams, encoded, parts, rested, resting, slices

WORDS, PERCENT = 5, 75
#: Shingles of the texts that a task holds at once; mean packed entries of a bucket; rounds with hubs.
CHUNK, BUCKET, HUB_ROUNDS = 400_000, 400_000, 2
#: Documents that a frequent shingle has at least, and how many such shingles are held: the most frequent ones.
FREQUENT, MOST_FREQUENT = 16, 1 << 20
#: Times that a place in a list is gone through, as hubs spare all pairs of a list.
SCANS = 3
#: Words of 64 bits in a set's parity bitmap; of a set's open lists, how many of the longest spare their pairs the others.
PARITY_WORDS, LONGEST = 16, 16
SEVERAL = np.uint32(1 << 31)
LOW = np.uint64((1 << 40) - 1)
PACKED = "kind int, bucket int, chunk string, rest binary, owner binary, ids array<long>, keys array<long>, sizes array<int>, known array<int>"


def packed_shingles(batches: Iterator[pa.RecordBatch], n: int, buckets: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED from rows of (doc_id, key, text): for each chunk one of kind 0 with its documents, and for each
    bucket one of kind 1: shingles of the chunk, by hash remainder, with the document's place; from 2**31 on it is the
    number of several documents of the chunk, in which the shingle is repeated anyway."""
    from pyspark import TaskContext

    part, count = TaskContext.get().partitionId(), 0
    shift = np.uint64(40)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    ids: list[int | None] = []
    keys: list[int] = []
    counts: list[np.ndarray] = []
    total = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, ids, keys, counts, total, count
        chunk = f"{part}-{count}"
        hashes = np.concatenate([h for h, _ in held]) if held else np.empty(0, dtype=np.uint64)
        owner = np.concatenate([o for _, o in held]) if held else np.empty(0, dtype=np.int64)
        sizes = np.concatenate(counts)
        bucket = ((hashes >> shift) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint64) << shift | (hashes & LOW), kind="stable")
        bucket, rest, who = bucket[order], (hashes & LOW)[order], owner[order].astype(np.uint32)
        first = np.ones(len(rest), dtype=bool)
        first[1:] = (rest[1:] != rest[:-1]) | (bucket[1:] != bucket[:-1])
        last = np.append(first[1:], True)
        known = np.bincount(who[~(first & last)], minlength=len(ids))
        begins = np.flatnonzero(first)
        many = np.diff(np.append(begins, len(rest)))
        who = np.where(many == 1, who[begins], SEVERAL | many.astype(np.uint32))
        bucket, rest = bucket[first], rest[first]
        yield _packed(0, -1, chunk, b"", b"", ids, keys, sizes.tolist(), known.tolist())
        own, cuts = np.unique(bucket, return_index=True)
        cuts = np.append(cuts, len(bucket))  # a chunk of texts without words has no bucket
        for b, begin, end in zip(own.tolist(), cuts[:-1], cuts[1:], strict=True):
            planes = np.ascontiguousarray(rest[begin:end].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T)
            yield _packed(1, b, chunk, planes.tobytes(), np.ascontiguousarray(who[begin:end].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), [], [], [], [])
        held, ids, keys, counts, total, count = [], [], [], [], 0, count + 1

    for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
        texts, doc_ids, text_keys = encoded(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
        for s in slices(texts):
            hashes, owner = distinct_grams(texts[s], n)
            size = np.bincount(owner, minlength=s.stop - s.start)
            place = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
            low = place < half(size, percent)[owner]
            hashes, owner = hashes[low], owner[low]
            counts.append(size)
            held.append((hashes, owner + len(ids)))
            ids += doc_ids[s]
            keys += text_keys[s]
            total += len(hashes)
            if total >= CHUNK:
                yield from flush()
    if ids:
        yield from flush()
    rested()


def half(n, percent: int):
    """Shingles of the lower half that repeats are looked for in; the whole prefix that links need at least."""
    return np.maximum((n + 1) // 2, n - (n * percent + 99) // 100 + 1)


def repeated_at_least(n: Column, percent: int) -> Column:
    """Shingles that a set of n shares with any linked set within the lower halves of both, at least. Of I shared shingles, in
    one order, at most n - lower(n) stand after the own lower half, where I >= required(n), and at most a / 2 after that of a
    linked set of a, where I - a / 2 falls with a to n - 50 * n / percent at the largest a. Prefixes share one always."""
    need = required(n, percent)
    lower = F.greatest(F.floor((n + 1) / 2), n - need + 1)
    return F.greatest(F.lit(1), F.least(lower - n + need, F.ceil(n * (percent - 50) / percent)))


def _packed(kind, bucket, chunk, rest, owner, ids, keys, sizes, known) -> pa.RecordBatch:
    big, small = pa.list_(pa.int64()), pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([chunk], pa.string()), pa.array([rest], pa.binary()), pa.array([owner], pa.binary()), pa.array([ids], big), pa.array([keys], big), pa.array([sizes], small), pa.array([known], small)],
        names=["kind", "bucket", "chunk", "rest", "owner", "ids", "keys", "sizes", "known"],
    )


def _repeats(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, the places of documents with a shingle that another chunk has, and how many."""
    chunks = table.column("chunk").to_pylist()
    rest, who = [], []
    for r, o in zip(table.column("rest").to_pylist(), table.column("owner").to_pylist(), strict=True):
        n = len(o) // 4
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(r, dtype=np.uint8).reshape(5, n).T
        rest.append(wide.view("<u8").ravel())
        who.append(np.ascontiguousarray(np.frombuffer(o, dtype=np.uint8).reshape(4, n).T).view("<u4").ravel())
    source = np.repeat(np.arange(len(rest)), [len(r) for r in rest])
    every, place = np.concatenate(rest), np.concatenate(who)
    order = np.argsort(every, kind="stable")
    ordered, docs_of = every[order], np.where(place[order] >= SEVERAL, place[order] ^ SEVERAL, 1).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    chunks_of, df = np.diff(np.append(begins, len(ordered))), np.add.reduceat(docs_of, begins)
    at = order[np.repeat(chunks_of > 1, chunks_of)]
    at = at[place[at] < SEVERAL]
    often = df >= FREQUENT
    out = []
    for c in np.unique(source[at]):
        docs, n = np.unique(place[at[source[at] == c]], return_counts=True)
        out.append((chunks[c], docs.astype(np.int64), n.astype(np.int32)))
    bucket = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(40)
    out.append(("", (bucket | ordered[begins][often]).view(np.int64), df[often].astype(np.int32)))
    return pa.table(
        {
            "kind": pa.array([1] * (len(out) - 1) + [2], pa.int32()),
            "chunk": pa.array([x[0] for x in out], pa.string()),
            "ids": pa.array([x[1] for x in out], pa.list_(pa.int64())),
            "keys": pa.array([[] for _ in out], pa.list_(pa.int64())),
            "sizes": pa.array([[] for _ in out], pa.list_(pa.int32())),
            "known": pa.array([x[2] for x in out], pa.list_(pa.int32())),
        }
    )


def _summed(table: pa.Table) -> pa.Table:
    """Of one chunk: its documents with their number of shingles and of repeated shingles."""
    rows = table.to_pylist()
    (docs,) = [r for r in rows if r["kind"] == 0]
    known = np.array(docs["known"], dtype=np.int64)
    for r in rows:
        if r["kind"] == 1:
            known[np.array(r["ids"])] += np.array(r["known"])
    return pa.table({"doc_id": pa.array(docs["ids"], pa.int64()), "key": pa.array(docs["keys"], pa.int64()), "n_shingles": pa.array(docs["sizes"], pa.int64()), "n_repeated": pa.array(known, pa.int64())})


def shingle_counts(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, Frequent]:
    """For each row of docs (doc_id, text) its doc_id, key (a hash of the text), n_shingles and n_repeated: shingles of the
    lower half that another row has too (a few more by collisions of hash remainders, never fewer). And the frequent ones."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, int(chars / 12 / BUCKET))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    packed = rows.mapInArrow(lambda batches: packed_shingles(batches, n, buckets, percent), PACKED)
    parts = "kind int, chunk string, ids array<long>, keys array<long>, sizes array<int>, known array<int>"
    split = F.when(F.col("kind") == 0, F.concat(F.lit("c"), "chunk")).otherwise(F.concat(F.lit("b"), F.col("bucket").cast("string")))

    def one(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 0:
            return table.select(["kind", "chunk", "ids", "keys", "sizes", "known"])
        out = _repeats(table)
        rested()
        return out

    found = written(packed.groupBy(split).applyInArrow(one, parts))
    counts = found.where("kind < 2").groupBy("chunk").applyInArrow(_summed, "doc_id long, key long, n_shingles long, n_repeated long")
    often = found.where("kind = 2").select(F.explode(F.arrays_zip("ids", "known")).alias("x")).select(F.col("x.ids").alias("sign"), F.col("x.known").alias("df"))
    steps = {r["s"]: r["n"] for r in often.groupBy(F.floor(F.log2("df")).alias("s")).agg(F.count("*").alias("n")).collect()}  # a row for each power of 2
    least, total = 64, 0
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > MOST_FREQUENT:
            break
        least = step
    held = often.where(F.col("df") >= float(2**least)).toArrow()
    signs, df = held.column("sign").to_numpy().view(np.uint64), held.column("df").to_numpy()
    order = np.argsort(signs)
    return counts, Frequent(signs[order], df[order], buckets)


class Frequent(NamedTuple):
    """Signs of at most MOST_FREQUENT shingles, in order: their hashes' buckets and remainders; and their documents."""

    signs: np.ndarray
    df: np.ndarray
    buckets: int

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The documents of each shingle, 0 for those that are not frequent."""
        if not len(self.signs):
            return np.zeros(len(hashes), dtype=np.int64)
        sign = ((hashes >> np.uint64(40)) % np.uint64(self.buckets)) << np.uint64(40) | (hashes & LOW)
        at = np.minimum(np.searchsorted(self.signs, sign), len(self.signs) - 1)
        return np.where(self.signs[at] == sign, self.df[at], 0).astype(np.int64)


def prefixed_udf(n: int, percent: int, frequent):
    """struct<shingles, prefix> of texts: the distinct shingles by hash, and the prefix (k = 2) with frequent ones last, by df."""

    @F.arrow_udf("shingles array<long>, prefix array<long>")
    @resting
    def sets(texts: pa.Array) -> pa.Array:
        held, known = encoded(texts), frequent.value
        lists: list[np.ndarray] = []
        prefixes: list[np.ndarray] = []
        for s in slices(held):
            hashes, owner = distinct_grams(held[s], n)
            df = known.of(hashes)
            cuts = np.searchsorted(owner, np.arange(1, s.stop - s.start))
            for part, often in zip(np.split(hashes, cuts), np.split(df, cuts), strict=True):
                length = min(len(part), len(part) - (len(part) * percent + 99) // 100 + 2)
                lists.append(part.view(np.int64))
                prefixes.append(part[np.argsort(often, kind="stable")][:length].view(np.int64))
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(lists, kind), pa.array(prefixes, kind)], names=["shingles", "prefix"])

    return sets


def set_id(hashes: np.ndarray) -> int:
    """A hash of a set of hashes in ascending order."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets_udf(n: int):
    """struct<cid, shingles> of texts: the distinct shingles by hash, and a hash of them all."""

    @F.arrow_udf("cid long, shingles array<long>")
    @resting
    def sets(texts: pa.Array) -> pa.Array:
        held, cids, lists = encoded(texts), [], []
        for s in slices(held):
            hashes, owner = distinct_grams(held[s], n)
            for part in np.split(hashes, np.searchsorted(owner, np.arange(1, s.stop - s.start))):
                cids.append(set_id(part))
                lists.append(part.view(np.int64))
        return pa.StructArray.from_arrays([pa.array(cids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["cid", "shingles"])

    return sets


def linked_udf(percent: int):
    """Whether two arrays of distinct values in unsigned order are linked."""

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    return linked


def parity_udf():
    """struct<p0, ...> of arrays of distinct values: for each bit, whether an odd number of the values fall on it. The bitmaps of
    two sets differ in as many bits as the sets differ in values, or fewer."""
    bits = PARITY_WORDS * 64

    @F.arrow_udf(", ".join(f"p{k} long" for k in range(PARITY_WORDS)))
    def parity(sets: pa.Array) -> pa.Array:
        out = [np.empty((0, PARITY_WORDS), dtype=np.int64)]
        for some in parts(sets, 512):
            place = some.flatten().to_numpy().view(np.uint64) % np.uint64(bits)
            owner = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy())
            odd = np.bincount(owner * bits + place.astype(np.int64), minlength=len(some) * bits) & 1
            out.append(np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64))
        every = np.concatenate(out)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, k])) for k in range(PARITY_WORDS)], names=[f"p{k}" for k in range(PARITY_WORDS)])

    return parity


def pairs_between(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, nx, y, ny) of different components that share a list, without those that parity bitmaps rule out. members:
    key, size (of the list), cid, n, heavy, component. A pair may come from several lists that are not among the longest."""
    own = F.struct("size", "key")
    # of one set's lists, all of which its prefix names
    named = members.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("size", "key", "heavy")), asc=False), 1, LONGEST).alias("named"))
    before = F.filter("named", lambda t: (F.struct(t["size"].alias("size"), t["key"].alias("key")) > own) & (t["heavy"] | ~F.col("heavy")))
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * 1.001)).cast("int")
    rows = members.join(named, "cid").join(classes.select("cid", parity_udf()("shingles").alias("bits")), "cid")
    rows = written(rows.select("key", "cid", "n", "heavy", "component", step.alias("step"), F.transform(before, lambda t: t["key"]).alias("before"), "bits.*"))
    # sizes of linked sets are in the same or the next step; both sides are the same rows, which are shuffled once for both
    rows = rows.withColumn("next", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("step", F.col("step") - F.col("next").cast("int"))
    left, right = (rows.withColumnsRenamed({c: f"{side}_{c}" for c in rows.columns if c not in ("key", "step")}) for side in "xy")
    differ = sum((F.bit_count(F.col(f"x_p{k}").bitwiseXOR(F.col(f"y_p{k}"))) for k in range(PARITY_WORDS)), F.lit(0))
    once = F.struct("x_next", "x_cid") < F.struct("y_next", "y_cid")
    pairs = left.join(right, ["key", "step"]).where("x_component <> y_component AND NOT (x_next AND y_next) AND (x_heavy OR y_heavy)").where(once)
    pairs = pairs.where(differ * (100 + percent) <= (F.col("x_n") + F.col("y_n")) * (100 - percent)).where(~F.arrays_overlap("x_before", "y_before"))
    return pairs.select(F.col("x_cid").alias("x"), F.col("x_n").alias("nx"), F.col("y_cid").alias("y"), F.col("y_n").alias("ny"))


def required(n: Column, percent: int) -> Column:
    """ceil(percent * n / 100): what a set of n shares with a linked set at least."""
    return F.floor((n * percent + 99) / 100).cast("int")


def boundary(prefixes: DataFrame, percent: int) -> int:
    """The largest light size: of the powers of 1.25, the one at which enumerating and scanning together cost least.
    prefixes: n, q1 and q2 (shingles in the prefixes that other sets have), scan (places in lists that are gone through)."""
    step = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(float(np.log(1.25)))).cast("int")
    by = {r["s"]: (r["light"], r["heavy"]) for r in prefixes.groupBy(step.alias("s")).agg(F.sum(F.col("q2") * (F.col("q2") - 1) / 2).alias("light"), F.sum("scan").alias("heavy")).collect()}  # a row for each power of 1.25
    slack = int(np.ceil(np.log(100 / percent) / np.log(1.25)))
    costs = {b: sum(x for s, (x, _) in by.items() if s <= b) + sum(y for s, (_, y) in by.items() if s > b - slack) for b in [-1, *by]}
    best = min(costs, key=lambda b: (costs[b], b))
    return int(1.25 ** (best + 1)) if best >= 0 else 0


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Lists of sets that may be linked: key, cid, n, heavy. classes: cid, n, shingles in one order for all sets, prefix (by
    default the first shingles). Every linked pair of classes shares a list."""
    with temporary(classes.sparkSession):
        need = required(F.col("n"), percent)
        prefix = F.col("prefix") if "prefix" in classes.columns else F.slice("shingles", 1, F.least(F.col("n"), F.col("n") - need + 2).cast("int"))
        each = classes.select("cid", "n", F.posexplode(prefix).alias("place", "shingle"))
        df = written(each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
        shared = each.join(df, "shingle")  # a set has a shingle once, so no key has more than a set's share of the rows
        ordered = shared.groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("place", "shingle", "df"))).alias("s"))  # one set's prefix
        first = F.size(F.filter("s", lambda x: x["place"] <= F.col("n") - need))
        sized = ordered.withColumn("q1", first).withColumn("q2", F.size("s")).withColumn("need", need)
        sized = written(sized.withColumn("scan", F.col("q1") * SCANS))
        light = boundary(sized, percent)
        lists = sized.where(F.col("n") * 100 >= F.lit(light * percent) if light else F.lit(True))
        lists = lists.select(F.explode(F.slice("s", 1, F.col("q1"))).alias("t"), "cid", "n", (F.col("n") > light).alias("heavy")).select(F.xxhash64(F.lit("list"), "t.shingle").alias("key"), "cid", "n", "heavy")
        small = sized.where((F.col("n") <= light) & (F.col("need") >= 2)).select("cid", "n", F.slice("s", 1, F.col("q2")).alias("p"))
        subsets = small.select("cid", "n", F.posexplode("p").alias("i", "x"), "p").select("cid", "n", "x", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("y"))
        subsets = subsets.select(F.xxhash64(F.lit("pair"), F.least("x.shingle", "y.shingle"), F.greatest("x.shingle", "y.shingle")).alias("key"), "cid", "n", F.lit(True).alias("heavy"))
        ones = sized.where((F.col("n") <= light) & (F.col("need") < 2)).select(F.explode(F.slice("s", 1, F.col("q1"))).alias("t"), "cid", "n").select(F.xxhash64(F.lit("one"), "t.shingle").alias("key"), "cid", "n", F.lit(True).alias("heavy"))
        return lasting(lists.union(subsets).union(ones))


def links(classes: DataFrame, percent: int = PERCENT, hub_rounds: int = HUB_ROUNDS, lists: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between class ids that join exactly the classes that chains of links join. classes: cid, n, shingles.
    lists: where links are looked for, by default `candidates`."""
    lists = candidates(classes, percent) if lists is None else lists
    linked = linked_udf(percent)
    tested = edges = None
    members = lists.withColumn("component", F.col("cid"))
    for turn in range(hub_rounds + 1):
        with temporary(classes.sparkSession):  # what shuffles hold goes before links are verified
            pairs = _pairs(members, classes, percent, turn, turn < hub_rounds)
            if pairs is None:
                break
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = lasting(pairs)
        with temporary(classes.sparkSession):
            ends = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
            sets, _ = split_by(classes.select("cid", "shingles"), ends, ["cid"], once=True)
            both = pairs.join(sets.withColumnsRenamed({"cid": "a", "shingles": "sa"}), "a")
            both = both.join(sets.withColumnsRenamed({"cid": "b", "shingles": "sb"}), "b")
            found = lasting(both.where(linked("sa", "sb")).select("a", "b"))
        tested = pairs if tested is None else tested.union(pairs)
        edges = found if edges is None else edges.union(found)
        if turn < hub_rounds:
            groups = connected(edges)
            edges = groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))  # joins the same
            with temporary(classes.sparkSession):
                members = lists.join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
                members = lasting(members)
    return edges if edges is not None else classes.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0)


def _pairs(members: DataFrame, classes: DataFrame, percent: int, turn: int, hubs: bool) -> DataFrame | None:
    """Distinct pairs (a, b) of different components and near sizes that a list has with its hub, or if no hubs are asked for
    all such pairs. None if no list has several components. members: key, cid, n, heavy, component."""
    least = F.min("component")
    if hubs:  # at first one hub for all lists of a group, then another member of its component in each list
        draw = [] if turn == 0 else [F.xxhash64(F.lit(turn), "cid", "key").alias("h")]
        least = F.min(F.struct("component", *draw, "cid", "n", "heavy"))
    # lists with several components and a heavy set (all lists of subsets count as such), but not two sets of far sizes
    mixed = members.groupBy("key").agg(least.alias("least"), F.max("component").alias("most"), F.max("heavy").alias("any"), F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    mixed = mixed.where(F.col("least.component" if hubs else "least") != F.col("most")).where("any").where((F.col("size") > 2) | (F.col("low") * 100 >= F.col("high") * percent))
    mixed = written(mixed.select("key", F.col("least").alias("hub") if hubs else "size"))
    if mixed.isEmpty():
        return None
    open_ = members.join(mixed, "key")  # both sides are tables, so Spark can split a long list
    if hubs:
        pairs = open_.where(F.col("component") != F.col("hub.component")).where(F.col("heavy") | F.col("hub.heavy"))
        pairs = pairs.select(F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("hub.cid").alias("y"), F.col("hub.n").alias("ny"))
    else:
        pairs = pairs_between(open_, classes, percent)
    close = (F.least("nx", "ny") * 100) >= F.greatest("nx", "ny") * percent
    return pairs.where(close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach, itself included) for each row of docs.

    Every row stays. Null and empty texts, and texts without words, have no shingles and link with nothing; texts of fewer
    than n words are one shingle; equal sets are linked. Rows that repeat a doc_id are one document: they share its
    component. A null doc_id links with nothing and has a null component. An empty table stays empty; other columns are
    not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with temporary(docs.sparkSession):
        counts, named = _joined(rows, n, percent)
    return counts.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _joined(rows: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id and n_shingles of each row; and component_id of each doc_id that may have a link."""
    counts, frequent = shingle_counts(rows, n, percent)
    counts = lasting(counts)
    size = F.col("n_shingles")
    some = counts.where((F.col("n_repeated") >= repeated_at_least(size, percent)) & (size > 0) & F.col("doc_id").isNotNull())
    some = written(some.select("doc_id", F.col("key"), F.col("n_shingles").cast("int").alias("n")))
    ids = some.select("doc_id", F.col("key").alias("cid")).distinct()
    one = some.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))  # of equal texts
    keyed, _ = split_by(rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))), one, ["doc_id", "key"])
    texts = keyed.join(one, ["doc_id", "key"])
    if not some.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["key"])
    held = rows.sparkSession.sparkContext.broadcast(frequent)
    classes = written(texts.withColumn("s", prefixed_udf(n, percent, held)("text")).select(F.col("key").alias("cid"), "n", "s.*"))
    found = links(classes, percent)
    twin = ids.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z"), F.count("*").alias("times")).where("times > 1")
    twins = ids.join(twin.select("doc_id", "a"), "doc_id").select("a", F.col("cid").alias("b"))
    own = ids.select(F.col("cid").alias("a"), F.col("cid").alias("b")).distinct()
    groups = connected(found.union(twins).union(own))
    placed = salted_join(ids, groups.withColumnRenamed("node", "cid"), ["cid"], "doc_id", "inner")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = salted_join(placed, least, ["component"], "doc_id", "inner").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return counts.select("doc_id", "n_shingles"), lasting(named)


def oracle_sql(n: int, percent: int, kept: bool = False) -> str:
    """DuckDB SQL over documents with an id each: shared shingles of all pairs that have one, and what links reach."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= {percent} * (x.n + y.n - both_have)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{", doc_id = component_id AS kept" if kept else ""} FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def one_each(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all their columns; of rows that repeat an id one,
    that with the least text by hash. Rows without an id stay. Only rows whose id goes or is repeated are shuffled, and few
    others (`split_by`)."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    with temporary(docs.sparkSession):
        found = join(docs, text=text, **how).where("doc_id IS NOT NULL")
        odd = found.groupBy("doc_id").agg(F.min("component_id").alias("__least"), F.count("*").alias("__times"))
        odd = lasting(odd.where("__least <> doc_id OR __times > 1").withColumnRenamed("doc_id", "__id"))
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long"))
    maybe, others = split_by(keyed, odd, ["__id"])
    maybe = maybe.join(odd, "__id", "left")
    single = maybe.where("__times IS NULL").select(*columns)
    repeated = maybe.where("__least = __id").groupBy("__id").agg(F.min_by(F.struct(*columns), F.xxhash64(F.col(f"`{text}`"))).alias("__row"))
    return others.select(*columns).union(single).union(repeated.select("__row.*"))
