"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document has the key -ln(u) / weight, with u from a hash of its id and weight from its quality: the smallest keys
are a weighted sample without replacement. A source takes whole passes over its documents first (epochs); the rest of
its target is the prefix of its documents, by key, whose size is nearest to what is left.

No source is sorted whole. The keys of each source are cut in `buckets` ranges, sizes are summed by source and range, and
the range in which the source's budget ends is cut again, until it has SORTED rows at most; only these are sorted. What
decides for a document is then one row for its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import salted_join, written

WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters, with a full stop or comma at most, before white space.
PLAIN_WORD = r"\p{L}+[.,]?[\x20\x09-\x0D]"
BUCKETS = 1024
#: Rows of a source's last range, which are sorted in one task.
SORTED = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: Column, size: Column) -> Column:
    """Quality weight, 0.05 to 1: the share of plain words."""
    plain = F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)), F.lit(0))
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), plain / F.greatest(size, F.lit(1))))


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """Above 0, up to 1: from 52 bits of a hash of the id's text."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Adds target to rows of source, no_source and source_size: shares of the total by weight, stopped at `most` times the
    size, the excess dealt again by weight. With sources by cap / weight ascending, the first k stop; the others get their
    weight times the level of water that is left. One row a source, so the ordering is of sources only."""
    by_name = Window.orderBy("no_source", "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    ranked = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", "no_source", "source")
    everyone = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everyone) - before) / left
    stops = ranked.withColumn("level", level)
    found = stops.withColumn("water", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "no_source", "source", "level"))).over(everyone)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")))
    return found.select("source", "no_source", "source_size", target.alias("target"))


def _narrowed(small: DataFrame, ends: DataFrame, own: list[str], buckets: int) -> DataFrame:
    """Of each source's range from low to high, the part in which the budget ends: low, high, n (rows), and before: the size
    of all keys below. A source whose budget takes nothing, as it has no size, goes."""
    inside = salted_join(small, ends.drop("n"), own, "id", "inner", few=True).where("key BETWEEN low AND high")
    bucket = F.when(F.col("high") > F.col("low"), F.least(F.lit(buckets - 1), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * buckets))).otherwise(0)
    parts = inside.groupBy(*own, "budget", "before", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    reached = F.col("before") + F.sum("size").over(Window.partitionBy(*own).orderBy("bucket"))  # at most `buckets` rows a source
    parts = parts.withColumn("reached", reached).withColumn("before", F.col("reached") - F.col("size"))
    return written(parts.where("before <= budget AND budget < reached").select(*own, "budget", "before", "low", "high", "n"))


def mix(docs: DataFrame, size: Column, weight: Column, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, buckets: int = BUCKETS, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", prefix: str = "") -> DataFrame:
    """Adds size, source_size, target and taken (words that the mix takes of the document: its size times 0 to `most`), their
    names after `prefix`.

    Every row stays. Sources go by code point, null last and a source of its own; empty texts have size 0 and take 0; rows
    that repeat an id share its key and are taken alike, a null id counts as the text ''; an empty table stays empty;
    columns of the added names are replaced, others pass. Reruns agree: nothing depends on the order of rows."""
    host = F.col(f"`{source}`")
    key = -F.log(uniform(F.col(f"`{doc_id}`"), seed)) / weight
    rows = docs.withColumns({"__mix_size": size.cast("long"), "__mix_key": key, "__mix_id": F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), "__mix_source": F.coalesce(host, F.lit("")), "__mix_no_source": host.isNull()})
    own = ["source", "no_source"]
    small = written(rows.select(*[F.col(f"__mix_{c}").alias(c) for c in (*own, "key", "id", "size")]))
    plan = small.groupBy(*own).agg(F.sum("size").alias("source_size"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    plan = written(plan)  # one row a source
    goals = targets(plan.drop("low", "high", "n"), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = written(goals.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    ends = plan.join(goals.select(*own, "budget"), own).withColumn("before", F.lit(0).cast("long"))
    ends = _narrowed(small, ends.select(*own, "budget", "before", "low", "high", "n"), own, buckets)
    while not ends.where(F.col("n") > SORTED).where("low < high").isEmpty():
        ends = _narrowed(small, ends, own, buckets)

    last = salted_join(small, ends, own, "id", "inner", few=True).where("key BETWEEN low AND high").groupBy(*own, "key", "id", "before", "budget").agg(F.sum("size").alias("size"))
    up_to = F.col("before") + F.sum("size").over(Window.partitionBy(*own).orderBy("key", "id"))
    place = F.struct(F.abs(up_to - F.col("budget")).alias("off"), "key", "id")
    best = last.select(*own, place.alias("place")).groupBy(*own).agg(F.min("place").alias("best"))
    taken = F.col("best.off") < F.abs(F.col("before") - F.col("budget"))  # else nothing of the last range is nearer
    best = ends.join(best, own).select(*own, "low", F.when(taken, F.col("best.key")).alias("end_key"), F.when(taken, F.col("best.id")).alias("end_id"))
    plan = goals.join(best, own, "left").select(*[F.col(c).alias(f"__mix_{c}") for c in (*own, "source_size", "target", "epochs", "low", "end_key", "end_id")])

    c = {x: F.col(f"__mix_{x}") for x in ("key", "id", "size", "source_size", "target", "epochs", "low", "end_key", "end_id")}
    chosen = (c["key"] < c["low"]) | (c["key"] < c["end_key"]) | ((c["key"] == c["end_key"]) & (c["id"] <= c["end_id"]))
    out = salted_join(rows, written(plan), ["__mix_source", "__mix_no_source"], "__mix_id", "inner", few=True)  # of a few sources broadcast by Spark
    out = out.withColumns({f"{prefix}size": c["size"], f"{prefix}source_size": c["source_size"], f"{prefix}target": c["target"], f"{prefix}taken": c["size"] * (c["epochs"] + F.coalesce(chosen, F.lit(False)).cast("int"))})
    inner = [f"__mix_{x}" for x in (*own, "key", "id", "size", "source_size", "target", "epochs", "low", "end_key", "end_id")]
    return out.drop(*[x for x in inner if x not in (f"{prefix}{y}" for y in ("size", "source_size", "target"))])


def repeated(mixed: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the given columns only."""
    size, taken = F.col(f"{prefix}size"), F.col(f"{prefix}taken")
    times = F.when(size > 0, taken / size).otherwise(0).cast("int")
    return mixed.where(taken > 0).withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*columns)


#: The same in DuckDB SQL; documents is the input.
ORACLE_SQL = r"""
WITH raw AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         len(regexp_extract_all(coalesce(text, ''), '\p{L}+[.,]?[\x20\x09-\x0D]')) AS plain,
         (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0 AS u
  FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln(u) / greatest(0.05::DOUBLE, least(1.0::DOUBLE, plain::DOUBLE / greatest(size, 1))) AS k FROM raw),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight,
         source_size * 3 AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS fill,
         ((SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
water AS (
  SELECT level FROM levels WHERE level <= fill ORDER BY fill, source NULLS LAST LIMIT 1),
plan AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT level FROM water) * weight), cap::DOUBLE) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM plan),
ordered AS (
  SELECT d.doc_id, d.source, d.size, d.k, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id::VARCHAR) AS up_to
  FROM keyed d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source),
ends AS (
  SELECT source, min(budget) AS none_off, min(struct_pack(off := abs(up_to - budget), k := k, id := doc_id::VARCHAR)) AS best
  FROM ordered GROUP BY source)
SELECT o.doc_id, o.size, o.source_size, o.target,
       (o.size * (o.epochs + CASE WHEN e.best.off < e.none_off AND (o.k < e.best.k OR (o.k = e.best.k AND o.doc_id::VARCHAR <= e.best.id)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered o JOIN ends e ON o.source IS NOT DISTINCT FROM e.source
"""
