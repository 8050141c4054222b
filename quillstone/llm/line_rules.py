"""Quality rules: cross-document line frequency.

Lines are normalised (white space runs as one space, trimmed, lower case) and hashed; for each host the distinct
documents with a line are counted; lines above the limit are removed, and a document that loses more than a share of its
words is rejected as depleted. Beside that stand rules on a document's own text.

Equal texts of a host are taken through once, with the number of documents that have them. Texts themselves are shuffled
only where lines are removed from them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import lasting, salted_join, split_by, temporary, written
from .text import SPACE, encoded, grams, parts, resting, slices, words

#: Distinct documents of a host that may have a line, and the share of words that a document may lose.
LINE_LIMIT, LOST_SHARE = 20, 0.8
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[*b"#*$%&|<>"]] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_stats(texts: list[bytes]) -> np.ndarray:
    """Rows of STATS."""
    w = words(texts, fold=None)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], ends[:-1]])

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[ends] - sums[starts]

    letters = count(~SPACE[w.data] & ((w.data & 0xC0) != 0x80))
    symbols = count(SYMBOL[w.data])
    dup = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dup[i] = len(lines) - len(set(lines))
    hashes, owner = grams(w, 3)
    full = (w.counts >= 3)[owner]
    at = np.flatnonzero(full)
    key = (hashes[at] ^ (owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if len(at) else np.empty(0, dtype=np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    begin = at[twice] - np.concatenate([[0], np.cumsum(np.where(w.counts >= 3, w.counts - 2, (w.counts > 0)))])[:-1][owner[at[twice]]] + w.first[:-1][owner[at[twice]]]
    covered = np.zeros(len(w.begin) + 3, dtype=bool)
    for k in range(3):
        covered[begin + k] = True
    sums = np.concatenate([[0], np.cumsum(covered[: len(w.begin)])])
    return np.stack([w.counts, letters, symbols, dup, sums[w.first[1:]] - sums[w.first[:-1]]], axis=1)


def stats_udf():
    """struct<STATS> of a text column."""

    @F.arrow_udf(", ".join(f"{x} long" for x in STATS))
    @resting
    def stats(texts: pa.Array) -> pa.Array:
        found = [text_stats(held[s]) for some in parts(texts) for held in [encoded(some)] for s in slices(held)]
        rows = np.concatenate([np.zeros((0, len(STATS)), dtype=np.int64), *found])
        return pa.StructArray.from_arrays([pa.array(rows[:, i].astype(np.int64)) for i in range(len(STATS))], names=STATS)

    return stats


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09\x0B-\x0D]+", " "))


def lines_of(text: Column) -> Column:
    """Lines with a word: hash of the normalised line, and its words."""
    made = F.transform(F.split(normalised_lines(text), "\n"), lambda x: F.struct(F.xxhash64(x).alias("line"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("words")))
    return F.filter(made, lambda x: x["words"] > 0)


def normalised_lines(text: Column) -> Column:
    """The text with every line as `normalised` has it, in a few passes over the whole text; empty lines may be added."""
    one_space = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.regexp_replace(one_space, r" ?\n ?|^ | \z", "\n")


def without_lines(text: Column, bad: Column) -> Column:
    """The text without the lines whose hashes are in the array."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(bad, F.xxhash64(normalised(x)))), "\n")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def host_of(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("null"))


def judged(docs: DataFrame, line_limit: int = LINE_LIMIT, lost_share: float = LOST_SHARE, text: str = "text", host: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables. Rows: doc_id, host, key (of the text), STATS. Above: host, key and line above the limit. Lost: host, key,
    lost_words of texts with such lines, and depleted: whether they are more than the share of the text's words.

    Documents are told apart by doc_id. Rows that repeat an id and a text are one; an id with several texts counts for each
    of them; rows without an id are one document for each text."""
    body = F.col(f"`{text}`")
    with temporary(docs.sparkSession):
        rows = lasting(docs.select("doc_id", host_of(host).alias("host"), text_key(body).alias("key"), stats_udf()(body).alias("s"), lines_of(body).alias("lines")).select("doc_id", "host", "key", "s.*", "lines"))
        texts = rows.groupBy("host", "key").agg(F.first("lines").alias("lines"), F.first("n_words").alias("n_words"))
        having = rows.select("host", "key", "doc_id").distinct().groupBy("host", "key").agg(F.count("*").alias("n_docs"))
        each = texts.join(having, ["host", "key"]).select("host", "key", "n_words", "n_docs", F.explode("lines").alias("l"))
        lines = written(each.groupBy("host", "key", "n_words", "n_docs", F.col("l.line").alias("line")).agg(F.sum("l.words").alias("words")))
        frequent = written(lines.groupBy("host", "line").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") > line_limit))
        above = lasting(salted_join(lines, frequent.select("host", "line"), ["host", "line"], "key", "inner"))
        lost = above.groupBy("host", "key", "n_words").agg(F.sum("words").alias("lost_words"))
        lost = lasting(lost.select("host", "key", "lost_words", (F.col("lost_words") > F.lit(lost_share) * F.col("n_words")).alias("depleted")))
    return rows.drop("lines"), above.select("host", "key", "line"), lost


def rules(docs: DataFrame, text: str = "text", host: str = "source", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, **how) -> DataFrame:
    """For each row of docs its doc_id, STATS, base_failed, depleted, kept, lost_words (in lines above the limit), and
    cleaned_md5: of the text without these lines.

    Every row stays, repeated rows too; a null or empty text has no words and fails; documents without a host form a host of
    their own; an empty table stays empty; other columns are not read."""
    rows, above, lost = judged(docs, text=text, host=host, **how)
    with temporary(docs.sparkSession):
        bad = written(_lines_above(above))
        keyed = docs.select(F.col(f"`{text}`").alias("text"), host_of(host).alias("__host"), text_key(F.col(f"`{text}`")).alias("__key"))
        maybe, _ = split_by(keyed, bad, ["__host", "__key"])
        left = salted_join(maybe, bad, ["__host", "__key"], "text", "inner").select(F.col("__host").alias("host"), F.col("__key").alias("key"), F.md5(without_lines(F.col("text"), F.col("__bad"))).alias("md5"))
        lost = lasting(lost.join(left.groupBy("host", "key").agg(F.first("md5").alias("md5")), ["host", "key"]))  # equal texts, equal digests
    return _ruled(rows, lost, min_words, repeat_percent)


def _ruled(rows: DataFrame, lost: DataFrame, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> DataFrame:
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    out = salted_join(rows, lost, ["host", "key"], "doc_id", "left")
    out = out.withColumns({"base_failed": base, "depleted": F.coalesce("depleted", F.lit(False)), "lost_words": F.coalesce("lost_words", F.lit(0)).cast("long")})
    if "md5" in lost.columns:
        out = out.withColumn("cleaned_md5", F.coalesce("md5", "key")).drop("md5")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def accepted(docs: DataFrame, text: str = "text", host: str = "source", **how) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns and whole texts."""
    return _applied(docs, text, host, None, reject=True, remove=False, **how)


def cleaned(docs: DataFrame, text: str = "text", host: str = "source", **how) -> DataFrame:
    """docs with the lines above the limit removed from their texts; a null text stays null."""
    return _applied(docs, text, host, None, reject=False, remove=True, **how)


def refined(docs: DataFrame, text: str = "text", host: str = "source", chars: str = "n_chars", **how) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns and the lines above the limit removed from their texts;
    of a text that changes, the column `chars` (if docs have it) is the new length."""
    return _applied(docs, text, host, chars, reject=True, remove=True, **how)


def _applied(docs: DataFrame, text: str, host: str, chars: str | None, reject: bool, remove: bool, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, **how) -> DataFrame:
    """docs without rejected rows, or without the lines above the limit, or both. The verdicts are a table of the texts that go
    or change, and only rows that may have one are shuffled to it."""
    columns, body = [F.col(f"`{c}`") for c in docs.columns], F.col(f"`{text}`")
    none = F.lit(None).cast("array<long>")
    with temporary(docs.sparkSession):
        rows, above, lost = judged(docs, text=text, host=host, **how)
        verdicts = _ruled(rows, lost, min_words, repeat_percent).where(~F.col("kept") if reject else F.lit(False)).select(F.col("host").alias("__host"), F.col("key").alias("__key"), F.lit(True).alias("__rejected"), none.alias("__bad"))
        if remove:
            verdicts = verdicts.unionByName(_lines_above(above).withColumn("__rejected", F.lit(False)))
        verdicts = lasting(verdicts.groupBy("__host", "__key").agg(F.max("__rejected").alias("__rejected"), F.first("__bad", ignorenulls=True).alias("__bad")))
    keyed = docs.withColumns({"__host": host_of(host), "__key": text_key(body)})
    maybe, others = split_by(keyed, verdicts, ["__host", "__key"])
    out = salted_join(maybe, verdicts, ["__host", "__key"], "doc_id", "left").where(~F.coalesce("__rejected", F.lit(False)))
    out = out.withColumn(text, F.when(F.col("__bad").isNull(), body).otherwise(without_lines(body, F.col("__bad"))))
    if chars in docs.columns:
        length = F.length(body).cast(docs.schema[chars].dataType)
        out = out.withColumn(chars, F.when(F.col("__bad").isNull(), F.col(f"`{chars}`")).otherwise(length))
    return others.select(*columns).union(out.select(*columns))


def _lines_above(above: DataFrame) -> DataFrame:
    """For each text its lines above the limit, as many as it has at most."""
    return above.groupBy(F.col("host").alias("__host"), F.col("key").alias("__key")).agg(F.collect_set("line").alias("__bad"))
