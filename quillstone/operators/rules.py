"""Rule retrieval: chunks of a rule corpus, their bigram postings, and the best rules for each record.

Records and chunks are never paired as such: both are lists of (id, term, count), joined on the term and summed.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, normalized, rule_id, strip
from ..sources.shared import shared_folder, small_batches, written

#: Characters of content that take part in retrieval.
CONTENT_CHARS = 8000


def paragraphs(text: str, limit: int = 1200) -> list[str]:
    """Paragraphs joined by line breaks up to the limit; a longer one is cut at it."""
    out: list[str] = []
    held = ""
    for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text or ""))):
        if len(held) + len(p) + 1 <= limit:
            held = f"{held}\n{p}".strip()
            continue
        out += [held] if held else []
        cut = (len(p) - 1) // limit * limit
        out += [p[i : i + limit] for i in range(0, cut, limit)]
        held = p[cut:]
    return out + ([held] if held else [])


def paragraph_chunks(text: Column, limit: int = 1200) -> Column:
    """array<string>. A fold whose state is the open chunk, so an Arrow function; the text is one row's."""
    small_batches()

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: paragraphs(t, limit))

    return chunks(text)


# Separators of the recursive splitter, in order, and the instruction of its samples.
SEPARATORS = ("\n\n", "\n", "。", "，", "？", "《", "》", "（", "）", "“", "；", "：", "‘", "！")
RULE_INSTRUCTION = "请学习以下内容并掌握相关知识:"


def _cut(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    """Pieces of one text, white space stripped. A separator stays at the head of what follows it."""
    at = next((i for i, x in enumerate(separators) if not x or x in text), len(separators) - 1)
    mark, rest = separators[at], separators[at + 1 :]
    head, *tail = text.split(mark) if mark else ("", *text)
    held: deque[str] = deque()
    total = 0

    def flushed() -> Iterator[str]:
        piece = "".join(held).strip()
        if piece:
            yield piece

    for part in filter(None, [head, *(mark + x for x in tail)]):
        if len(part) >= size:  # goes by the next separators, or stays long if there is none
            yield from flushed()
            held.clear()
            total = 0
            yield from _cut(part, size, overlap, rest) if rest else [part]
            continue
        if held and total + len(part) > size:
            yield from flushed()
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.popleft())
        held.append(part)
        total += len(part)
    yield from flushed()


def recursive_chunks(text: str, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first of the separators that a text has, longer parts at the next ones;
    pieces of one level share `overlap` characters at most. A part in which no separator is left stays as long as it is."""
    return list(_cut(text or "", size, overlap, separators))


def recursive_pieces(text: Column, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """array<string>. A recursive fold, so an Arrow function; the text is one row's."""
    small_batches()

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_chunks(t, size, overlap, separators))

    return pieces(text)


def rule_samples(pieces: DataFrame, text: str = "text", min_chars: int = 100) -> DataFrame:
    """Adds instruction, input and output of a rule corpus: the stripped piece as both; short pieces go."""
    plain = strip(F.col(text))
    return pieces.where(F.length(plain) >= min_chars).withColumns({"instruction": F.lit(RULE_INSTRUCTION), "input": plain, "output": plain})


def corpus(lines: DataFrame, chunks: Column, min_chars: int = 20) -> DataFrame:
    """rule_id, ordinal, source, text from lines (kind, source, line, input). Chunks are numbered before short ones and
    repeats go, so ids may have gaps; of equal normalized texts of a kind the first stays."""
    each = lines.select("kind", "source", "line", F.posexplode(chunks).alias("i", "text"))
    each = each.withColumn("plain", normalized(F.col("text"))).where(F.length("plain") >= min_chars)
    first = Window.partitionBy("kind", F.sha2("plain", 256)).orderBy("line", "i")
    kept = each.withColumn("turn", F.row_number().over(first)).where("turn = 1")
    ordinal = F.col("line").cast("long") * 1_000_000 + F.col("i")
    return kept.select(rule_id(F.col("kind"), F.col("line"), F.col("i") + 1).alias("rule_id"), ordinal.alias("ordinal"), "kind", "source", "text")


def term_counts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, tf: bigrams of the normalized text."""
    return rows.select(key, F.explode(bigrams(normalized(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def query_text(title: Column, content: Column, *metadata: Column, keywords: Column | None = None) -> Column:
    """Metadata fields joined by a space, keywords by a space, the first characters of the content; one a line."""
    fields = F.concat_ws(" ", title, *[F.coalesce(m, F.lit("")) for m in metadata])
    words = F.array_join(keywords, " ") if keywords is not None else F.lit("")
    return F.concat_ws("\n", fields, words, F.substring(F.coalesce(content, F.lit("")), 1, CONTENT_CHARS))


def weighted_postings(rules: DataFrame, key: str = "rule_id", ordinal: str = "ordinal", text: str = "text") -> DataFrame:
    """term, key, ordinal, tf and idf = ln((N + 1) / (df + 1) + 1), N the number of rules, 1 at least."""
    postings = term_counts(rules, key, F.col(text))
    total = rules.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_rules"))
    weighted = document_frequency(postings).join(F.broadcast(total))  # one row
    weighted = weighted.select("term", F.log((F.col("n_rules") + 1) / (F.col("df") + 1) + 1).alias("idf"))
    return postings.join(weighted, "term").join(rules.select(key, ordinal), key)


#: Characters of the texts that a task is dealt.
TASK_CHARS = 2_000_000


def dealt(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """The rows by key in as many parts as their texts need, whatever the session's number of shuffle partitions: what a task
    makes of them (a row for each bigram of a text, or for each rule that shares one) does not grow with the table."""
    chars = rows.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return rows.repartition(max(1, -(-chars // TASK_CHARS)), key)


#: Postings that are broadcast at most; more are joined by shuffles.
BROADCAST_POSTINGS = 2_000_000


def top_rules(queries: DataFrame, postings: DataFrame, key: str, text: Column, k: int = 3, rule: str = "rule_id", ordinal: str = "ordinal") -> DataFrame:
    """key, rule, rank, score of the k best rules of each query; queries without a shared term have none. A key is one query.

    Score: the shared terms' least counts times idf. Ties go by corpus order; scores are told apart to 8 decimals, below
    which the order of summing shows. Queries are `dealt` by key once, before their terms are made: counts, sums and ranks
    follow that. The rule corpus is the small side: its postings are counted, and broadcast up to BROADCAST_POSTINGS."""
    terms = term_counts(dealt(queries.select(key, text.alias("__text")), key, F.col("__text")), key, F.col("__text"))
    postings = written(postings, shared_folder(postings.sparkSession))  # built once for the count and the join
    few = postings.limit(BROADCAST_POSTINGS + 1).count() <= BROADCAST_POSTINGS
    part = F.least(terms["tf"], postings["tf"]) * F.col("idf")
    scored = terms.join(F.broadcast(postings) if few else postings, "term").groupBy(key, rule, ordinal).agg(F.sum(part).alias("score"))
    best = Window.partitionBy(key).orderBy(F.round("score", 8).desc(), ordinal)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(key, rule, "rank", F.round("score", 4).alias("score"))


def attached(ranked: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """key and rules: array<struct<rank, rule_id, source, text, score>> in order."""
    full = ranked.join(rules.select("rule_id", "source", "text"), "rule_id")
    return full.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "rule_id", "source", "text", "score"))).alias("rules"))  # k at most


def missing_kinds(kinds: DataFrame, known: DataFrame) -> DataFrame:
    """Kinds of review that have no rule corpus."""
    return kinds.join(known, "kind", "left_anti")
