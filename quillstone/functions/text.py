"""Text and value expressions. All are built-in functions of one row: no Python runs on the executors.

White space is Unicode white space; offsets and lengths are code points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s+"
# Texts that stand for a missing value.
NULL_TOKENS = ["", "null", "none", "undefined", "nil", "<null>"]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, though the expression names it several times."""
    return F.get(F.transform(F.array(value), then), 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, stripped."""
    return strip(F.regexp_replace(text, WHITE, " "))


def is_missing(value: Column) -> Column:
    """Null, or a text that stands for a missing value. Never null itself."""
    return F.coalesce(F.lower(strip(value)).isin(NULL_TOKENS), F.lit(True))


def first_present(*candidates: Column, default: str | None = "") -> Column:
    """The first value that is not missing, stripped; else the default."""
    present = lambda c: let(strip(c), lambda t: F.when(~F.lower(t).isin(NULL_TOKENS), t))
    return F.coalesce(*[present(c) for c in candidates], F.lit(default))


def clean_text(text: Column) -> Column:
    """Without NUL characters, stripped; texts that stand for a missing value become ''."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(""))
    return let(strip(plain), lambda t: F.when(F.lower(t).isin(NULL_TOKENS), "").otherwise(t))


def normalized(text: Column) -> Column:
    """Lower case without any white space; null as ''."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, ""))


def bigrams(text: Column) -> Column:
    """Neighbouring pairs of characters of a normalized text, in order; a single character alone; '' none.

    The characters are split once: substrings inside a higher-order function would walk the text for each pair."""
    chars = F.split(text, "")
    pairs = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) == 1, F.array(text)).otherwise(F.filter(pairs, lambda p: p.isNotNull()))


def head_tail(text: Column, limit: int, marker: str) -> Column:
    """Texts above the limit as their first two thirds of it, the marker, and the last third."""
    head = limit * 2 // 3
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(limit - head)))).otherwise(text)


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters, each beginning size - overlap after the one before; the last may be shorter."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substr(text, i + 1, F.lit(size))))


def rule_id(kind: Column, line: Column, chunk: Column) -> Column:
    """KIND-lll-cc; larger numbers are not cut."""
    return F.format_string("%s-%03d-%02d", F.upper(kind), line, chunk)


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word; a text without it is only searched."""
    n = ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")
    return F.when(text.contains(word), n).when(text.isNotNull(), 0).cast("long")


def vote(text: Column, words: Sequence[str]) -> Column:
    """Occurrences of all words together; a word inside another counts for both."""
    total = F.lit(0).cast("long")
    for w in words:
        total = total + occurrences(text, w)
    return total


def partial_date(text: Column) -> Column:
    """YYYY0000 as YYYY, YYYYMM00 as YYYY-MM; any other text stays."""
    eight = text.rlike(r"^\d{8}$")
    year, month = F.substring(text, 1, 4), F.substring(text, 5, 2)
    return F.when(eight & (F.substring(text, 5, 4) == "0000"), year).when(eight & (F.substring(text, 7, 2) == "00"), F.concat(year, F.lit("-"), month)).otherwise(text)


def as_double(text: Column) -> Column:
    """A plain decimal number as a double; null for anything else, suffixes such as 8d included."""
    return F.when(strip(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), strip(text).try_cast("double"))


def clamped(value: Column, low: float, high: float) -> Column:
    """Kept within the bounds; null stays null (least and greatest pass over nulls)."""
    return let(value, lambda v: F.when(v < low, low).when(v > high, high).otherwise(v))


def one_decimal(value: Column) -> Column:
    """Half-even rounding to one decimal."""
    return F.bround(value, 1)


def confidence(text: Column, default: float = 8.0) -> Column:
    """A number with or without %, above 10 as tenths, kept in 0 to 10, with one decimal; else the default."""
    scaled = let(as_double(F.replace(text, F.lit("%"), F.lit(""))), lambda v: F.when(v > 10, v / 10).otherwise(v))
    return F.coalesce(one_decimal(clamped(scaled, 0.0, 10.0)), F.lit(default))


def percentage(value: Column) -> Column:
    """Kept in 0 to 100, with one decimal."""
    return one_decimal(clamped(value.cast("double"), 0.0, 100.0))


def bounded(text: Column, low: float, high: float, default: float, kind: str = "double") -> Column:
    """The parameter's value if it parses and lies within the bounds, else the default (it is not clamped)."""
    value = text.try_cast(kind)
    return F.when(value.between(low, high), value).otherwise(F.lit(default).cast(kind))


def hash_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The first 8 hexadecimal digits of SHA-1, modulo the number of buckets."""
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def retention_expired(year_now: Column, year_formed: Column, period: Column) -> Column:
    return year_now - year_formed >= period


def backoff(delay: Column, attempt: Column) -> Column:
    """Seconds before the next attempt: delay * 2 ** (attempt - 1)."""
    return delay * F.pow(F.lit(2.0), attempt - 1)


def training_progress(epoch: Column, epochs: Column, batch: Column, batches: Column) -> Column:
    """Percentage after a batch (from 1) of an epoch (from 0): 18 at the start, 76 for all epochs, of which 85% by batches."""
    return one_decimal(F.lit(18.0) + (epoch + F.lit(0.85) * batch / batches) * F.lit(76.0) / epochs)


def world_size(devices: Column, samples: Column) -> Column:
    """Processes to use: as many as devices, one below 8 samples, never more than samples, one at least."""
    return F.greatest(F.lit(1), F.when(samples < 8, F.lit(1)).otherwise(F.least(devices, samples)))


def merged_spans(spans: Column, gap: int = 30) -> Column:
    """Half-open spans (start, end) of one row, merged where one begins at most `gap` after another's end, in order."""
    kind = "array<struct<start:int,end:int>>"

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(F.size(done) == 0, F.array(span).cast(kind)).when(span["start"] <= last["end"] + gap, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)).cast(kind)).otherwise(F.concat(done, F.array(span)).cast(kind))

    return F.aggregate(F.array_sort(spans.cast(kind)), F.array().cast(kind), add)
