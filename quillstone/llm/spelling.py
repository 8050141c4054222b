"""Spelling variant grouping by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point makes one of the other. With a longer length of m, that is
so if their common prefix and common suffix reach m - 1 together. Words are dealt in groups that agree but for a window: those
with a common prefix of a, a common suffix of b, and the lengths m and m - 1. A pair belongs to the one window in which its
common prefix ends. At first the windows are the halves of a word; groups of more than TILE words are dealt again by the halves
of their window, and with a window of one place a group has a word for each letter and one more at most. So no group is large,
and no pair is missed. Groups are packed in tiles: code-point matrices, aligned at the words' beginnings and at their ends, in
which all pairs are compared at once. A tile gives one row for each of its words that has a near one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lasting, salted_join, temporary, written

LEAST_LENGTH, LEAST_COUNT, RATIO, SPOILT = 7, 2, 10, 31
#: Words of a tile and of a group in it; distinct words that a task counts before it passes them on; characters of text at once.
TILE, COUNTED, PIECE = 256, 100_000, 1 << 20
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OTHER = re.compile(r"[^A-Za-zÀ-ÿ]")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text cut between runs of letters in pieces of about `size` characters."""
    begin = 0
    while len(text) - begin > size:
        end = OTHER.search(text, begin + size)
        if end is None:
            break
        yield text[begin : end.start()]
        begin = end.start()
    yield text[begin:] if begin else text


def counted(batches: Iterator[pa.RecordBatch], least: int, spoilt: int) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) from rows of (doc_id, text): runs of letters in lower case, of which those whose crc32 with the document's
    id is divisible by `spoilt` lose a code point. Words of fewer than `least` are left out. A word may come again."""
    runs = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least)
    held: dict[str, int] = {}

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        ids = batch.column("doc_id")
        texts = batch.column("text")
        for k in range(len(texts)):
            text = texts[k].as_py()
            if not text:
                continue
            seed = zlib.crc32(b"%s:" % ("" if ids[k].as_py() is None else str(ids[k].as_py())).encode())
            for piece in pieces(text):
                own: dict[str, int] = {}
                for run in runs.findall(piece):
                    own[run] = own.get(run, 0) + 1
                for run, n in own.items():
                    word = run.translate(LOWER)
                    h = zlib.crc32(word.encode(), seed)
                    if h % spoilt == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] = held.get(word, 0) + n
            if len(held) >= COUNTED:
                yield emit()
                held.clear()
    if held:
        yield emit()


def vocabulary(docs: DataFrame, text: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoilt: int = SPOILT) -> DataFrame:
    """word, n: the words of at least `least` code points that occur `least_count` times or more."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = rows.mapInArrow(lambda batches: counted(batches, least, spoilt), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points of words in the rows of a matrix, aligned at their beginnings or ends; no letter is 0."""
    out = np.zeros((len(words), width), dtype=np.uint8)
    for i, w in enumerate(words):
        codes = np.frombuffer(w.encode("latin-1"), dtype=np.uint8)
        if right:
            out[i, width - len(codes) :] = codes
        else:
            out[i, : len(codes)] = codes
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of all rows of a and of b."""
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    alive = np.ones((len(a), len(b)), dtype=bool)
    for k in range(a.shape[1]):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        out += alive
    return out


def tile(m: int, words: list[str], n: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[str, int, int, str]]:
    """(word, near words, most frequent near word's n, that word) for each word of a tile with a near one in its group and
    window. Words have length m or m - 1."""
    left, right = matrix(words, m, False), matrix(words, m, True)[:, ::-1]
    long = np.flatnonzero([len(w) == m for w in words])
    prefix, suffix = common(left[long], left), common(right[long], right)
    near = (prefix + suffix >= m - 1) & (group[long, None] == group[None, :]) & (prefix >= a[None, :]) & (prefix < m - b[None, :]) & (suffix >= b[None, :])
    near[np.arange(len(long)), long] = False
    if not near.any():
        return []
    every = np.zeros((len(words), len(words)), dtype=bool)
    every[long] = near
    every[:, long] |= near.T  # of two long words both have the other
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), dtype=np.int32)
    rank[order] = np.arange(len(words))
    some = np.flatnonzero(every.any(axis=1))
    best = np.where(every[some], rank[None, :], len(words)).argmin(axis=1)
    return [(words[i], int(k), int(n[j]), words[j]) for i, k, j in zip(some.tolist(), every[some].sum(axis=1).tolist(), best.tolist(), strict=True)]


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words from rows (m, key, a, b, word, n), in which a group, those of one m and key, is together."""
    held: list[tuple] = []
    out: list[tuple] = []

    def tiles(rows: list[tuple]) -> None:
        """Whole groups of one m are packed in a tile while they are TILE words."""
        cuts = [i for i in range(len(rows)) if i == 0 or rows[i][:2] != rows[i - 1][:2]] + [len(rows)]
        some: list[tuple] = []
        groups = 0
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if some and (some[0][0] != rows[begin][0] or len(some) + end - begin > TILE):
                pack(some)
                some, groups = [], 0
            some += [(*r, groups) for r in rows[begin:end]]
            groups += 1
        if some:
            pack(some)

    def pack(some: list[tuple]) -> None:
        a, b, group = (np.array([r[k] for r in some], dtype=np.int32) for k in (2, 3, 6))
        out.extend(tile(some[0][0], [r[4] for r in some], np.array([r[5] for r in some], dtype=np.int64), group, a, b))

    def emit() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("m", "key", "a", "b", "word", "n")), strict=True)
        last = len(held)
        while last and held[last - 1][:2] == held[-1][:2]:  # the last group may go on in the next batch
            last -= 1
        tiles(held[:last])
        held = held[last:]
        if out:
            yield emit()
    if held:
        tiles(held)
    if out:
        yield emit()


def dealt(words: DataFrame) -> DataFrame:
    """Rows (m, a, b, word, n) go to the two halves of their window, with the key of their new group."""
    cut = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    halves = F.array(F.struct((F.col("a") + cut).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - cut).alias("b")))
    rows = words.select("m", "word", "n", F.explode(halves).alias("w")).select("m", "w.a", "w.b", "word", "n")
    return rows.withColumn("key", F.xxhash64("m", "a", "b", F.expr("substring(word, 1, a)"), F.expr("right(word, b)")))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: parts of the near words of words (word, n) that have any; the parts of a word add up."""
    length = F.length("word")
    rows = words.select(F.explode(F.array(length, length + 1)).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"), "word", "n")
    tiled: DataFrame | None = None
    while True:
        rows = dealt(rows)
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.length("word") == F.col("m")).alias("any")).where("size > 1 AND any")
        rows = written(rows.join(sizes, "key"))
        large = (F.col("size") > TILE) & (F.col("m") - F.col("a") - F.col("b") > 1)
        some = rows.where(~large).select("m", "key", "a", "b", "word", "n")
        tiled = some if tiled is None else tiled.union(some)
        rows = rows.where(large).select("m", "a", "b", "word", "n")
        if rows.isEmpty():
            break
    return tiled.repartition("key").sortWithinPartitions("m", "key").mapInArrow(compared, "word string, n_near long, best_n long, best string")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n for each of the words (word, n): the near word that occurs most often (ties: the smallest by
    code points), if it occurs `ratio` times as often as the word at least."""
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))))
    parts = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best")
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = own.union(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    often = -F.col("best.n") >= F.col("n") * ratio
    return every.select("word", "n", "n_near", F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.n")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word, root of the words that have a form: forms are followed to the last. Counts rise with each, so chains end; each round
    doubles the steps of all words that are not at their root."""
    steps = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(salted_join(steps, on, ["root"], "word", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame, text: str = "text", ratio: int = RATIO, **how) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts (`vocabulary`, `forms`, `roots`).

    Null and empty texts have no words; a null doc_id counts as an empty one; rows that repeat count as often as they are there;
    a table without words gives an empty one; other columns are not read."""
    with temporary(docs.sparkSession):
        words = written(vocabulary(docs, text, **how))
        found = written(forms(words, ratio))
        out = found.join(roots(found), "word", "left")
        return lasting(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
