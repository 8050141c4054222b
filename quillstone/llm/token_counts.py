"""Token counts: a library's encoding of batches inside an Arrow function that returns lengths only.

Texts are cut at safe boundaries: a single space between two characters that are not white space. The byte-level
pattern joins such a space to what follows and never looks across it, so the counts of the parts add up. Equal parts are
encoded once while a worker's memo of bounded bytes holds them; all others go through the library's encoder in batches
balanced by bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Memo, parts, slices, strings

#: Bytes of a generation of a worker's memo; bytes of the parts that go to the library at once; longer parts are not kept.
MEMO_BYTES, BATCH_BYTES, KEPT_BYTES = 48 << 20, 64 << 10, 64
SAFE = re.compile(r"(?<=\S) (?=\S)")


def batches(parts: list[str], limit: int = BATCH_BYTES) -> list[list[str]]:
    """The parts in as many batches as their bytes need, alike in bytes: long ones are dealt first, each to the batch that
    has least so far in turn. A part above the limit makes up most of a batch of its own."""
    sizes = [len(p) if p.isascii() else len(p.encode()) for p in parts]
    n = max(1, min(len(parts), -(-sum(sizes) // limit)))
    order = sorted(range(len(parts)), key=lambda i: -sizes[i])
    out: list[list[str]] = [[] for _ in range(n)]
    for k, i in enumerate(order):  # forth and back over the batches
        turn, place = divmod(k, n)
        out[place if turn % 2 == 0 else n - 1 - place].append(parts[i])
    return out


class Counter:
    """Counts tokens of texts with one tokenizers file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()

    def forget(self) -> None:
        self.memo = Memo(MEMO_BYTES)

    @staticmethod
    def parts(text: str) -> list[str]:
        """Pieces of the text that encode on their own; all but the first begin with the space before them."""
        plain = text.split(" ")
        if all(plain) and not any(p[0].isspace() or p[-1].isspace() for p in plain):
            found = plain
        else:
            found = SAFE.split(text)
        return [found[0], *(" " + p for p in found[1:])] if text else []

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.parts(t) for t in texts]
        long: dict[str, int] = {}
        for some in batches(self.memo.missing({p for x in cut for p in x})):
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                if len(p) <= KEPT_BYTES:
                    self.memo.add(p, len(e))
                else:
                    long[p] = len(e)
        held = self.memo.held | long if long else self.memo.held
        out = [sum(map(held.__getitem__, x)) for x in cut]
        self.memo.turn()
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Counter:
    return Counter(path)


def count_udf(path: str):
    """Tokens of each text; null counts as the empty text."""
    from .bpe import local_file

    @F.arrow_udf("long")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = load(local_file(path))
        for texts in columns:
            yield pa.array([n for some in parts(texts) for held in [strings(some)] for s in slices(held) for n in counter.count(held[s])], type=pa.int64())
        counter.forget()  # a worker may go on with tasks of other kinds

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit). Columns of these names are replaced. Every row stays,
    repeated rows too; null and empty texts have 0 bytes and 0 tokens; an empty table stays empty. Counts are the
    library's for whole texts without added special tokens, truncation or padding; a special token's string counts 1."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumns(
        {"n_bytes": F.octet_length(body).cast("long"), "n_tokens": count_udf(path)(F.col(f"`{text}`"))}
    ).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
