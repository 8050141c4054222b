"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each piece of a text is a row of a matrix of symbols. Leaf i of the row's segment tree holds the rank of the pair
(symbol i, next symbol) and i itself, so the root is the leftmost pair of the lowest rank. A merge changes three leaves
and their ancestors; rows go on until no root holds a mergeable pair. Rows of one tree width are merged together in
numpy. Words and pieces that a worker has met are held in memos of bounded bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Memo, parts, rested, slices, strings

NONE = np.int64(1 << 62)
#: Bytes of a generation of a worker's memos, of words and of pieces, and cells of the trees that are merged together.
WORD_BYTES, PIECE_BYTES, CELLS = 40 << 20, 16 << 20, 1 << 19

# Code points that are neither letters nor digits in the library's Unicode tables and are in those of `regex`, and
# ranges of capitals that the library lowers and Python does not, with the way to their small letters.
SYMBOLS = (
    r"\u0558\u058B\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    r"\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
CAPITALS = [
    (0x1C89, 0x1C89, 1),
    (0xA7CB, 0xA7CB, 0x264 - 0xA7CB),
    (0xA7CC, 0xA7CC, 1),
    (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20),
    (0x16EA0, 0x16EB8, 0x1B),
]
LOWERED = {c: c + step for first, last, step in CAPITALS for c in range(first, last + 1)} | {ord("Σ"): ord("σ")}

# Fixed values of the vocabulary files: the pattern of pieces, and white space as their pattern language has it, which
# does not count the separators from \x1c to \x1f.
PIECES = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{SYMBOLS}]]+|[\p{{N}}--[{SYMBOLS}]]|[[^\s\p{{L}}\p{{N}}]||[{SYMBOLS}\x1c-\x1f]]+")
WHITE = r"[\t-\r \x85\xa0  -     　]+"
ODD = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary and its merges. Encodes pieces by segment tree; texts by pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        self.base = len(self.ids) + 1
        pairs = [(x.split(" ", 1) if isinstance(x, str) else x) for x in model["merges"]]
        keys = np.array([self.ids[a] * self.base + self.ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.inner = np.array([self.ids[c] for c in self.letters], dtype=np.int64)
        self.final = np.array([self.ids[c + self.suffix] for c in self.letters], dtype=np.int64)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.decimal = {i: str(i) for i in self.tokens}
        self.forget()

    def forget(self) -> None:
        self.words, self.said = Memo(WORD_BYTES), Memo(PIECE_BYTES)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it does not merge; a negative symbol merges with nothing."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p:
                by.setdefault(max(1, (len(p) - 2).bit_length()) if len(p) > 1 else 0, []).append(i)
        for bits, rows in by.items():
            step = max(1, CELLS >> (bits + 1))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                for i, ids in zip(some, self._merge([pieces[i] for i in some], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Pieces of at most width + 1 bytes; width is a power of two."""
        n, cols = len(pieces), width + 2
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        cell = np.arange(cols)[None, :] < size[:, None]
        sym = np.full((n, cols), -1, dtype=np.int64)
        sym[cell] = self.inner[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        last = np.fromiter((p[-1] for p in pieces), dtype=np.int64, count=n)
        sym[np.arange(n), size - 1] = self.final[last]
        nxt = np.tile(np.arange(1, cols + 1), (n, 1))
        nxt[:, -1] = cols - 1
        prv = np.tile(np.arange(-1, cols - 1), (n, 1))
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        rank = self.ranks(sym[:, :width], sym[:, 1 : width + 1])
        tree[:, width:] = np.where(rank < NONE, rank * width + np.arange(width), NONE)
        level = width
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        flat, row = tree.reshape(-1), np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = tree[row, 1]
            i = root % width
            j = nxt[row, i]
            k = nxt[row, j]
            merged = self.made[root // width]
            sym[row, i], sym[row, j] = merged, -1
            nxt[row, i], prv[row, k] = k, i
            p = prv[row, i]
            right = self.ranks(merged, sym[row, k])
            left = np.where(p >= 0, self.ranks(sym[row, p], merged), NONE)
            base = row * (2 * width) + width
            j_in = j < width  # the last symbol of a full row starts no pair
            flat[(base + j)[j_in]] = NONE
            flat[base + i] = np.where(right < NONE, right * width + i, NONE)
            with_left = p >= 0
            flat[(base + p)[with_left]] = np.where(left < NONE, left * width + p, NONE)[with_left]
            rows = np.concatenate([row[j_in], row, row[with_left]]) * (2 * width)
            node = np.concatenate([j[j_in], i, p[with_left]]) + width
            while width > 1 and node[0] > 1:
                node = node >> 1
                at = rows + 2 * node
                flat[rows + node] = np.minimum(flat[at], flat[at + 1])
            row = row[tree[row, 1] < NONE]
        alive = sym >= 0
        ids, ends = sym[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [ids[x:y] for x, y in zip([0, *ends], ends)]

    def _pieces(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        return PIECES.findall((text if text.isascii() else text.translate(LOWERED)).lower())

    def _say(self, pieces: set[str]) -> dict[str, str]:
        """Decimal ids and tokens of each piece, each joined by one space, as two lines."""
        new = self.said.missing(pieces)
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            for p, ids in zip(some, self.encode_pieces([p.encode() for p in some]), strict=True):
                self.said.add(p, " ".join([self.decimal[i] for i in ids]) + "\n" + " ".join([self.tokens[i] for i in ids]))
        return self.said.held

    def _learn(self, chunks: list[str]) -> None:
        """Puts chunks without white space into the memo of words: the two lines of all their pieces."""
        plan: list[list[str]] = []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                plan.append([chunk.lower()])
            elif self.splitter and "<" in chunk:
                plan.append([y for x in self.splitter.split(chunk) for y in ([x] if x in self.special else self._pieces(x))])
            else:
                plan.append(self._pieces(chunk))
        said = self._say({y for x in plan for y in x if y not in self.special})
        fixed = {x: f"{i}\n{x}" for x, i in self.special.items()}
        for chunk, x in zip(chunks, plan, strict=True):
            found = [fixed.get(y) or said[y] for y in x]
            self.words.add(chunk, found[0] if len(x) == 1 else joined(found))
        self.said.turn()

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of tokens, the decimal ids joined by one space, and the decoded text.

        The vocabulary has no decoder, so decoding joins the tokens of the ids by one space.
        """
        split = [regex.split(WHITE, t) if ODD.search(t) else t.split() for t in texts]
        new = self.words.missing({c for x in split for c in x if c})
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        held, out = self.words.held, []
        for chunks in split:
            ids, _, decoded = joined([held[c] for c in chunks if c]).partition("\n")
            out.append((ids.count(" ") + 1 if ids else 0, ids, decoded))
        self.words.turn()
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def joined(said: list[str]) -> str:
    """One text of two lines from many: the first lines joined by one space, and the second ones. No token has a line break."""
    lines = "\n".join(said).split("\n")
    return " ".join(lines[::2]) + "\n" + " ".join(lines[1::2])


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One vocabulary per worker process."""
    return Bpe(path)


def local_file(path: str) -> str:
    """The vocabulary as this host has it: installed at the same path, or sent along with addFile."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def encode_udf(path: str):
    """struct<n_tokens, ids, decoded> of a text column; ids in decimal, joined by one space. Null counts as the empty text."""

    @F.pandas_udf("n_tokens long, ids string, decoded string")
    def encode(texts: pd.Series) -> pd.DataFrame:
        bpe, held = load(local_file(path)), [x or "" for x in texts]
        rows = [r for s in slices(held) for r in bpe.encode_batch(held[s])]
        return pd.DataFrame(rows, columns=["n_tokens", "ids", "decoded"])

    return encode


def digest_udf(path: str):
    """struct<n_tokens, ids_sha256, decoded_sha256>: as encode_udf, but the long strings stay in the task."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(local_file(path))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        for texts in batches:
            rows = [(n, sha(ids), sha(dec)) for some in parts(texts) for held in [strings(some)] for s in slices(held) for n, ids, dec in bpe.encode_batch(held[s])]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string() if i else pa.int64()) for i in range(3)], names=names)
        bpe = None  # a worker may go on with tasks of other kinds, and reads the vocabulary again in a fraction of a second
        load.cache_clear()
        rested()

    return digest


def decode_udf(path: str):
    """The decoded text of a column of decimal ids joined by one space; unknown ids are passed over, null gives ''."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        bpe = load(local_file(path))
        return pd.Series([bpe.decode([int(i) for i in (x or "").split()]) for x in ids], dtype=object)

    return decode


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """Adds the struct column `out` with n_tokens, ids and decoded. Every row stays, repeated rows too; a null or empty
    text has 0 tokens; an empty table stays empty; a column named `out` is replaced; other columns pass unread."""
    return docs.withColumn(out, encode_udf(path)(F.col(_quoted(text))))


def encode_digests(docs: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """As encode, with the SHA-256 of ids and of decoded text in place of both."""
    return docs.withColumn(out, digest_udf(path)(F.col(_quoted(text))))


def decode(docs: DataFrame, path: str, ids: Column | str, out: str = "decoded") -> DataFrame:
    """Adds the text of decimal ids joined by one space."""
    return docs.withColumn(out, decode_udf(path)(F.col(ids) if isinstance(ids, str) else ids))


def _quoted(name: str) -> str:
    return f"`{name}`"
