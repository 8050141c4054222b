"""Text helpers that run inside tasks: bounded slices of an Arrow column, and vectorised words and hashes.

A word is a run of characters other than space and \\x09-\\x0D. All work is on UTF-8 bytes: white space is
ASCII there, so the words of the bytes are the words of the text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken through numpy at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower-case letters and bytes beyond ASCII; all other ASCII as a space.
LETTERS = LOWER.copy()
LETTERS[:128] = np.where(np.isin(LOWER[:128], np.arange(97, 123)), LOWER[:128], 32)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.default_rng(20240521)
_BYTE_CODES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


def rested() -> None:
    """Gives back what the allocators of a worker keep as a task ends: workers live on, several beside each executor, and each
    would hold what its largest task took. Where the C library has no malloc_trim, only what Arrow keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def resting(one: Callable[[pa.Array], pa.Array]):
    """A function of a column as one of its batches, `rested` as they end."""

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield one(batch)
        rested()

    return each


class Memo:
    """What texts have led to, in two generations of bounded bytes: keys that are asked for again go on into the new one when
    the old one is dropped. Between turns it holds all keys asked for, so that it can be read as a dict."""

    #: Bytes of an entry besides the characters of its key, and of a text as its value.
    ENTRY, TEXT = 120, 50

    def __init__(self, limit: int):
        self.limit, self.bytes = limit, 0
        self.held: dict = {}
        self.before: dict = {}

    def missing(self, keys: set) -> list:
        """The keys without a value; those of the old generation are taken over."""
        out, held, before = [], self.held, self.before
        for key in keys:
            if key not in held:
                value = before.get(key)
                if value is None:
                    out.append(key)
                else:
                    self.add(key, value)
        return out

    def add(self, key, value) -> None:
        self.held[key] = value
        self.bytes += len(key) + self.ENTRY + (self.TEXT + len(value) if isinstance(value, str) else 0)

    def turn(self) -> None:
        """Begins a new generation if this one is full."""
        if self.bytes > self.limit:
            self.held, self.before, self.bytes = {}, self.held, 0


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The values of a text column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def parts(column: pa.Array, rows: int = 1024) -> Iterator[pa.Array]:
    """Slices of a column, so that only some rows are Python objects at a time."""
    for k in range(0, len(column), rows):
        yield column.slice(k, rows)


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The values in UTF-8, null as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes] | list[str], limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Ranges of whole texts with at most `limit` bytes or characters each, or one longer text."""
    begin = total = 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text) > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the step and of its inverse; kept up to a bounded length."""
    held = _POWERS.get("up")
    if held is None or len(held) < n:
        size = max(n, SLICE_BYTES + SLICE_BYTES // 8)
        up, down = np.full(size, _STEP), np.full(size, _STEP_INVERSE)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 8 * SLICE_BYTES:
            return up[:n], down[:n]
        _POWERS.update(up=up, down=down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words(NamedTuple):
    """Words of several texts one after another; `first` holds the index of each text's first word, and their count last."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(texts: list[bytes], fold: np.ndarray | None = LOWER, hashed: bool = True) -> Words:
    """The words of some texts with a 64-bit hash of each: a polynomial over random byte codes, then mixed. fold: what
    each byte counts as."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return words_of(data if fold is None else fold[data], sizes, hashed)


def words_of(data: np.ndarray, sizes: np.ndarray, hashed: bool = True) -> Words:
    """As words, of bytes in which text i has sizes[i] bytes, white space at its end included."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = ~SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[0::2], edges[1::2]
    first = np.concatenate([[0], np.searchsorted(begin, np.cumsum(sizes))])
    hashes = np.empty(0, dtype=np.uint64)
    if hashed:
        hashes = span_hashes(data, begin, end)
    return Words(data, begin, end, first, hashes)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from begin to end."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin])


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the text of each; a shorter text with words gives its whole sequence."""
    counts = w.counts
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), made)
    before = np.concatenate([[0], np.cumsum(made)])[:-1]
    at = np.repeat(w.first[:-1] - before, made) + np.arange(int(made.sum()))
    padded = np.concatenate([w.hashes, np.zeros(n, dtype=np.uint64)])
    last = w.first[1:][owner] if len(owner) else np.empty(0, dtype=np.int64)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        part = padded[at + k]
        if k:
            part = np.where(at + k < last, part, np.uint64(k))
        out = out * _STEP + part
    return mixed(out), owner


def distinct_grams(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's word n-grams, ascending within a text, and the text of each."""
    hashes, owner = grams(words(texts), n)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]
