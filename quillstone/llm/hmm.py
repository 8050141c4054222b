"""Hidden Markov language model: Baum-Welch counts aggregated over partitions train latent states, and a scaled forward
recursion gives a text's exact likelihood.

A state emits a word's class (a hash of short words, or of the last letters of longer ones), and the class the word by its
count: P(w | state) = B[state, class] * (c + 1) / (tokens of the class + distinct words of the class + 1); the last 1 is
a class's unknown words. A text is its words and one end, which has a class of its own.

Counts are exact and over the whole corpus. Texts are packed by chunks: a chunk's distinct words go, with their counts,
to the words' buckets; what comes back are counts in the same places. Nothing is broadcast but the model, whose size is
states * classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import remainder
from .storage import written
from .text import encoded, slices, span_hashes, words

STATES, CLASSES = 8, 4096  # the end's class is CLASSES
#: Bytes of text in a chunk, and in a bucket of words; places of tokens taken through numpy at once.
CHUNK_BYTES, BUCKET_BYTES, TOKENS = 6 << 20, 24 << 20, 400_000
#: Longer texts than WHOLE are cut in segments, whose chain is exact.
WHOLE, SEGMENT = 1024, 64
#: Rounds over all training texts go on until one raises the log10 likelihood by less than this for each token.
GAIN = 0.001
END = b""
PACKED = "kind int, bucket int, chunk string, ids array<long>, held binary, sizes array<int>, tokens binary, classes binary, words binary, counts binary, places binary"


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 7) == 2


def token_rows(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts as places in a list of distinct words (the end is b"", and last), that list, its classes and 64-bit
    hashes, and the number of tokens of each text."""
    hashes, codes, spans_, counts, raw, at = [], [], [], [], [], 0
    for s in slices(texts):
        w = words(texts[s])
        long = w.end - w.begin > 4
        hashes.append(w.hashes)
        codes.append(span_hashes(w.data, np.where(long, np.maximum(w.begin, w.end - 3), w.begin), w.end) ^ long.astype(np.uint64))
        spans_.append(np.stack([w.begin, w.end]) + at)
        counts.append(w.counts)
        raw.append(w.data.tobytes())
        at += len(raw[-1])
    every, counts, data, span = np.concatenate(hashes), np.concatenate(counts), b"".join(raw), np.concatenate(spans_, axis=1)
    unique, first, place = np.unique(every, return_index=True, return_inverse=True)
    known = [data[b:e] for b, e in zip(*span[:, first].tolist(), strict=True)]
    classes = np.append((np.concatenate(codes)[first] % np.uint64(CLASSES)).astype(np.int64), CLASSES)
    tokens = np.full(len(place) + len(texts), len(known), dtype=np.int64)
    tokens[np.arange(len(place)) + np.repeat(np.arange(len(texts)), counts)] = place
    return tokens, [*known, END], classes, np.append(unique, np.uint64(0)), counts + 1


def planes(x: np.ndarray, kind: str) -> bytes:
    """Values byte by byte of like weight, which compresses well."""
    x = np.ascontiguousarray(x.astype(kind))
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(batches: Iterator[pa.RecordBatch], buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED from (doc_id, held, text): of kind 0 the chunk's texts as places of its words; of kind 1, for each
    bucket, the chunk's words there, their training counts and places."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    held: list[bool] = []
    texts: list[bytes] = []
    total = 0

    def flush() -> pa.RecordBatch:
        chunk = f"{part}-{number}"
        every, known, classes, hashes, size = token_rows(texts)
        counts = np.bincount(every[np.repeat(~np.array(held), size)], minlength=len(known))
        rows = [(0, -1, ids, np.packbits(np.array(held)).tobytes(), size.tolist(), planes(every, "<u4"), planes(classes, "<u2"), b"", b"", b"")]
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, begins = np.unique(bucket[order], return_index=True)
        for b, at in zip(own.tolist(), np.split(order, begins[1:]), strict=True):
            rows.append((1, b, [], b"", [], b"", planes(classes[at], "<u2"), b"\n".join([known[p] for p in at.tolist()]), planes(counts[at], "<u4"), planes(at, "<u4")))
        k, b, i, h, s, t, c, w, n, p = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array([chunk] * len(rows), pa.string()), pa.array(i, pa.list_(pa.int64())), pa.array(h, pa.binary()), pa.array(s, pa.list_(pa.int32())), pa.array(t, pa.binary()), pa.array(c, pa.binary()), pa.array(w, pa.binary()), pa.array(n, pa.binary()), pa.array(p, pa.binary())],
            names=["kind", "bucket", "chunk", "ids", "held", "sizes", "tokens", "classes", "words", "counts", "places"],
        )

    for batch in batches:
        for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), encoded(batch.column("text")), strict=True):
            ids.append(i), held.append(h), texts.append(t)
            total += len(t) + 64
            if total >= chunk_bytes:
                yield flush()
                ids, held, texts, total, number = [], [], [], 0, number + 1
    if ids:
        yield flush()


def _counted(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk the corpus counts of its words, with their places; and, in a row without a chunk, for
    each class its tokens and distinct words."""
    sums: dict[bytes, int] = {}
    kinds: dict[bytes, int] = {}
    rows = [(r["chunk"], r["words"].split(b"\n"), unplanes(r["counts"], "<u4"), r["places"], unplanes(r["classes"], "<u2")) for r in table.select(["chunk", "words", "counts", "places", "classes"]).to_pylist()]
    for _, own, counts, _, classes in rows:
        for x, n, c in zip(own, counts.tolist(), classes.tolist(), strict=True):
            sums[x] = sums.get(x, 0) + n
            kinds[x] = c
    out = [(chunk, planes(np.array([sums[x] for x in own]), "<u8"), places, None, None) for chunk, own, _, places, _ in rows]
    met = [(kinds[x], n) for x, n in sums.items() if n]
    cls, num = np.array([c for c, _ in met], dtype=np.int64), np.array([n for _, n in met], dtype=np.float64)
    tokens, distinct = np.bincount(cls, weights=num, minlength=CLASSES + 1), np.bincount(cls, minlength=CLASSES + 1)
    out.append((None, None, None, tokens.astype(np.int64), distinct))
    c, n, p, t, d = zip(*out, strict=True)
    long = pa.list_(pa.int64())
    return pa.table({"chunk": pa.array(c, pa.string()), "counts": pa.array(n, pa.binary()), "places": pa.array(p, pa.binary()), "tokens": pa.array(t, long), "distinct": pa.array(d, long)})


class Model:
    """start [states], move [states, states], emit [states, classes + the end]; tokens and distinct words of each class."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, tokens: np.ndarray, distinct: np.ndarray):
        self.start, self.move, self.emit, self.tokens, self.distinct = start, move, emit, tokens, distinct

    def forward(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 likelihood of sequences of classes, which lie one after another. Sequences go side by side; of long ones the
        segments do, as products of matrices [states, states], which are then chained. Exact, as products are associative."""
        out, begin, emit = np.zeros(len(sizes)), np.cumsum(sizes) - sizes, np.ascontiguousarray(self.emit.T)
        short, long = np.flatnonzero(sizes <= WHOLE), np.flatnonzero(sizes > WHOLE)
        for g in groups(sizes[short]):
            at = short[g]
            grid, scale = grid_of(classes, begin[at], sizes[at]), np.zeros(len(at))
            for t, live in enumerate(living(sizes[at])):
                x = (self.start if t == 0 else x[:live] @ self.move) * emit[grid[t, :live]]
                total = x.sum(axis=1)
                x /= total[:, None]
                scale[:live] += np.log10(total)
            out[at] = scale
        if len(long):
            first, n, _, _, m, scale = self._chains(classes, begin[long], sizes[long], np.float64)
            v = np.tile(self.start, (len(long), 1))
            for p in range(int(n.max())):
                some = np.flatnonzero(n > p)
                x = np.einsum("nk,nkj->nj", v[some], m[first[some] + p])
                total = x.sum(axis=1)
                v[some] = x / total[:, None]
                out[long[some]] += np.log10(total) + scale[first[some] + p]
        return out

    def _chains(self, classes: np.ndarray, begin: np.ndarray, size: np.ndarray, kind: type) -> tuple[np.ndarray, ...]:
        """Of long sequences cut in segments, one sequence's after another's: each sequence's first segment and number of
        segments; each segment's begin and length, its matrix without scale, and the scale's log10."""
        k, move = len(self.start), self.move.astype(kind)
        most = self.emit.max(axis=0)
        emit, lost = np.ascontiguousarray((self.emit / most).T).astype(kind), np.log10(most)
        n = (size + SEGMENT - 1) // SEGMENT
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        at, length = np.repeat(begin, n) + place * SEGMENT, np.minimum(SEGMENT, np.repeat(size, n) - place * SEGMENT)
        m, scale = np.empty((len(at), k, k), dtype=kind), np.zeros(len(at))
        for g in groups(length):
            grid = grid_of(classes, at[g], length[g])
            own = np.where((place[g] == 0)[:, None, None], np.eye(k, dtype=kind)[None], move[None]) * emit[grid[0]][:, None, :]
            gone = np.zeros(len(g))
            for t, live in enumerate(living(length[g])):
                if t:
                    own[:live] = (own[:live].reshape(-1, k) @ move).reshape(live, k, k) * emit[grid[t, :live]][:, None, :]
                if t % 8 == 7 or t == len(grid) - 1:
                    total = own[:live].sum(axis=(1, 2))
                    own[:live] /= total[:, None, None]
                    gone[:live] += np.log10(total)
                gone[:live] += lost[grid[t, :live]]
            m[g], scale[g] = own, gone
        return first, n, at, length, m, scale

    def expected(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Baum-Welch counts of whole sequences, flat: start, move, emit."""
        return self.learned(classes, sizes)[:-1]

    def learned(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The counts of `expected`, and last the log10 likelihood of the sequences. A segment of a long sequence is entered
        with what the segments before it say of the state, and left with what those after it say."""
        k, begin = len(self.start), np.cumsum(sizes) - sizes
        start, move, emit = self.start.astype(np.float32), self.move.astype(np.float32), np.ascontiguousarray(self.emit.T).astype(np.float32)
        total = np.zeros(k + k * k + k * len(emit) + 1)
        short, long = np.flatnonzero(sizes <= WHOLE), np.flatnonzero(sizes > WHOLE)
        for g in groups(sizes[short]):
            at = short[g]
            total += self._counts(start, move, emit, grid_of(classes, begin[at], sizes[at]), sizes[at], None, None)
        if len(long):
            first, n, at, length, m, _ = self._chains(classes, begin[long], sizes[long], np.float32)
            enter, leave = np.zeros((len(at), k), dtype=np.float32), np.ones((len(at), k), dtype=np.float32)
            normal = lambda x: x / x.sum(axis=1, keepdims=True)
            enter[first] = start
            for p in range(1, int(n.max())):
                own = first[n > p] + p
                enter[own] = normal(np.einsum("nk,nkj->nj", enter[own - 1], m[own - 1]))
            for p in range(int(n.max()) - 1, 0, -1):
                own = first[n > p] + p
                leave[own - 1] = normal(np.einsum("nkj,nj->nk", m[own], leave[own]))
            opening = np.zeros(len(at), dtype=bool)
            opening[first] = True
            for g in groups(length):
                total += self._counts(start, move, emit, grid_of(classes, at[g], length[g]), length[g], (opening[g], enter[g]), leave[g])
        return total

    def _counts(self, start, move, emit, grid: np.ndarray, length: np.ndarray, entered: tuple[np.ndarray, np.ndarray] | None, leave: np.ndarray | None) -> np.ndarray:
        """Counts of sequences or segments, long ones first. entered: whether a segment opens its sequence, and the states before
        it. leave: what follows says of its last state."""
        k, (width, n), alive = len(start), grid.shape, living(length)
        opening = np.ones(n, dtype=bool) if entered is None else entered[0]
        before = None if entered is None else entered[1]
        alpha, scales = np.zeros((width, n, k), dtype=np.float32), np.ones((width, n), dtype=np.float32)
        for t, live in enumerate(alive):
            if t:
                x = alpha[t - 1, :live] @ move
            else:
                x = start[None] if before is None else np.where(opening[:, None], start[None], before @ move)
            x = x * emit[grid[t, :live]]
            scales[t, :live] = x.sum(axis=1)
            np.divide(x, scales[t, :live, None], out=alpha[t, :live])
        moves, beta = np.zeros((k, k)), np.ones((n, k), dtype=np.float32)
        if leave is not None:
            beta = leave / (alpha[length - 1, np.arange(n)] * leave).sum(axis=1, keepdims=True)
        inside = np.arange(width)[:, None] < length[None, :]
        log = float(np.log10(scales[inside]).sum(dtype=np.float64))
        for t in range(width - 1, -1, -1):
            live = alive[t]
            y = emit[grid[t, :live]] * beta[:live] / scales[t, :live, None]
            alpha[t, :live] *= beta[:live]  # now the share of each state
            if t:
                # alpha of the place before is still without beta
                moves += alpha[t - 1, :live].T @ y
                beta[:live] = y @ move.T
            elif before is not None:
                moves += before[~opening].T @ y[~opening]
        cells, flat = grid[inside], alpha[inside]
        emits = np.stack([np.bincount(cells, weights=flat[:, s], minlength=len(emit)) for s in range(k)])
        return np.concatenate([alpha[0][opening].sum(axis=0, dtype=np.float64), (moves * self.move).ravel(), emits.ravel(), [log]])

    def improved(self, counts: np.ndarray) -> Model:
        """The model of summed Baum-Welch counts; every state keeps a little of each class, by the classes' shares."""
        k = len(self.start)
        start, move, emit = counts[:k], counts[k : k + k * k].reshape(k, k), counts[k + k * k :].reshape(k, -1)
        share = (emit.sum(axis=0) + 0.5) / (emit.sum() + 0.5 * emit.shape[1])
        normal = lambda x: x / x.sum(axis=-1, keepdims=True)
        return Model(normal(start + 0.1), normal(move + 0.1), normal(emit + 20 * share), self.tokens, self.distinct)

    def scores(self, tokens: np.ndarray, sizes: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its known tokens, base score and score. tokens: places in classes and counts."""
        total, kinds = float(self.tokens.sum()), float(self.distinct.sum())
        base = np.log10((counts + 1) / (total + kinds + 1))
        within = np.log10((counts + 1) / (self.tokens[classes] + self.distinct[classes] + 1))
        starts = np.cumsum(sizes) - sizes
        parts = [np.add.reduceat(x[tokens], starts) for x in ((counts > 0).astype(np.int64), base, within)]
        return parts[0], parts[1], parts[2] + self.forward(classes[tokens], sizes)


def groups(length: np.ndarray) -> Iterator[np.ndarray]:
    """Places of sequences, long ones first, so many at a time that padded to the longest they have TOKENS places or make one."""
    order, at = np.argsort(-length, kind="stable"), 0
    while at < len(order):
        n = max(1, TOKENS // int(length[order[at]]))
        yield order[at : at + n]
        at += n


def grid_of(classes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """[tokens, sequences] of classes, zeros after a sequence's end."""
    steps = np.arange(int(length[0]))[:, None]
    return np.where(steps < length[None, :], classes[np.minimum(begin[None, :] + steps, len(classes) - 1)], 0)


def living(length: np.ndarray) -> list[int]:
    """For each place the number of sequences, long ones first, that reach it."""
    return np.searchsorted(-length, -np.arange(int(length[0])), side="left").tolist()


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array(row["sizes"], dtype=np.int64)
    held = np.unpackbits(np.frombuffer(row["held"], dtype=np.uint8), count=len(sizes)).astype(bool)
    return unplanes(row["tokens"], "<u4").astype(np.int64), sizes, unplanes(row["classes"], "<u2").astype(np.int64), held


def first_model(tokens: np.ndarray, distinct: np.ndarray, states: int) -> Model:
    """States drawn from a seed around the classes' shares of all training tokens: the start of the rounds."""
    rng = np.random.default_rng(11)
    share = (tokens + 0.5) / (tokens.sum() + 0.5 * len(tokens))
    emit = share * (rng.gamma(1.0, 1.0, (states, len(tokens))) + 0.05)
    move = np.full((states, states), 0.2 / states) + np.eye(states) * 0.8
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True), tokens, distinct)


def train_round(packed: DataFrame, model: Model) -> tuple[Model, float]:
    """One round of Baum-Welch over all training texts: counts by task, summed by cell in Spark. The improved model, and the
    log10 likelihood of the one before."""
    held = packed.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = held.value, None
        for batch in batches:
            for row in batch.to_pylist():
                tokens, sizes, classes, out = _unpacked(row)
                tokens, sizes = tokens[np.repeat(~out, sizes)], sizes[~out]
                x = m.learned(classes[tokens], sizes)
                total = x if total is None else total + x
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.float64())})

    texts = packed.where("kind = 0").select("sizes", "held", "tokens", "classes")
    k, c = model.emit.shape
    counts = np.zeros(k + k * k + k * c + 1)
    for r in texts.mapInArrow(expect, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # the model's cells
        counts[r["cell"]] = r["n"]
    return model.improved(counts[:-1]), float(counts[-1])


def score(docs: DataFrame, held: Column | None = None, states: int = STATES, gain: float = GAIN, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for each row of docs (doc_id, text).

    Learns from rows that are not held out. Every row stays, repeated rows too, each of which counts; a null or empty text
    is one token, the end; a null id counts as the text ''; with nothing to learn from, states stay as drawn and every
    token is unknown; an empty table stays empty; other columns are not read."""
    held = held_out(F.col("doc_id")) if held is None else held
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col(f"`{text}`").alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(16, chars // BUCKET_BYTES))
    packed = written(rows.mapInArrow(lambda b: pack(b, buckets, CHUNK_BYTES), PACKED))
    by_bucket = packed.where("kind = 1").select("bucket", "chunk", "words", "counts", "places", "classes")
    counted = written(by_bucket.groupBy("bucket").applyInArrow(_counted, "chunk string, counts binary, places binary, tokens array<long>, distinct array<long>"))
    of_class = counted.where("tokens IS NOT NULL").select(F.posexplode(F.arrays_zip("tokens", "distinct")).alias("c", "x"))
    tokens, distinct = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in of_class.groupBy("c").agg(F.sum("x.tokens").alias("t"), F.sum("x.distinct").alias("d")).collect():  # one row a class
        tokens[r["c"]], distinct[r["c"]] = r["t"], r["d"]
    model, before, gained = first_model(tokens, distinct, states), -np.inf, tokens.sum() > 0
    while gained:
        model, likelihood = train_round(packed, model)
        gained = likelihood - before >= gain * tokens.sum()
        before = likelihood
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Table, counts: pa.Table) -> pa.Table:
        m, (row,) = known.value, texts.to_pylist()
        tokens, sizes, classes, out = _unpacked(row)
        n = np.zeros(len(classes))
        for r in counts.to_pylist():
            n[unplanes(r["places"], "<u4")] = unplanes(r["counts"], "<u8")
        seen, base, own = m.scores(tokens, sizes, classes, n)
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(out), "n_tokens": pa.array(sizes), "n_known": pa.array(seen), "train_tokens": pa.array(np.full(len(sizes), int(m.tokens.sum()))), "base_score": pa.array(base), "score": pa.array(own)})

    texts = packed.where("kind = 0").select("chunk", "ids", "held", "sizes", "tokens", "classes")
    places = counted.where("chunk IS NOT NULL").select("chunk", "counts", "places")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(scored, schema)
