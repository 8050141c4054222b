"""Language ID with a string kernel: blended-spectrum n-gram presence, Nyström landmarks, one-versus-rest kernel ridge.

The kernel of two texts counts the byte n-grams of 2 to 4 (hashed to 2**BITS) that both have, divided by the root of the
product of their own numbers of n-grams. The landmarks are texts of a bounded training sample. A text is scored in
windows, so that long texts do not fill the spectrum: presence matrix times landmarks times coefficients, where the last
two are multiplied once, being the same for all texts; the windows' scores are averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linear import remainder
from .text import LETTERS, parts, resting, slices

BITS, SIZES, WINDOW = 14, (2, 3, 4), 2048
#: Bounds of the labelled sample: windows of each language, windows over all languages (one of each language at least), and
#: characters of a window, which may come from any place of any labelled text.
PER_LANGUAGE, OVERALL, CHARS = 500, 20_000, 2000
#: Landmarks over all languages, one of each at least, and the ridge.
LANDMARKS, RIDGE = 300, 1e-2
LETTER = regex.compile(r"\p{L}")
NONE = "und"


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 3) == 1


def presence(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Boolean matrix of windows and hashed n-grams, and the text of each window. An empty text has one empty window."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n_windows = np.maximum((sizes + window - 1) // window, 1)
    first = np.concatenate([[0], np.cumsum(n_windows)])[:-1]
    data = LETTERS[np.frombuffer(b"".join(texts) + b"   ", dtype=np.uint8)].astype(np.uint32)
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    owner = np.repeat(np.arange(len(texts)), sizes)
    within = np.arange(int(sizes.sum())) - begins[owner]
    row = first[owner] + within // window
    left = sizes[owner] - within  # bytes up to the text's end
    out = np.zeros((int(n_windows.sum()), 1 << BITS), dtype=bool)
    flat, n = out.reshape(-1), len(owner)
    code, base = np.zeros(n, dtype=np.uint32), row << BITS
    for k in range(max(SIZES)):
        code = code * np.uint32(256) + data[k : n + k]
        if k + 1 in SIZES:
            cell = ((code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(32 - BITS)).astype(np.int64)
            some = left > k
            flat[(base + cell)[some]] = True
    return out, np.repeat(np.arange(len(texts)), n_windows)


def _normal(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


class Model:
    """Languages and the product of landmarks and coefficients: [2**BITS, languages]."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        raw = [(t or "").encode() for t in texts]
        out: list[tuple[str, float]] = []
        for s in slices(raw, WINDOW * 128):
            x, owner = presence(raw[s])
            scores = np.empty((len(x), max(1, len(self.languages))), dtype=np.float64)
            for k in range(0, len(x), 512):
                scores[k : k + 512] = _normal(x[k : k + 512]) @ self.weights if self.languages else 0
            n = np.bincount(owner)
            mean = np.stack([np.bincount(owner, weights=c) for c in scores.T], axis=1) / n[:, None]
            share = np.clip((mean + 1) / 2, 0, 1) + 1e-9
            share /= share.sum(axis=1, keepdims=True)
            for t, p in zip(texts[s], share, strict=True):
                if not self.languages or not t or not LETTER.search(t):
                    out.append((NONE, 0.0))
                else:
                    out.append((self.languages[int(p.argmax())], float(p.max())))
        return out


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from pairs of language and text, in any order."""
    rows = sorted(r for r in rows if r[1])
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros((1 << BITS, 1), dtype=np.float32))
    raw = [t.encode() for _, t in rows]
    owner = presence_owner(raw)
    drawn = np.random.default_rng(7).permutation(len(owner))
    of = np.array([languages.index(rows[o][0]) for o in owner])[drawn]
    turn = np.empty(len(drawn), dtype=np.int64)  # of the windows of one language, as they are drawn
    for k in range(len(languages)):
        turn[of == k] = np.arange(int((of == k).sum()))
    chosen = np.sort(drawn[np.argsort(turn, kind="stable")[: max(landmarks, len(languages))]])
    marks, products, answers, first = [], [], [], 0
    for s in slices(raw, WINDOW * 128):  # the landmarks, then every window's kernel with them
        x, _ = presence(raw[s])
        marks.append(_normal(x[chosen[(chosen >= first) & (chosen < first + len(x))] - first]))
        first += len(x)
    marks = np.concatenate(marks)
    for s in slices(raw, WINDOW * 128):
        x, own = presence(raw[s])
        products.append((_normal(x) @ marks.T).astype(np.float64))
        answers.append([[1.0 if rows[s.start + o][0] == lang else -1.0 for lang in languages] for o in own])
    k_nm, y = np.concatenate(products), np.concatenate(answers)
    k_mm = k_nm[chosen]
    a = k_nm.T @ k_nm + ridge * len(k_nm) * k_mm + 1e-6 * len(k_nm) * np.eye(len(chosen))
    coefficients = np.linalg.solve(a, k_nm.T @ y)
    return Model(languages, (marks.T @ coefficients).astype(np.float32))


def presence_owner(texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """The text of each window."""
    return np.repeat(np.arange(len(texts)), [max(1, -(-len(t) // window)) for t in texts])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, chars: int = CHARS, text: str = "text", lang: str = "lang", **how) -> Model:
    """Learns from windows of texts that are not held out and have a language: of each language those with the least draws, a
    64-bit hash of doc_id, place and text, `per_language` at most. Every part of every such text may be drawn; equal windows
    of equal rows are drawn once. Rows without a language or text are not learned."""
    body, doc = F.col("text"), F.col("doc_id")
    usable = docs.select("doc_id", F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(doc))
    windows = F.ceil(F.length(body) / chars).cast("int")
    counts = usable.groupBy("lang").agg(F.sum(windows).alias("n")).collect()  # a row a language
    if not counts:
        return fit([])
    bound = max(1, min(per_language, OVERALL // len(counts)))
    some = bound + 6 * bound**0.5 + 10  # a few more than are taken
    most = {r["lang"]: min((1 << 63) - 1, -(1 << 63) + int(min(1.0, some / r["n"]) * (1 << 64))) for r in counts}
    limit = F.create_map(*[F.lit(x) for item in most.items() for x in item])
    marked = usable.where(F.col("lang").isin(list(most))).withColumn("h", F.xxhash64(F.lit("language"), "doc_id", "text")).withColumn("most", limit[F.col("lang")])
    draws = F.transform(F.sequence(F.lit(0), windows - 1), lambda w: F.struct(F.xxhash64("h", w).alias("draw"), w.alias("w")))
    chosen = F.filter(draws, lambda d: d["draw"] <= F.col("most"))
    each = marked.withColumn("chosen", chosen).where(F.size("chosen") > 0)
    each = each.select("lang", F.explode(F.transform("chosen", lambda d: F.struct(d["draw"].alias("draw"), F.substr(body, d["w"] * chars + 1, F.lit(chars)).alias("text")))).alias("c"))
    each = each.groupBy("lang", F.col("c.draw").alias("draw")).agg(F.first("c.text").alias("text"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))  # of a bounded number of rows
    rows = each.withColumn("turn", turn).where(F.col("turn") <= bound).select("lang", "text")
    return fit([(r["lang"], r["text"]) for r in rows.collect()], **how)  # OVERALL windows of `chars` characters at most


def predict_udf(model: Model, spark):
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    @resting
    def predict(texts: pa.Array) -> pa.Array:
        rows = [r for some in parts(texts) for r in held.value.predict(some.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model | None = None, text: str = "text", out: str = "language", **how) -> DataFrame:
    """Adds the struct column `out` with lang_pred and score (0 to 1). Without a model, one is trained on docs themselves.

    Every row stays, repeated rows too; texts that are null or have no letter get 'und' and 0, and so does every text if
    nothing could be learned; an empty table stays empty; a column named `out` is replaced."""
    model = model or train(docs, text=text, **how)
    return docs.withColumn(out, predict_udf(model, docs.sparkSession)(F.col(f"`{text}`")))
