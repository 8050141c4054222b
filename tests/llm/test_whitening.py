import numpy as np
import pytest

from quillstone.llm import whitening
from quillstone.llm.queries import QUERIES


def symmetric(kind, d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {"plain": rng.uniform(0, 1, d), "falling": 10.0 ** -np.minimum(np.arange(d), 12), "repeated": np.arange(d) // 3 + 1.0, "singular": np.where(np.arange(d) < d // 2, 1.0 + np.arange(d), 0)}[kind]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("kind", ["plain", "falling", "repeated", "singular"])
@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_divide_and_conquer_equals_eigenvalues(kind, d):
    a = symmetric(kind, d)
    a = (a + a.T) / 2
    want, scale = np.linalg.eigvalsh(a)[::-1], np.linalg.norm(a) or 1
    for need in (1, 4, d):
        values, vectors = whitening.eigen(a, min(need, d))
        assert np.abs(values - want[: len(values)]).max() < 1e-13 * scale
        assert np.linalg.norm(a @ vectors - vectors * values) < 1e-13 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_polar_factor_is_orthogonal():
    a = symmetric("plain", 30) - 0.5 * np.eye(30)
    u = whitening.polar(a)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13 and np.abs(u - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-10


def plain(rows, most=4):
    """Rows by the contract, by numpy: key, n, deviation, absolute whitened values, shares of the trace."""
    usable = [(k, v) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in usable), default=0)
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (width - len(v)) for _, v in usable], dtype=object).reshape(len(usable), width)
    once = {tuple(r) for r in x.tolist()}
    n, sums = len(once), [sum(c) for c in zip(*once)]
    v = np.cov(np.array(sorted(once), dtype=float).T.reshape(width, -1), bias=True).reshape(width, width)
    values, vectors = (z[..., ::-1][..., :most] for z in np.linalg.eigh(v))
    w = (x.astype(float) - np.array(sums, dtype=float) / n) @ vectors / np.sqrt(np.where(values > width * 2.3e-16 * np.trace(v), values, np.nan))
    return [(k, n, sum((n * a - s) ** 2 for a, s in zip(r, sums)), np.abs(y), values / np.trace(v)) for (k, _), r, y in zip(usable, x.tolist(), w)]


def compared(got, want):
    rows = {}
    for r in got:
        rows.setdefault(r["vec_id"], []).append(r)
    assert sorted(map(str, rows)) == sorted({str(k) for k, *_ in want})
    for k, n, deviation, white, shares in want:
        some = sorted(rows[k], key=lambda r: r["component"])
        assert {(r["n"], r["deviation"]) for r in some} == {(n, deviation)}
        assert [r["component"] for r in some] == list(range(1, len(shares) + 1))
        assert np.allclose([np.nan if r["whitened"] is None else abs(r["whitened"]) for r in some], white, atol=1e-8, equal_nan=True)
        assert np.allclose([r["explained"] for r in some], shares, rtol=1e-6, atol=1e-12)
        assert all(r["identity_error"] < 1e-4 for r in some)


def test_query_equals_numpy(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op12_whitening"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compared(got.collect(), plain(rows))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, [3, 1, 0.1, 0.01, 0])]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # one vector many times
    rows += [(200, None), (201, []), (202, [1.0, None]), (203, [float("nan")]), (204, [float("inf"), 1.0]), (205, [1.5]), (206, [1.5, 0.0]), (None, [-0.0, 2.0, -1e-9])]
    return rows


def test_odd_vectors(spark, vectors):
    """Null, empty, short, repeated and non-finite vectors; a dimension without variance; columns named as the results."""
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors], "vec_id long, embedding array<float>, n int, white string")
    compared(whitening.components(df).collect(), plain(vectors, 4))
    every = whitening.fit(df)
    assert every.known.tolist() == [True] * 4 + [False]


def test_few_vectors(spark):
    make = lambda rows: whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).count() == 0 and make([(1, None), (2, [float("nan")])]).count() == 0 and make([(1, [])]).count() == 0
    assert [(r["component"], r["deviation"], r["whitened"]) for r in make([(1, [0.5, 2.0]), (2, [0.5, 2.0])]).collect()] == [(1, 0, None), (2, 0, None)] * 2
    assert sorted(round(r["whitened"], 9) for r in make([(1, [1.0]), (2, [3.0]), (3, [3.0])]).collect()) in ([-1, 1, 1], [-1, -1, 1])


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float(2**k) for k in (i % 3, 40)]) for i in range(3)] + [(9, [0.0, -(2.0**40)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, sums = 4, (256 * 7, 256 * 2**41)
    want = {i: sum((n * int(256 * c) - s) ** 2 for c, s in zip(v, sums)) for i, v in rows}
    assert {r["vec_id"]: r["deviation"] for r in whitening.components(df).collect()} == {i: None if x >= 2**63 else x for i, x in want.items()}
