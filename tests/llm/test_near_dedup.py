import numpy as np
import pytest
from test_corpus import edited_copies, shingles

from quillstone.llm import jaccard_join, near_dedup
from quillstone.llm.queries import QUERIES
from quillstone.llm.text import distinct_grams


def plain(rows):
    """n_shingles, component and whether it is kept, by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, 3)) for i, t in rows]
    having, parent = {}, {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        met = {}
        for x in a if i is not None else ():
            for j in having.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            having[x].append(k)
        for j, both in met.items():
            if 100 * both >= 85 * (len(a) + len(sets[j][1]) - both):
                x, y = root(i), root(sets[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(None if i is None else root(i)), i is None or root(i) == i) for i, s in sets)


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def test_query_equals_all_pairs(spark, sf, docs):
    got = QUERIES["op13_near_dedup"](spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(got) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(odd, none):
    assert found(near_dedup.deduplicated(odd)) == plain([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert near_dedup.deduplicated(none).count() == 0
    ids = [r["doc_id"] for r in near_dedup.first_of_each(odd).collect()]
    assert sorted(x for x in ids if x is not None) == [1, 4, 5, 6, 7, 7, 8, 8, 9, 10, 11] and ids.count(None) == 2
    assert near_dedup.first_of_each(odd).columns == odd.columns


@pytest.mark.parametrize("chain", [False, True])
def test_groups_of_near_copies(spark, chain):
    texts = edited_copies(60, edits=3, chain=chain) + edited_copies(30, words=40, edits=1, seed=1, chain=chain) + edited_copies(40, words=60, edits=8, seed=2)
    texts += ["a b c d e f g h i", "a b c d e f g h", "a b c", "A  b c", "a b", "a"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    assert found(near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_bins_agree_as_often_as_sets_do():
    """Also for sets far smaller than the number of bins: densification is without bias."""
    rng = np.random.default_rng(5)
    for n, shared in ((7, 6), (40, 30), (2000, 1500)):
        agree = []
        for _ in range(60 if n < 1000 else 10):
            x = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(x[:n]), np.sort(x[n - shared :])
            s, _ = near_dedup.signatures(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - shared / (2 * n - shared)) < 0.05


def test_minima_are_the_least_hash_of_each_bin():
    hashes, owner = distinct_grams([b" ".join(b"w%d" % i for i in range(3000)), b"", b"one two three"], 3)
    s, some = near_dedup.signatures(hashes, owner, 3)
    assert some.tolist() == [True, False, True] and not s[1].any() and len(set(s[2].tolist())) == 1
    bins = [int(h) * near_dedup.BINS >> 64 for h in hashes[owner == 0]]
    want = {b: min(int(h) for h, x in zip(hashes[owner == 0], bins) if x == b) for b in set(bins)}
    assert len(want) == near_dedup.BINS and [want[k] for k in range(near_dedup.BINS)] == s[0].tolist()
    assert len(set(near_dedup.band_keys(s)[0].tolist())) == near_dedup.BANDS


def test_stars_bound_the_candidates(spark, monkeypatch):
    """A bucket of many copies gives an edge a member, not all pairs."""
    made = []

    def counted(*a, **k):
        made.append(jaccard_join.links(*a, **k).count())
        return jaccard_join.links(*a, **k)

    monkeypatch.setattr(near_dedup, "links", counted)
    texts = edited_copies(300, words=200, edits=2, seed=9)
    got = near_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0} and made[0] < 300 * near_dedup.BANDS
