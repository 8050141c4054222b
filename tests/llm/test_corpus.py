import collections
import hashlib
import os
import re

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from quillstone.llm import components, jaccard_join, line_rules, minhash, mixing, storage
from quillstone.llm.queries import QUERIES, SQL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def linked(rows, percent=75):
    """n_shingles and component of each row, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(None if i is None else root(i))) for i, s in sets)


def joined(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.join(df).collect())


def test_jaccard_join_equals_all_pairs(docs):
    assert joined(docs) == linked([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("name", ["op8_jaccard_join", "op13_near_dedup"])
def test_components_equal_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), SQL[name])


def test_jaccard_join_of_odd_rows(odd, none):
    assert joined(odd) == linked([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert jaccard_join.join(none).count() == 0


def edited_copies(n, words=120, edits=12, seed=0, chain=False):
    """Near-copies of one text; in a chain each is an edit of the one before, so that ends are not linked themselves."""
    rng = np.random.default_rng(seed)
    text = [f"w{rng.integers(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        new = list(text)
        at = rng.integers(words - edits)
        new[at : at + edits] = [f"e{i}x{k}" for k in range(edits)]
        out.append(" ".join(new))
        text = new if chain else text
    return out


@pytest.mark.parametrize("chain", [False, True])
def test_groups_of_near_copies(spark, chain):
    texts = edited_copies(40, chain=chain) + edited_copies(30, words=40, edits=3, seed=1, chain=chain) + [" ".join(["p q r s t u v w"] * 3)] * 3
    texts += [f"{t} shared passage of many words that all of these texts have in common at the end" for t in edited_copies(20, words=15, edits=6, seed=2)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == linked(rows)


@pytest.mark.parametrize("light", [0, 10_000])
def test_any_boundary_between_light_and_heavy_is_exact(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard_join, "boundary", lambda prefixes, percent: light)
    rows = list(enumerate(edited_copies(25, words=60, edits=6) + ["a b c", "A  b c", "a b", "one two three four five six", "one two three four five"]))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == linked(rows)


def test_links_of_short_texts_and_their_beginnings(spark):
    """Sets of 4 and 3 shingles: in half of the hash orders they share one shingle only in their lower halves."""
    texts = [[f"t{i}x{k}" for k in range(8)] for i in range(60)]
    rows = list(enumerate(" ".join(t[:n]) for t in texts for n in (8, 7)))
    got = joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == linked(rows) and len({c for *_, c in got}) == 60


@pytest.mark.parametrize("percent", [60, 75, 80, 90])
def test_no_linked_sets_share_fewer_in_their_lower_halves(spark, percent):
    sizes = spark.range(1, 31).select("id", jaccard_join.repeated_at_least(F.col("id"), percent).alias("least"))
    least = {r["id"]: r["least"] for r in sizes.collect()}
    rng = np.random.default_rng(3)
    for a in least:
        for b in range(1, a + 1):
            for shared in range(1, b + 1):
                if 100 * shared < percent * (a + b - shared):
                    continue
                # places of hash order; of each: in both sets, in a only, in b only
                kind = rng.permuted(np.tile(np.repeat([0, 1, 2], [shared, a - shared, b - shared]), (100, 1)), axis=1)
                low = [(kind != other) & (np.cumsum(kind != other, axis=1) <= jaccard_join.half(n, percent)) for n, other in ((a, 2), (b, 1))]
                met = int((low[0] & low[1] & (kind == 0)).sum(axis=1).min())
                assert met >= max(least[a], least[b]), (a, b, shared)


def test_rounds_of_links_have_small_plans(spark, monkeypatch):
    """The driver plans what is left of a table anew as each of its shuffles ends."""
    shuffles, written = [], components.written

    def counted(df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return written(df)

    monkeypatch.setattr(components, "written", counted)
    got = components.connected(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert {r["component"] for r in got.collect()} == {0}
    assert max(shuffles) <= 8, shuffles


def test_pairs_between_components_are_the_last_resort(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", 0)
    rows = list(enumerate(edited_copies(20, words=80, edits=9, chain=True)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, sorted(range(k, k + 8))) for i, k in enumerate((0, 1, 2, 20))]
    classes = spark.createDataFrame([(i, s, len(s)) for i, s in sets], "cid long, shingles array<long>, n int")
    assert {tuple(r) for r in jaccard_join.links(classes, 60, hub_rounds=0).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert joined(df) == linked(rows)


def test_one_each_keeps_the_smallest_id(odd, docs):
    want = {c for _, _, c in linked([(r["doc_id"], r["text"]) for r in docs.collect()])}
    kept = jaccard_join.one_each(docs)
    assert kept.columns == docs.columns and {str(r["doc_id"]) for r in kept.collect()} == want
    ids = [r["doc_id"] for r in jaccard_join.one_each(odd).collect()]
    assert sorted(x for x in ids if x is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11] and ids.count(None) == 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = dict(tuple(r) for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5, **{i: 20 for i in range(20, 26)}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def base(text):
    w = WORDS.findall(text or "")
    places = collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def judged(rows, limit, share):
    """Rows of stats, base_failed, kept, lost words and the text's digest. Lines are counted over the documents of a host."""
    norm = lambda x: re.sub(r"[ \t\n\x0b-\r]+", " ", x.lower()).strip(" ")
    having = collections.defaultdict(set)
    for i, t, s in rows:
        for x in {norm(y) for y in (t or "").split("\n")} - {""}:
            having[s, x].add((i, t or ""))
    out = []
    for i, t, s in rows:
        st, lines = base(t), (t or "").split("\n")
        above = [y for y in lines if norm(y) and len(having[s, norm(y)]) > limit]
        lost = sum(len(norm(y).split(" ")) for y in above)
        failed = st[0] < 50 or 100 * st[4] > 50 * st[0]
        left = "\n".join(y for y in lines if y not in above)
        out.append((str(i), *st, failed, not failed and not lost > share * st[0], lost, hashlib.md5(left.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limit,share", [(20, 0.8), (1, 0.05)])
def test_line_rules(docs, odd, limit, share):
    for df in (docs, odd):
        got = line_rules.rules(df, line_limit=limit, lost_share=share)
        rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
        mine = sorted((str(r["doc_id"]), *(r[x] for x in line_rules.STATS), r["base_failed"], r["kept"], r["lost_words"], r["cleaned_md5"]) for r in got.collect())
        assert mine == judged(rows, limit, share)
        kept = line_rules.accepted(df, line_limit=limit, lost_share=share)
        assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(x[0] for x in mine if x[7])


def test_copies_of_a_page_count_as_documents(spark):
    rows = [(i, "a line\nof one page", "h") for i in range(21)] + [(0, "a line\nof one page", "h"), (50, "a line\nof another page", "h"), (51, "a line\nof another page", "g")]
    got = line_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"]: r["lost_words"] for r in got.collect()} == {**{i: 5 for i in range(21)}, 50: 2, 51: 0}


@pytest.mark.parametrize("mark", ["\u0085", "\u2028", "\u2029", " "])
def test_a_line_with_a_mark_at_the_end_of_a_text(spark, mark):
    """Such a line is counted and removed as one line, with its mark."""
    rows = [(i, f"own {i}\nshared line {mark}", "h") for i in range(30)]
    got = line_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    words = 2 + (mark != " ")
    assert {(r["lost_words"], r["cleaned_md5"]) for r in got} == {(words, hashlib.md5(f"own {i}".encode()).hexdigest()) for i in range(30)}


def test_line_rules_of_nothing(none):
    assert line_rules.rules(none).count() == 0 and line_rules.accepted(none).count() == 0


def test_frequent_lines_are_removed(spark):
    rows = [(i, f"Own line {i} here\n Shared   LINE\nshared line", "h" if i < 5 else "g") for i in range(6)] + [(9, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_rules.cleaned(df, line_limit=3).collect()}
    assert got == {**{i: f"Own line {i} here" for i in range(5)}, 5: rows[5][1], 9: None}


def test_mixing_equals_sql(spark, sf):
    same(QUERIES["op3_mixing"](spark, sf), connect(sf), SQL["op3_mixing"])
    explained = QUERIES["op3_mixing"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in explained and "Arrow" not in explained


def mixed(df):
    size = mixing.word_count(F.col("text"))
    return mixing.mix(df, size, mixing.plain_share(F.col("text"), size))


@pytest.mark.parametrize("buckets", [1, 4, 1024])
def test_mix_comes_near_its_targets(spark, buckets):
    rows = [(i, "w " * (1 + i % 13), f"s{(i * i) % 5}" if i % 5 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = mixing.word_count(F.col("text"))
    got = mixing.mix(df, size, F.lit(1.0), buckets=buckets).collect()
    total = sum(r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 13 and v[0]["target"] <= 3 * v[0]["source_size"] + 1e-9
        whole = int(v[0]["target"] // v[0]["source_size"])
        assert {r["taken"] // r["size"] for r in v} <= {whole, whole + 1} and all(r["taken"] <= 3 * r["size"] for r in v)


def test_a_range_is_cut_until_it_is_small(spark, monkeypatch):
    """Most keys lie close together, as at a low weight: the result is that of one sort."""
    rows = [(i, "w " * (1 + i % 5), "s", 0.05 if i % 10 else 1.0) for i in range(900)] + [(None, "n n", "t", 1.0)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    size = mixing.word_count(F.col("text"))
    want = sorted(map(str, mixing.mix(df, size, F.col("w")).select("doc_id", "source", "size", "taken").collect()))
    monkeypatch.setattr(mixing, "SORTED", 3)
    rounds, one = [], mixing._narrowed
    monkeypatch.setattr(mixing, "_narrowed", lambda *a: rounds.append(1) or one(*a))
    got = mixing.mix(df, size, F.col("w"), buckets=4)
    assert sorted(map(str, got.select("doc_id", "source", "size", "taken").collect())) == want and len(rounds) > 3


def test_mix_of_odd_rows(odd, none):
    got = mixed(odd)
    assert got.count() == odd.count() and mixed(none).count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, mixed(odd.repartition(7)).collect()))
    assert {r["taken"] for r in got.where("size = 0").collect()} == {0}
    again = mixing.repeated(got, odd.columns)
    assert again.columns == odd.columns and again.count() == sum(r["taken"] // r["size"] for r in got.collect() if r["size"])


def test_fingerprints(docs, odd, monkeypatch):
    monkeypatch.setattr(minhash, "RANGE_BYTES", 30_000)
    for df in (docs, odd):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        want = []
        for k, (i, t) in enumerate(rows):
            e = t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2]
            want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()))
        got = minhash.fingerprints(df).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        texts = {t: f for t, f in df.select("text", minhash.fingerprint_udf()(F.col("text"))).collect()}
        assert len({(r["doc_id"], r["fingerprint"]) for r in got} - {(r["doc_id"], texts[r["text"]]) for r in df.collect()}) == 0


def test_minima_equal_plain_python():
    """Each permutation's least value over the shingles' hashes, by loops; an order of words gives another shingle."""
    text = "a b c d e f g h a b c d e"
    (hashes, _), n = minhash.grams(minhash.words([text.encode()]), 5), 128
    assert len(hashes) == 9 and len(set(hashes.tolist())) == 8  # one shingle comes twice
    want = [min((int(h >> np.uint64(32)) * int(minhash._A[k]) + int(minhash._B[k])) % 2**32 for h in hashes) for k in range(n)]
    assert minhash.signatures([text.encode()])[0].tolist() == want
    assert minhash.names(minhash.kept(minhash.signatures([text.encode()]))) == ["".join(f"{x % 2**16:04x}" for x in want)]


def test_likeness_is_that_of_the_fingerprints(spark, sf):
    """near_edited and near_next from the returned texts; component_id by all pairs."""
    rows = sorted(QUERIES["op9_minhash"](spark, sf).collect(), key=lambda r: -r["doc_id"])
    share = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 512, 4)) / 128
    for r, x in zip(rows, [*rows[1:], rows[0]]):
        assert (r["near_edited"], r["near_next"]) == (share(r["fingerprint"], r["edited_fingerprint"]), share(r["fingerprint"], x["fingerprint"]))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {(str(r["doc_id"]), str(r["component_id"])) for r in rows} == {(i, c) for i, _, c in linked([(r["doc_id"], r["text"]) for r in docs])}


def test_fingerprints_of_one_and_none(spark, none):
    one = minhash.fingerprints(spark.createDataFrame([(4, "a b c d e f")], "doc_id long, text string")).first()
    assert (one["n_chars"], one["near_next"]) == (11, 1.0) and minhash.fingerprints(none).count() == 0


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 1200)]
        cut = int(1200 * share)
        a, b = " ".join(words), " ".join(words[:cut] + [f"v{x}" for x in range(1200 - cut)])
        s, t = shingles(a), shingles(b)
        sign = minhash.signatures([a.encode(), b.encode()])
        assert abs(minhash.likeness(sign[:1], sign[1:])[0] - len(s & t) / len(s | t)) < 0.15


def test_bands_find_the_verified_links(docs):
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(docs).collect()}
    want = {int(i): int(c) for i, _, c in linked([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert {i: got.get(i, i) for i in want} == want


def test_near_copies_write_few_tables(spark, monkeypatch):
    """A table is a job of its own with a task for each partition, whatever little it has."""
    tables, stored = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda *a, **b: tables.append(0) or stored(*a, **b))
    rows = list(enumerate(edited_copies(4, edits=1)))
    got = minhash.near_copies(spark.createDataFrame([*rows, (4, rows[3][1]), (5, ""), (5, rows[0][1])], "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(1, 6)}
    assert len(tables) <= 24, len(tables)


def test_chunks_of_texts_without_words(spark):
    """A task whose texts have no words has a chunk without shingles."""
    rows = spark.createDataFrame([(1, ""), (2, None), (3, " \n")], "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in jaccard_join.join(rows).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_copies_of_a_salted_table_are_not_broadcast(spark, capsys):
    left, right = spark.range(1000).selectExpr("id % 7 AS k", "id"), spark.range(7).selectExpr("id AS k", "id * 2 AS v")
    for few in (False, True):
        out = storage.salted_join(left, right, ["k"], "id", "inner", few=few).select("id", "v")
        assert sorted(map(tuple, out.collect())) == [(i, i % 7 * 2) for i in range(1000)]
        out.explain()
        assert ("BroadcastHashJoin" in capsys.readouterr().out) == few


def class_sets(spark, n=60, size=40, shift=12):
    """Sets that overlap with their neighbours only."""
    rows = [(k, size, list(range(k * shift, k * shift + size))) for k in range(n)]
    return spark.createDataFrame(rows, "cid long, n int, shingles array<long>")


def test_pairs_between_components_shuffle_their_rows_once(spark, capsys):
    classes = class_sets(spark, size=40, shift=5)
    lists = classes.select(F.explode("shingles").alias("key"), "cid", "n", F.lit(True).alias("heavy"), F.col("cid").alias("component"))
    members = storage.written(lists.join(lists.groupBy("key").agg(F.count("*").alias("size")), "key"))
    pairs = jaccard_join.pairs_between(members, classes, 60).select("x", "y").distinct()
    found = {(min(p), max(p)) for p in map(tuple, pairs.collect())}
    near = {(a, a + d) for d in (1, 2) for a in range(60 - d)}  # 35 / 45 and 30 / 50 shared
    assert near <= found
    limit = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        merged = jaccard_join.pairs_between(members, classes, 60)
        assert len(merged.collect()) >= len(near)
        merged.explain()
    finally:
        spark.conf.set(limit, held)
    assert "ReusedExchange" in capsys.readouterr().out


def test_only_lists_stay_of_the_tables_of_candidates(spark):
    folder = storage.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with storage.temporary(spark):
        classes = class_sets(spark)
        assert jaccard_join.candidates(classes, 60).count() > 0
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before
