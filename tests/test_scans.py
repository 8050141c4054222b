"""Scans in two levels against plain loops: one hot group, an outlier, ties and nulls."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstone.operators import ranks, spans, state


def crowded(kind, n=3000):
    """Values of one group: an outlier and nearly all others in a small part of the range; some null and some equal."""
    rng = random.Random(n)
    out = []
    for i in range(n):
        v = rng.choice([rng.randrange(500), 77, 10**6 + rng.randrange(40)]) if kind != "double" else rng.gauss(0, 1)
        out.append(None if i % 97 == 0 else v)
    out[5] = {"long": -(2**40), "double": 1e12, "time": 0}[kind]
    if kind == "time":
        start = datetime(2024, 1, 1)
        out = [None if v is None else start + timedelta(seconds=v) for v in out]
        out[5] = datetime(1970, 1, 1)
    return [("hot", i, v) for i, v in enumerate(out)] + [("b", n + i, v) for i, v in enumerate(out[:50])] + [(None, 9999, out[7])]


@pytest.fixture(params=["long", "double", "time"])
def table(request, spark):
    rows = crowded(request.param)
    return rows, spark.createDataFrame(rows, f"g string, k long, v {'timestamp' if request.param == 'time' else request.param}")


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] if r[2] is not None else 0, r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("most", [10**6, 200])
def test_numbers_sums_and_maxima(table, most):
    rows, df = table
    how = {"cells": 64, "most": most}
    value = F.when(F.col("k") % 5 != 0, F.col("k") * 37 % 1009)
    got = ranks.numbered(df, ["v", "k"], ["g"], "n", **how).select("g", "k", "n").collect()
    sums = ranks.running_sum(df, value, ["v", "k"], ["g"], "s", **how).select("k", "s").collect()
    tops = ranks.running_max(df, value, ["v", "k"], ["g"], "m", **how).select("k", "m").collect()
    before = ranks.running_max(df, value, ["v", "k"], ["g"], "m", before=True, **how).select("k", "m").collect()
    want_n, want_s, want_m, want_b = {}, {}, {}, {}
    for own in groups(rows).values():
        total, top = 0, None
        for n, (_, k, _) in enumerate(own, 1):
            want_n[k], want_b[k] = n, top
            if k % 5:
                x = k * 37 % 1009
                total, top = total + x, x if top is None else max(top, x)
            want_s[k], want_m[k] = total, top
    assert {r["k"]: r["n"] for r in got} == want_n and {r["k"]: r["s"] for r in sums} == want_s
    assert {r["k"]: r["m"] for r in tops} == want_m and {r["k"]: r["m"] for r in before} == want_b


def test_no_cell_is_crowded_but_for_ties(table):
    rows, df = table
    placed = ranks.celled(df, "v", ["g"], cells=64, most=200)
    sizes = {(r["g"], r["__cell"]): r for r in placed.groupBy("g", "__cell").agg(F.count("*").alias("n"), F.countDistinct("v").alias("values")).collect()}
    assert sum(r["n"] for r in sizes.values()) == len(rows) and len(sizes) > 15
    for r in sizes.values():
        assert r["n"] <= 200 or r["values"] <= 1 or r["__cell"] is None
    ordered = placed.where("g = 'hot' AND v IS NOT NULL").groupBy("__cell").agg(F.min("v").alias("a"), F.max("v").alias("z")).orderBy("__cell").collect()
    assert all(x["z"] < y["a"] for x, y in zip(ordered, ordered[1:]))


def test_a_group_that_is_small_is_not_cut(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "g string, v long")
    assert "__cell" not in ranks.celled(df, "v", ["g"]).columns
    assert ranks.numbered(df.limit(0), ["v"], ["g"], "n", most=0).count() == 0
    assert ranks.running_max(df.limit(0), F.col("v"), ["v"], ["g"], "n", most=1).count() == 0


@pytest.mark.parametrize("most", [10**6, 100])
def test_intervals_of_one_group(spark, most):
    rng = random.Random(4)
    rows = [(1, s := rng.randrange(100_000), s + rng.choice([0, 5, 60, 900])) for _ in range(2000)] + [(1, 0, 70_000 - 1)] * 3 + [(2, 5, 9)]
    got = spans.merged_intervals(spark.createDataFrame(rows, "g int, s int, e int"), "g", "s", "e", gap=20, cells=16, most=most)
    want = []
    for g, s, e in sorted(rows):
        if want and want[-1][0] == g and s <= want[-1][2] + 20:
            want[-1] = (g, want[-1][1], max(want[-1][2], e))
        else:
            want.append((g, s, e))
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("most,size", [(10**6, 4096), (50, 16)])
def test_one_user_with_all_progress_and_turns(spark, most, size):
    rng = random.Random(1)
    events = [(7, i, rng.randrange(10**6), rng.choice([None, -5.0, 3.5, 180.0, rng.random() * 90])) for i in range(900)]
    df = spark.createDataFrame(events, "user_id long, event_id long, ts long, value double")
    got = {r["event_id"]: r["percentage"] for r in state.running_progress(df, "user_id", ["ts", "event_id"], F.col("value"), cells=8, most=most).collect()}
    plain = {r["event_id"]: r["p"] for r in df.selectExpr("event_id", "value").withColumn("p", state.percentage(F.col("value"))).collect()}
    top = None
    for _, i, _, _ in sorted(events, key=lambda r: (r[2], r[1])):
        top = plain[i] if top is None else top if plain[i] is None else max(top, plain[i])
        assert got[i] == top
    turns = [(1, t, "user" if rng.random() < 0.6 else "assistant", f"m{t}") for t in range(300)]
    messages = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = state.exchanges(messages, size=size, most=most)
    want = [(t, x, turns[t + 1][3] if t + 1 < 300 and turns[t + 1][2] == "assistant" else None) for _, t, role, x in turns if role == "user"]
    assert sorted((r["turn"], r["user"], r["assistant"]) for r in pairs.collect()) == want
    told = {r["turn"]: [tuple(x) for x in r["history"]] for r in state.with_history(pairs, keep=5, size=size, most=most).collect()}
    assert told == {t: [(u, a) for _, u, a in want[max(0, i - 5) : i] if a is not None] for i, (t, _, _) in enumerate(want)}


def test_chunks_overlap_by_what_a_window_needs(spark):
    rows = spark.range(100).select("id", F.lit("g").alias("g"))
    got = ranks.overlapping(rows, ["id"], ["g"], 3, 2, size=10).groupBy("__chunk").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count_if("__copy").alias("n")).collect()
    assert {r["__chunk"]: r["ids"] for r in got if r["__chunk"] < 10} == {c: list(range(max(0, c * 10 - 3), min(100, c * 10 + 12))) for c in range(10)}
    with pytest.raises(ValueError):
        ranks.overlapping(rows, ["id"], ["g"], 11, 0, size=10)
