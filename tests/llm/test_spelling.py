import collections
import random
import re
import zlib

import numpy as np
import pytest

from quillstone.llm import spelling
from quillstone.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    out = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if n >= 2 and len(w) >= 7}


def neighbours(words):
    """Near words by taking out each place of each word."""
    near = collections.defaultdict(set)
    shared = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            shared[i, less].add(w)
            if less in words:
                near[w].add(less), near[less].add(w)
    for some in shared.values():
        for w in some:
            near[w] |= some - {w}
    return near


def variants(rows):
    c = counts(rows)
    near, form = neighbours(c), {}
    for w, n in c.items():
        best = min(near[w], key=lambda x: (-c[x], x), default=None)
        if best and c[best] >= 10 * n:
            form[w] = best
    out = {}
    for w, n in c.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), c[form[w]] if w in form else None)
    return out


def found(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_query_equals_plain_loops(spark, sf, docs):
    got = QUERIES["op11_spelling"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(got) == variants([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("most", [2, 16, 256])
def test_any_size_of_tile_is_exact(spark, monkeypatch, most):
    """Groups far above the size: long common beginnings and ends, so that windows are halved to single places."""
    rng = random.Random(most)
    words = {f"{a}{''.join(rng.choice('abé') for _ in range(rng.randint(2, 4)))}{b}" for a in ("commonbeginning", "x") for b in ("sharedend", "yyyyyy") for _ in range(40)}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ababababa", "þþþþþþþ", "þþþþþþþþ", "ÀÀÀÀÀÀÀ", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500}
    rows = [(w, rng.choice([1, 3, 10, 100, 1000, 10_000])) for w in sorted(words)]
    monkeypatch.setattr(spelling, "TILE", most)
    near = neighbours(words)
    parts = spelling.near_words(spark.createDataFrame(rows, "word string, n long")).collect()
    got = collections.Counter()
    for r in parts:
        got[r["word"]] += r["n_near"]
        assert r["best"] in near[r["word"]]
    assert got == {w: len(x) for w, x in near.items() if x}
    n = dict(rows)
    best = {r["word"]: (r["form"], r["form_n"]) for r in spelling.forms(spark.createDataFrame(rows, "word string, n long"), 1).collect()}
    for w in words:
        want = min(near[w], key=lambda x: (-n[x], x), default=None)
        assert best[w] == ((want, n[want]) if want and n[want] >= n[w] else (None, None))


def test_no_group_is_large(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 91)
    seen = []
    pack = spelling.tile
    monkeypatch.setattr(spelling, "tile", lambda m, words, n, group, a, b: seen.append(max(np.bincount(group))) or pack(m, words, n, group, a, b))
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    words = sorted({f"prefix{x}{y}ending" for x in letters[:40] for y in letters[:40]})
    assert len(words) == 1600
    batch = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    parts = spelling.near_words(batch).groupBy("word").sum("n_near").collect()
    assert {r[1] for r in parts} == {78} and len(parts) == 1600


def test_chains_of_forms(spark):
    rows = [("abcdefgh", 10_000), ("abcdefg", 1000), ("abcdefx", 100), ("abcdexx", 10), ("abcdxxx", 1), ("zzzzzzz", 5)]
    near = spelling.forms(spark.createDataFrame(rows, "word string, n long")).cache()
    assert {r["word"]: r["form"] for r in near.collect()} == {"abcdefgh": None, "abcdefg": "abcdefgh", "abcdefx": "abcdefg", "abcdexx": "abcdefx", "abcdxxx": "abcdexx", "zzzzzzz": None}
    assert {r["word"]: r["root"] for r in spelling.roots(near).collect()} == dict.fromkeys(["abcdefg", "abcdefx", "abcdexx", "abcdxxx"], "abcdefgh")


def test_odd_texts(spark, odd, none, monkeypatch):
    for size in (1 << 20, 100):
        monkeypatch.setattr(spelling, "PIECE", size)
        assert found(spelling.variants(odd)) == variants([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert spelling.variants(none).count() == 0
    text = "one Wonderful wonderful, wonderFul×day ÀÉÎõüÿß " * 30
    assert list(spelling.pieces(text, 10)) != [text] and "".join(spelling.pieces(text, 10)) == text
    for piece in spelling.pieces(text, 10):
        assert re.findall("[A-Za-zÀ-ÿ]+", piece)
