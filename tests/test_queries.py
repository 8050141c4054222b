import json
import math
import re
from collections import Counter

import pytest
from oracle import connect, same

from quillstone.operators import rules
from quillstone.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), SQL[name])


def test_paragraph_chunks_equal_a_plain_fold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want, seen = [], set()
    for r in docs:
        chunks, held = [], ""
        for p in (x.strip() for x in r["text"].split("\n")):
            if not p:
                continue
            if len(held) + len(p) + 1 <= 1200:
                held = (held + "\n" + p).strip()
            else:
                if held:
                    chunks.append(held)
                while len(p) > 1200:
                    chunks.append(p[:1200])
                    p = p[1200:]
                held = p
        chunks += [held] if held else []
        for i, t in enumerate(chunks):
            plain = re.sub(r"\s+", "", t).lower()
            if len(plain) >= 20 and plain not in seen:
                seen.add(plain)
                want.append((f"HK-{r['doc_id']:03d}-{i + 1:02d}", t))
    got = QUERIES["chunk_paragraph"](spark, sf).select("rule_id", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def pieces(text, size, overlap, marks):
    """The recursive splitter by the book: lists of parts, merged with overlap."""
    mark = next((m for m in marks if m in text), marks[-1])
    rest = marks[marks.index(mark) + 1 :]
    parts = [p for p in re.split(f"(?={re.escape(mark)})", text) if p]
    out, good = [], []

    def merge():
        window = []
        for p in good:
            if window and sum(map(len, window)) + len(p) > size:
                out.append("".join(window))
                while sum(map(len, window)) > overlap or (window and sum(map(len, window)) + len(p) > size):
                    window.pop(0)
            window.append(p)
        out.append("".join(window))
        good.clear()

    for p in parts:
        if len(p) < size:
            good.append(p)
            continue
        merge()
        out.extend(pieces(p, size, overlap, rest) if rest else [p])
    merge()
    return [x.strip() for x in out if x.strip()]


def test_recursive_samples_equal_the_plain_splitter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(r["doc_id"], i, p) for r in docs for i, p in enumerate(pieces(r["text"], 1000, 100, rules.SEPARATORS)) if len(p) >= 100]
    got = QUERIES["chunk_recursive"](spark, sf).collect()
    assert sorted((r["doc_id"], r["chunk"], r["input"]) for r in got) == sorted(want) and all(r["input"] == r["output"] for r in got)


def excerpt(content, words, limit):
    """Marks which characters are kept, one budget, left to right."""
    content = content.strip()
    n = len(content)
    if n <= limit:
        return content
    gap = "\n……中间非关键内容已省略……\n"
    head, tail = min(650, max(200, limit // 3)), min(500, max(150, limit // 4))
    hits = []
    for w in words:
        at, times = content.find(w), 0
        while at >= 0 and times < 2:
            hits.append([max(0, at - 130), min(n, at + len(w) + 220)])
            at, times = content.find(w, at + len(w)), times + 1

    def union(spans):
        out = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1] + 30:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    budget, kept = limit - head - tail - 2 * len(gap), [[0, head], [n - tail, n]]
    for a, b in union(hits):
        a, b = max(a, head), min(b, n - tail)
        if b <= a or budget <= 0:
            continue
        b = min(b, a + budget)
        kept.append([a, b])
        budget -= b - a + len(gap)
    return gap.join(x for x in (content[a:b].strip() for a, b in union(kept)) if x).strip()[:limit]


def test_excerpts_and_training_questions_equal_plain_rules(spark, sf):
    words = ["idiot", "license", "password"]
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: excerpt(r["text"], words, 2200) for i, r in docs.items()}
    assert {r["doc_id"]: r["excerpt"] for r in QUERIES["evidence_excerpt"](spark, sf).collect()} == want
    rows = {r["doc_id"]: r for r in QUERIES["training_inputs"](spark, sf).collect()}
    con = connect(sf)
    known = {i: (t, d, label, basis, sure, cat) for i, t, d, label, basis, sure, cat in con.execute(SQL["first_present"]).fetchall()}
    assert rows.keys() == {i for i, x in known.items() if x[2] and x[3]}
    rule = dict(con.execute("SELECT item_id, text FROM benchmark").fetchall())
    grams = lambda t: Counter(t[k : k + 2] for k in range(len(t) - 1)) if len(t) > 1 else Counter([t] if t else [])
    plain = lambda t: re.sub(r"\s+", "", t).lower()
    bags = {i: grams(plain(t)) for i, t in rule.items()}
    df = Counter(t for b in bags.values() for t in b)
    for i, r in rows.items():
        asked, told = json.loads(r["input"]), json.loads(r["output"])
        title, date, label, basis, sure, cat = known[i]
        assert (asked["题名"], asked["成文日期"], asked["门类"], asked["正文"], asked["正文是否节选"]) == (title, date, cat, want[i], len(want[i]) < len(docs[i]["text"]))
        short = basis.rstrip("。.,;；")
        assert told == {"审核结果": label, "审核依据": f"依据标准，{short}", "置信度": sure, "思考过程": short}
        own = grams(plain(f"{title} {date} {cat}\n\n{docs[i]['text'][:8000]}"))
        score = {k: sum(min(n, own[t]) * math.log((len(rule) + 1) / (df[t] + 1) + 1) for t, n in b.items() if t in own) for k, b in bags.items()}
        best = sorted((k for k in score if score[k] > 0), key=lambda k: (-round(score[k], 8), k))[:3]
        assert [x["rule_id"] for x in asked["候选规范条款"]] == [f"HK-{k:03d}-01" for k in best] and all(x["内容"] == rule[k] for x, k in zip(asked["候选规范条款"], best))


def test_every_query_is_compared():
    """Those without SQL have a test of their own above."""
    assert set(QUERIES) - set(SQL) == {"chunk_paragraph", "chunk_recursive", "evidence_excerpt", "training_inputs"}


def test_lineage_knows_keys_of_any_size(spark, tmp_path):
    rows = [(1, 2_000_000), (2, 2_000_001), (4, 3), (0, 5), (20_000, 8)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    same(QUERIES["model_lineage"](spark, str(tmp_path)), connect(str(tmp_path)), SQL["model_lineage"])


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "item_id", "rank", "score"]
