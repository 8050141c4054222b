import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import labels as L
from quillstone.functions import text as X
from quillstone.operators import prepare, rules
from quillstone.plans.queries import QUERIES


def one(spark, column, *values, schema="a string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_bigrams(spark):
    assert one(spark, X.bigrams(X.normalized(F.col("a"))), None, " ", "a", "A b", "a😀中") == [[], [], ["a"], ["ab"], ["a😀", "😀中"]]


def test_missing_and_first_present(spark):
    assert one(spark, X.is_missing(F.col("a")), None, "", " NULL ", "<null>", "x") == [True, True, True, True, False]
    assert one(spark, X.first_present(F.lit("nil"), F.col("a"), default="d"), " y ", "none", None) == ["y", "d", "d"]


def test_partial_date(spark):
    assert one(spark, X.partial_date(F.col("a")), "20240000", "20240500", "20240506", "2024", None) == ["2024", "2024-05", "20240506", "2024", None]


def test_confidence(spark):
    assert one(spark, X.confidence(F.col("a")), "85%", "8.25", "-1", "8d", "1_0", None) == [8.5, 8.2, 0.0, 8.0, 8.0, 8.0]


def test_bounded_falls_back_instead_of_clamping(spark):
    assert one(spark, X.bounded(F.col("a"), 1, 8, 2, "int"), "4", "9", "x", None) == [4, 2, 2, 2]


def test_rule_id_is_not_cut(spark):
    assert one(spark, X.rule_id(F.lit("hk"), F.col("a"), F.lit(3)), 7, 12345, schema="a int") == ["HK-007-03", "HK-12345-03"]


def test_hash_bucket(spark):
    import hashlib

    assert one(spark, X.hash_bucket(F.col("a")), "甲", "b") == [int(hashlib.sha1(x.encode()).hexdigest()[:8], 16) % 10000 for x in ("甲", "b")]


def test_fixed_chunks(spark):
    assert one(spark, X.fixed_chunks(F.col("a"), 4, 1), "", "abc", "abcdefg", "abcdefgh") == [[], ["abc"], ["abcd", "defg"], ["abcd", "defg", "gh"]]


def test_merged_spans(spark):
    rows = [([(50, 60), (0, 10), (35, 40), (200, 210)],)]
    got = spark.createDataFrame(rows, "a array<struct<start:int,end:int>>").select(X.merged_spans(F.col("a"))).first()[0]
    assert [tuple(x) for x in got] == [(0, 60), (200, 210)]


def test_labels(spark):
    assert one(spark, L.open_label(F.col("a")), "kf", "应开放", "不开放", "不开放吗", "?", None) == ["开放", "开放", "控制", None, None, None]
    assert one(spark, L.period_label(F.col("a")), "定期30年", "永久或10年", "x") == ["30年", "永久", None]


def test_inferred_result(spark):
    assert one(spark, L.inferred(F.col("a"), L.profile("hk")), "秘密、工资，公开", "公告", "") == ["控制", "开放", "开放"]
    assert one(spark, L.inferred(F.col("a"), L.profile("jd")), "土地产权", "日常事务", "x") == ["60年", "10年", "30年"]


def test_unknown_profile():
    with pytest.raises(ValueError):
        L.profile("xx")


def test_paragraphs():
    assert rules.paragraphs("a\n\nb\n \nc", 3) == ["a\nb", "c"]
    assert rules.paragraphs("x" * 2500, 1200) == ["x" * 1200, "x" * 1200, "x" * 100]
    assert rules.paragraphs("x" * 1200, 1200) == ["x" * 1200]
    assert rules.paragraphs("", 1200) == []


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab\n。，！", max_size=300))
def test_recursive_chunks_lose_nothing(text):
    found = rules.recursive_chunks(text, 20, 0)
    assert re.sub(r"\s", "", "".join(found)) == re.sub(r"\s", "", text)
    assert all(len(x) <= 20 or not any(m in x[1:] for m in rules.SEPARATORS) for x in found)


def test_recursive_chunks_share_their_ends():
    assert rules.recursive_chunks("aaaa。bbbb。cccc", 10, 5) == ["aaaa。bbbb", "。bbbb。cccc"]
    assert rules.recursive_chunks("x" * 30 + "！yy", 10, 0) == ["x" * 30, "！yy"] and rules.recursive_chunks("", 10, 0) == []


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab秘密工资 ", max_size=6000))
def test_evidence_keeps_the_limit(text):
    got = prepare.evidence(text, L.EVIDENCE_WORDS, 600)
    assert len(got) <= 600 and (len(text.strip()) > 600 or got == text.strip())


def test_evidence_shows_what_lies_between():
    text = "h" * 1000 + "绝密" + "t" * 3000
    got = prepare.evidence(text, ["绝密"], 2200)
    assert got.startswith("h" * 650) and "绝密" in got and got.endswith("t" * 500) and prepare.OMITTED in got


def test_queries_are_named():
    assert "rule_topk" in QUERIES
