"""Documents come back from JSON Lines in place, also those that lack a field."""

from oracle import connect, same

from quillstone.plans.queries import QUERIES, SQL


def test_documents_without_a_text_a_language_or_an_id(spark, tmp_path):
    """Documents without a text take no place; others keep theirs without a language or an id."""
    rows = [(i, f"text {i}", "en") for i in range(40)]
    rows += [(-5, None, "en"), (-4, "", "en"), (50, "no language", None), (51, "a blank one", "  "), (None, "no id", "en"), (60, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["jsonl_roundtrip"](spark, str(tmp_path))
    assert found.count() == 43
    same(found, connect(tmp_path), SQL["jsonl_roundtrip"])


def test_a_text_longer_than_the_parser_takes_by_itself(spark, tmp_path):
    rows = [(1, "ab " * 7_000_000, "en"), (2, "short", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["jsonl_roundtrip"](spark, str(tmp_path)), connect(tmp_path), SQL["jsonl_roundtrip"])
