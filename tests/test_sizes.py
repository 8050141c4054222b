"""What a task holds follows from the texts, not from the session's settings."""

from oracle import connect, same
from pyspark.sql import functions as F

from quillstone.operators import rules
from quillstone.plans import queries
from quillstone.plans.queries import QUERIES, SQL


def test_queries_are_dealt_by_their_texts(spark, sf, monkeypatch):
    """Whatever the number of shuffle partitions (4 here), which a large table outgrows."""
    monkeypatch.setattr(rules, "TASK_CHARS", 20_000)
    assert QUERIES["rule_topk"](spark, sf).rdd.getNumPartitions() > 4
    same(QUERIES["rule_topk"](spark, sf), connect(sf), SQL["rule_topk"])
    rows = QUERIES["training_inputs"](spark, sf)
    assert rows.rdd.getNumPartitions() > 4 and rows.count() == rows.select("doc_id").distinct().count()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rules.dealt(none, "doc_id", F.col("text")).count() == 0


def test_python_takes_few_texts_at_a_time(spark, sf):
    names = {"chunk_recursive", "chunk_paragraph", "evidence_excerpt"}
    settings = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    for name in names:
        for x in settings:
            spark.conf.unset(x)
        QUERIES[name](spark, sf)
        assert int(spark.conf.get(settings[0])) <= 1024 and int(spark.conf.get(settings[1])) <= 4 << 20


def test_json_lines_are_as_many_files_as_the_texts_need(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "FILE_CHARS", 50_000)
    found = QUERIES["jsonl_roundtrip"](spark, sf)
    assert len(set(found.inputFiles())) > 4
    same(found, connect(sf), SQL["jsonl_roundtrip"])
