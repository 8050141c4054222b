import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillstone.llm import bpe, jaccard_join, language_id, line_rules, mixing


def surely(x, languages):
    """Whether a language is told: the best one's share is a quarter above the mean of the others'."""
    return x["lang_pred"] != "und" and x["score"] * (languages - 1) >= 1.25 * (1 - x["score"])


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "jaccard_join", "mixing", "bpe"]


def test_stages_return_documents_and_decide(spark, sf, docs, tmp_path):
    held = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, held, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert out.columns == docs.columns
        ids, before = [r["doc_id"] for r in out.collect()], {r["doc_id"] for r in held.collect()}
        if name == "language_id":
            model = language_id.train(held)
            told = language_id.identify(held, model).collect()
            assert sorted(ids) == sorted(r["doc_id"] for r in told if surely(r["language"], len(model.languages)))
        if name == "quality_rules":
            assert sorted(ids) == sorted(r["doc_id"] for r in line_rules.rules(held).where("kept").collect())
        if name == "jaccard_join":
            assert sorted(ids) == sorted(r["doc_id"] for r in jaccard_join.join(held).where("doc_id = component_id").collect())
        if name == "mixing":
            size = mixing.word_count(held["text"])
            taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(held, size, mixing.plain_share(held["text"], size)).collect()}
            assert {i: ids.count(i) for i in before} == taken
        held = out
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = corpus_pipeline.STAGES[-1][1](spark, held, sf).collect()
    sizes = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in held.collect()}
    assert len(last) == held.count() and all(r["n_tokens"] == sizes[r["doc_id"]] for r in last)


def test_lines_above_the_limit_leave_the_stage(spark, sf):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"{own(i, 60)}\n Shared   LINE\nshared line\nlast {i}", "h", 0) for i in range(21)]
    rows += [(30, f"{own(30, 60)}\nshared line", "g", 7), (31, f"{own(31, 9)}\nshared line", "h", 0), (32, own(32, 2) + "\nshared line" * 30, "h", 0)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, n_chars long")
    out = corpus_pipeline.quality_rules(spark, df, sf)
    assert out.schema == df.schema
    want = [(i, f"{own(i, 60)}\nlast {i}", "h") for i in [0, *range(21)]]
    want = sorted([*((*r, len(r[1])) for r in want), rows[21]])
    assert sorted(tuple(r) for r in out.collect()) == want


def test_run_is_its_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_texts_of_no_language_leave(spark, sf, docs):
    rows = [(10**6 + i, t, None, "x", len(t)) for i, t in enumerate(["zqx", "... 123", "Von. Das ist ein ganz gew\u00f6hnlicher Satz und der n\u00e4chste auch"])]
    some = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.languages(spark, some, sf).collect()}
    model = language_id.train(some)
    scores = {r["doc_id"]: r["language"] for r in language_id.identify(some, model).collect()}
    assert 10**6 + 1 not in kept and len(kept) >= docs.count() - 3
    assert kept == {i for i, x in scores.items() if surely(x, len(model.languages))}


@pytest.mark.parametrize("languages", [["en"], ["en", "de"], ["en", "de", "es", "fr"]])
def test_documents_of_any_number_of_languages_stay(spark, sf, docs, languages):
    some = docs.where(docs["lang"].isin(languages) & docs["text"].rlike(r"\p{L}"))
    kept = corpus_pipeline.languages(spark, some, sf).count()
    assert kept == some.count() if languages == ["en"] else kept >= 0.95 * some.count()


def test_a_column_named_size_passes_the_mix(spark, sf):
    """Columns of documents may have the names that the mix adds; their values stay."""
    rows = [(i, "w " * (3 + i % 5), f"s{i % 3}", 1000 + i, -i, i / 7, "e") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, taken int, target double, end_key string")
    out = corpus_pipeline.source_mix(spark, df, sf)
    assert out.schema == df.schema and out.count() > 0
    assert all(tuple(r) == rows[r["doc_id"]] for r in out.collect())


def test_odd_and_empty_documents(spark, odd, none, sf):
    for df in (odd, none):
        out = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf)
            assert out.columns == df.columns
            rows = out.collect()
            out = spark.createDataFrame(rows, df.schema)
        assert bpe.encode(out, public_tokenizers.path("word_bpe_49k.json")).count() == len(rows)
