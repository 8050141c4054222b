import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.functions import labels as L
from quillstone.operators import prepare, requests, review, rules, spans, state, training_data
from quillstone.sources import attachments, jsonl
from quillstone.streaming import state as streams


def test_rule_corpus_keeps_the_first_of_equal_chunks(spark, tmp_path):
    lines = [{"input": "甲" * 30}, "bad", {"input": "甲" * 15 + " " + "甲" * 15}, {"x": 1}]
    path = tmp_path / "rules.jsonl"
    path.write_text("\n".join(["", *(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines)]))
    good, bad = jsonl.rule_lines(spark, str(path), "hk", "s")
    assert [r["line"] for r in bad.collect()] == [3, 5]
    got = rules.corpus(good, rules.paragraph_chunks(F.col("input"))).collect()
    assert [(r["rule_id"], r["text"]) for r in got] == [("HK-002-01", "甲" * 30)]


def sample(k, **more):
    out = {"审核结果": "开放", "审核依据": f"b{k}"} | more
    return json.dumps({"instruction": "i", "input": f"a{k}", "output": json.dumps(out, ensure_ascii=False)}, ensure_ascii=False)


def test_strict_load_fails_on_any_bad_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(f"{sample(1)}\n\n{sample(2)}\n")
    (tmp_path / "b.jsonl").write_text("\n".join([sample(0), "{}", *(f"[{k}" for k in range(9)), sample(1, 审核依据=" ")]))
    (tmp_path / "c.json").write_text(sample(1))
    (tmp_path / "d.jsonl").write_text("")
    load = lambda name, **how: jsonl.training_samples(spark, str(tmp_path / name), **how)
    assert sorted(r["input"] for r in load("a.jsonl").collect()) == ["a1", "a2"]
    assert json.loads(load("a.jsonl").where("input = 'a1'").first()["output"]) == {"审核结果": "开放", "审核依据": "b1", "置信度": 8.0, "思考过程": "b1"}
    assert jsonl.count_lines(spark, str(tmp_path / "a.jsonl")) == 2 and jsonl.count_lines(spark, str(tmp_path / "none")) == 0
    with pytest.raises(ValueError, match=r"^invalid samples: line 2: instruction, input or output is missing; line 3: no JSON object; (line [456]: no JSON object(; )?){3}$"):
        load("b.jsonl")
    assert [r["input"] for r in load("b.jsonl", max_samples=1).collect()] == ["a0"]  # what follows the last sample is not looked at
    for name, how in (("a.jsonl", {"min_samples": 3}), ("d.jsonl", {})):
        with pytest.raises(ValueError, match="fewer"):
            load(name, **how)
    with pytest.raises(ValueError, match="jsonl"):
        load("c.json")


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 50) for k in range(3000)]
    lines[7] = lines[2999] = ""
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = jsonl.lines_in_order(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["line"]: r["text"] for r in rows} == dict(enumerate(lines, 1))


def test_written_lines_are_read_again(spark, tmp_path):
    df = spark.createDataFrame([("i", "a\nb", "o"), ("i", "中", "")], jsonl.SAMPLE)
    jsonl.write(df, str(tmp_path / "x"), one_file=True)
    assert sorted(tuple(r) for r in spark.read.schema(jsonl.SAMPLE).json(str(tmp_path / "x")).collect()) == sorted(tuple(r) for r in df.collect())


def test_payload_is_an_object_and_own_files_come_first(spark, tmp_path):
    data = [{"record": {"tm": "t", "files": ["own"]}, "files": ["outer"]}, {"record": {"tm": "u", "files": []}, "files": ["outer"]}, {"record": {"tm": "v"}}, {"files": ["x"]}, {"record": None}]
    (tmp_path / "p.json").write_text(json.dumps({"data": data}, indent=1))
    (tmp_path / "q.json").write_text("[1]")
    got = prepare.records(prepare.payload(spark, str(tmp_path / "p.json"))).orderBy("ordinal").collect()
    assert [(r["record"]["tm"], r["files"]) for r in got] == [("t", ["own"]), ("u", ["outer"]), ("v", [])]
    with pytest.raises(Exception, match="no JSON object"):
        prepare.payload(spark, str(tmp_path / "q.json")).collect()


def test_attachments_of_any_depth_count(spark):
    """An object counts if it has a field, a list by what is in it, a text unless it stands for a missing value."""
    cases = [["a"], [" ", None], [], None, ['{"content": ""}'], ["{}"], ['[{}, [], [null, " None "]]'], ['[[{"files": []}]]'], ['[[["x"]]]'], ["[7]"], ["["], ["null"], [None, "x"]]
    got = spark.createDataFrame([(x,) for x in cases], "f array<string>").select(prepare.has_files(F.col("f"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, True, False, False, True, True, True, True, False, True]


def test_special_tokens_and_the_basis_of_labelled_text(spark):
    got = spark.createDataFrame([("开放<｜end▁of▁sentence｜> 好<pad><unk><s></s><|im_end|><|endoftext|><|end_of_sentence|>",)], "a string").select(review.cleaned_answer(F.col("a"))).first()[0]
    assert got == "开放 好"
    parse = review.Parser(L.profile("hk")).parse
    assert parse("【审核结果】控制\n【审核依据】\n【说明】涉及个人信息的内容", "")[:2] == ("控制", "【说明】涉及个人信息的内容")
    assert parse("【审核结果】控制\n【审核依据】涉及人事\n【说明】x", "想法文字内容")[1] == "依据《延期开放档案标准及范围》，想法文字内容"


def test_keyword_block_of_the_prompt(spark):
    names = ["title", "date_time", "content", "audit_result", *review.METADATA.values()]
    rows = [tuple(["t", "2024", "c", "控制", *[None] * 7, ["秘密", " 工资 "]]), tuple(["t", "2024", "c", "", *[None] * 7, []])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", keywords array<string>").withColumn("rules", F.array().cast("array<struct<rank:int,rule_id:string,source:string,text:string,score:double>>"))
    hk = [r[0] for r in df.select(review.prompt(L.profile("hk"))).collect()]
    assert "命中关键字：秘密、工资\n关键字预审结果：控制" in hk[0] and "未提供或未命中关键字" in hk[1]
    assert "关键字" not in df.select(review.prompt(L.profile("jd"))).first()[0]


def test_numbers_in_groups_of_any_spread(spark):
    from quillstone.operators.ranks import numbered

    rows = [(k, ["a", "b", None][k % 3], None if k % 11 == 0 else float(k * k % 97) if k % 7 else 1e9) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    for cells in (1, 3, 1000):
        got = {r["k"]: r["n"] for r in numbered(df, ["v", "k"], ["g"], "n", cells).collect()}
        for g in ("a", "b", None):
            own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
            assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    assert numbered(df.limit(0), ["v"], ["g"], "n").count() == 0


def test_tokenized_prompt_keeps_head_and_end(spark):
    df = spark.createDataFrame([(1, "abcdefghij", "xy"), (2, "ab", "wxyzuvwxyz"), (3, None, None)], "i int, p string, a string")
    got = {r["i"]: r for r in training_data.tokenized(df, "p", "a", lambda: (lambda t: [ord(x) for x in t]), 8, 1, "i").collect()}
    text = lambda ids: "".join(map(chr, ids))
    assert text(got[1]["input_ids"]) == "abghijxy" and got[1]["labels"] == [-100] * 6 + [120, 121]
    assert text(got[2]["input_ids"]) == "awxyzuvw"[1:8] + "\x01" or text(got[2]["input_ids"]) == "wxyzuvw\x01"
    assert got[3]["input_ids"] == [] == got[3]["labels"]


def test_split_keeps_keys_together_and_fills_an_empty_side(spark):
    rows = spark.range(200).select("id", (F.col("id") % 20).cast("string").alias("k"))
    got = training_data.split(rows, F.col("k"), 0.3, "id")
    assert got.groupBy("k").agg(F.countDistinct("part").alias("n")).where("n > 1").isEmpty()
    assert got.groupBy("part").count().count() == 2
    alone = training_data.split(rows, F.col("k"), 0.0, "id").where("part = 'validation'").collect()
    assert [r["id"] for r in alone] == [199]


def test_token_sample(spark):
    row = spark.createDataFrame([(list(range(20)), [90, 91])], "p array<int>, a array<int>")
    got = row.select(*[v.alias(k) for k, v in training_data.token_sample(F.col("p"), F.col("a"), 11).items()]).first()
    assert got["input_ids"] == [0, 1, 2, 14, 15, 16, 17, 18, 19, 90, 91]
    assert got["labels"] == [-100] * 9 + [90, 91] and got["attention_mask"] == [1] * 11


def test_distribution_violations(spark):
    counts = spark.createDataFrame([("开放", 9), (None, 1)], "label string, n long")
    got = [r[0] for r in prepare.distribution_violations(counts, "hk", min_total=11).collect()]
    assert any(x.startswith("samples: 10") for x in got) and any("控制" in x for x in got)


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 5, 7), (1, 41, 50), (1, 40, 41), (2, 0, 1)], "g int, s int, e int")
    got = {tuple(r) for r in spans.merged_intervals(rows, "g", "s", "e").collect()}
    assert got == {(1, 0, 50), (2, 0, 1)}


CASES = [
    ('<think>含秘密</think>{"审核结果":"控制","审核依据":"依据条款一二三","置信度":9.26,"思考过程":"包含秘密字样"}', "控制", 9.3),
    ("```json\n{'审核结果':'开放','审核依据':'常规公文通知','置信度':3}\n```", "开放", 6.0),
    ("{审核结果:“开放”", "开放", 8.0),
    ("审核结果：控制\n审核依据：涉及个人信息内容\n置信度：8.5", "控制", 8.5),
    ('{"审核结果":"不开放","审核依据":"涉及个人信息","置信度":8}', "控制", 8.0),
    ("", "开放", 7.0),
]


@pytest.mark.parametrize("answer,label,sure", CASES)
def test_answers(spark, answer, label, sure):
    p = L.profile("hk")
    df = spark.createDataFrame([(answer,)], "a string")
    df = df.withColumn("t", review.sanitized(review.reasoning(F.col("a")))).withColumn("b", review.cleaned_answer(review.split_thinking(F.col("a"))[1]))
    r = df.withColumn("r", review.parsed(F.col("b"), F.col("t"), p)).select(review.postprocessed(F.col("r"), F.col("t"), p).alias("r")).first()["r"]
    assert (r["result"], r["confidence"]) == (label, sure) and p.basis in r["basis"]


def test_sanitizer(spark):
    got = spark.createDataFrame([("因 为 abc 秘密 ， 控制 ；",), ("only latin",)], "a string").select(review.sanitized(F.col("a"))).collect()
    assert [r[0] for r in got] == ["因为秘密，控制", review.SANITIZED]


def test_history_is_bounded(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(30)]
    pairs = state.with_history(state.exchanges(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    last = pairs.orderBy(F.desc("turn")).first()
    assert [x["user"] for x in last["history"]] == [str(i) for i in range(8, 28, 2)]


def test_registry(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "model_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "model_id string, v int")
    assert {tuple(r) for r in state.upserted(old, new).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert state.registry_by_type(spark.createDataFrame([(None,), ("x",)], "model_type string"), None).count() == 1
    assert state.admitted(new, old, "model_id").count() == 1


ATTACHMENTS = [
    ("data:text/plain;base64,5paH5pys", "", "", "", "data_uri", "文本"),
    ("data:,a%20b", "", "", "", "data_uri", "a b"),
    ("https://h/x.pdf", "", "", "", "url", None),
    ("5paH5pys", "", "", "base64", "base64", "文本"),
    ("JVBERi0xLjcKJeLjz9MK", "", "", "", "base64", None),
    ("abcdefghijklmnop", "", "", "", "text", None),
    ("<base64>", "", "", "", "empty", None),
    (None, "", "", "", "empty", None),
]


def test_attachment_kinds(spark):
    df = spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(ATTACHMENTS)], "i int, content string, name string, content_type string, encoding string")
    got = attachments.classified(df).orderBy("i").collect()
    assert [r["kind"] for r in got] == [x[4] for x in ATTACHMENTS]
    assert [bytes(r["payload"]).decode() for r, x in zip(got, ATTACHMENTS) if x[5]] == [x[5] for x in ATTACHMENTS if x[5]]


def test_one_broken_attachment_does_not_fail_the_record(spark):
    rows = [(1, 1, "正文", ""), (1, 2, "JVBERi0xLjcKJeLjz9MK", "base64"), (1, 3, "data:;base64,@", ""), (1, 4, "ztLDx7XE", "base64")]
    df = spark.createDataFrame(rows, "k int, i int, content string, encoding string").withColumns({"name": F.lit(""), "content_type": F.lit("")})

    def broken():
        def read(data):
            raise OSError

        return read

    texts = attachments.extracted(attachments.classified(df), "k", "i", pdf=broken)
    got = attachments.content_sections(texts, "k", "i").first()["content"]
    assert got == "【附件1 text】\n正文\n\n【附件4 decoded】\n我们的"
    items = df.select("k").distinct().withColumn("body", F.lit(None).cast("string"))
    whole = attachments.record_content(items, attachments.content_sections(texts, "k", "i"), "k", ["body"])
    assert whole.first()["content"] == got


def test_url_resolution(spark):
    cases = ["https://a/b", "/base/x", "y/z", "ftp://q", ""]
    got = spark.createDataFrame([(x,) for x in cases], "u string").select(attachments.resolved_url(F.col("u"), "https://h/base/")).collect()
    assert [r[0] for r in got] == ["https://a/b", "https://h/base/x", "https://h/base/y/z", None, None]


def test_decoded_text():
    assert [attachments.decoded_text(x) for x in ("文".encode("utf-8-sig"), "文".encode("utf-16"), "文件".encode("gb18030"))] == ["文", "文", "文件"]


def test_model_predictor_is_loaded_in_the_worker(spark):
    def load():
        return lambda texts: pd.Series([t.upper() for t in texts])

    got = spark.createDataFrame([("a",)], "t string").select(review.model_predictor(load)(F.col("t"))).first()[0]
    assert got == "A"


def test_progress_stream_is_monotonic(spark, tmp_path):
    rows = [("r", 10.0), ("r", 55.55), ("r", 30.0), ("q", 200.0)]
    spark.createDataFrame(rows, "run_id string, percentage double").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("run_id string, percentage double").parquet(str(tmp_path / "in"))
    q = streams.progress(events).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r[0], r[1]) for r in spark.table("progress").collect()} == {("r", 55.6), ("q", 100.0)}


def test_outbox_sends_again_what_failed(spark, tmp_path):
    """Keys: good at once; tried twice; failed in its batch and sent with the next one; replaced by a newer entry."""
    schema = "model_id string, n int"
    (tmp_path / "in").mkdir()
    (tmp_path / "seen").mkdir()
    seen = str(tmp_path / "seen")

    def send(df):
        def one(rows):
            import os
            import uuid

            for b in rows:
                sent = []
                for m, n in zip(b["model_id"], b["n"]):
                    open(f"{seen}/{m}-{n}-{uuid.uuid4().hex}", "w").close()
                    times = sum(f.startswith(f"{m}-{n}-") for f in os.listdir(seen))
                    sent.append(m == "good" or (m == "late" and times == 2) or (m == "next" and times == 4) or n == 2)
                yield b.assign(sent=sent)

        return df.mapInPandas(one, f"{schema}, batch_id long, sent boolean")

    def run(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        pending = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        streams.outbox(pending, str(tmp_path / "out"), str(tmp_path / "ck"), send, once=True).awaitTermination()
        last = max(int(x.name.split("=")[1]) for x in (tmp_path / "out" / "outcomes").iterdir() if "=" in x.name)
        return {(r["model_id"], r["n"]): (r["sent"], r["attempts"]) for r in spark.read.parquet(str(tmp_path / "out" / "outcomes" / f"batch={last}")).collect()}

    assert run([("good", 1), ("late", 1), ("next", 1), ("old", 1)], "a") == {("good", 1): (True, 1), ("late", 1): (True, 2), ("next", 1): (False, 3), ("old", 1): (False, 3)}
    assert run([("old", 2)], "b") == {("next", 1): (True, 1), ("old", 2): (True, 1)}


def test_conversation_state_keeps_the_last_exchanges(spark, tmp_path):
    rows = [("c", t, f"u{t}", f"a{t}") for t in range(15)] + [("d", 0, "u", "a")]
    schema = "conv_id string, turn long, user string, assistant string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    turns = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streams.conversations(turns).writeStream.outputMode("update").format("memory").queryName("talk").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["conv_id"]: [x["user"] for x in r["history"]] for r in spark.table("talk").collect()}
    assert got == {"c": [f"u{t}" for t in range(5, 15)], "d": ["u"]}


def test_admission_and_windows_of_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")]
    schema = "task string, at timestamp"
    spark.createDataFrame(rows, "task string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def result(df, name, mode):
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["task"] for r in result(streams.admitted(read(), "task", "at"), "admission", "append")) == ["a", "b"]
    counts = result(streams.activity(read(), "at", "1 minute", "1 hour", "task"), "windows", "update")
    assert sorted((r["task"], r["n_events"]) for r in counts) == [("a", 1), ("a", 1), ("b", 1)]


def test_landed_files_above_the_limit_are_not_read(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 10)
    (tmp_path / "b").write_bytes(b"x" * 100)
    (tmp_path / "c").write_bytes(b"")
    assert [r["length"] for r in attachments.landed_files(spark, str(tmp_path), 50).collect()] == [10]


def test_appraisal_without_a_verdict(spark):
    from quillstone.operators import appraisal

    df = spark.createDataFrame([("t", "2000", "2026"), (None, None, None)], "title string, date_time string, date_now string")
    got = appraisal.appraised(df, lambda text: F.when(text.contains("2000") & text.contains("完成鉴定"), '前{"审核结果": "开放", "置信度": 9}后').otherwise("无")).collect()
    assert [r["verdict"] and (r["verdict"]["审核结果"], r["verdict"]["置信度"]) for r in got] == [("开放", "9"), None]
    assert [r["first_answer"] for r in got] == ["无", "无"]


def test_values_of_any_type_as_lists(spark):
    cases = [None, "x", '["a", "b"]', '[1, null, {"k": [2]}, ["z"]]', '{"a": 1}', "[]", "[broken", '"quoted"', "12"]
    got = spark.createDataFrame([(x,) for x in cases], "v string").select(requests.as_list(F.col("v"))).collect()
    assert [r[0] for r in got] == [[], ["x"], ["a", "b"], ["1", None, '{"k":[2]}', '["z"]'], ['{"a":1}'], [], ["[broken"], ["quoted"], ["12"]]


SAMPLES = "doc_id long, reject_reason string, input string, output string, instruction string"


def test_duplicates_of_repeated_ids(spark):
    """Three samples, two with one id: all three stay as rows, one is valid and two are duplicates."""
    rows = [(1, None, "q", "a", "i"), (1, None, "q", "a", "i"), (2, None, "q", "a", "i"), (None, None, "z", "a", "i"), (3, "no basis", None, None, "i"), (0, None, "q", "other", "i")]
    df = spark.createDataFrame(rows, SAMPLES)
    got = prepare.marked_duplicates(df, ["doc_id"])
    assert got.columns == [*df.columns, "duplicate"] and got.count() == len(rows)
    assert sorted((str(r["doc_id"]), r["duplicate"]) for r in got.collect()) == [("0", False), ("1", False), ("1", True), ("2", True), ("3", False), ("None", False)]
    assert tuple(prepare.preparation_counts(got).first()) == (6, 3, 2)
    samples, counts = prepare.distinct_samples(df, ["doc_id"], ["doc_id", "input", "output"])
    assert sorted((str(r["doc_id"]), r["input"], r["output"]) for r in samples.collect()) == [("0", "q", "other"), ("1", "q", "a"), ("None", "z", "a")]
    told = counts.get()
    assert (told["n_raw"], told["n_valid"], told["n_duplicates"]) == (6, 3, 2) and told["rejected"]["no basis"] == 1 and sum(told["rejected"].values()) == 1


@pytest.mark.parametrize("ids", [[5, 5, 5], [None, None, None], [1, 2, None], [3, 3, 1]])
def test_one_row_fills_an_empty_side(spark, ids):
    df = spark.createDataFrame([(i, f"k{n}", {"a": "b"}) for n, i in enumerate(ids)], "id long, k string, m map<string,string>")
    for ratio, side in ((0.0, "validation"), (1.0, "train")):
        got = training_data.split(df, F.col("k"), ratio, "id")
        assert got.columns == [*df.columns, "part"] and got.count() == 3
        moved = got.where(F.col("part") == side).collect()
        assert len(moved) == 1 and moved[0]["id"] == max((i for i in ids if i is not None), default=None)
    same = spark.createDataFrame([(1, "k")] * 4, "id long, k string")
    assert training_data.split(same, F.col("k"), 0.0, "id").where("part = 'validation'").count() == 1
    with pytest.raises(ValueError, match="fewer than 10"):
        training_data.split(df, F.col("k"), 0.5, "id", min_samples=10)
    assert training_data.split(df.limit(1), F.col("k"), 0.0, "id").first()["part"] == "train"


def test_answers_in_literal_form_become_json(spark):
    cases = ["{'a': 1, 'b': '审'}", '{"a": 1}', " [1, 'x'] ", "('t', None)", "plain text", "{'a': 1}</s>", "{1, 2}", "12", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in cases], "a string").select(training_data.answer_text(F.col("a"), "</s>")).collect()]
    assert got == ['{"a": 1, "b": "审"}</s>', '{"a": 1}</s>', '[1, "x"]</s>', '["t", null]</s>', "plain text</s>", "{'a': 1}</s>", "{1, 2}</s>", "12</s>", None]


@pytest.mark.parametrize("n,world", [(10, 4), (8, 4), (3, 8), (1, 3), (0, 4)])
def test_shards_are_equal_and_whole(spark, n, world):
    rows = spark.range(n).select("id", F.lit("x").alias("shard"))
    orders = []
    for epoch in (0, 1):
        for most in (10**6, 2):
            got = training_data.epoch_shards(rows, "id", world, 7, epoch, most=most).collect()
            by = {}
            for r in sorted(got, key=lambda r: r["place"]):
                by.setdefault(r["shard"], []).append(r["id"])
            assert {len(x) for x in by.values()} <= {-(-n // world)} and len(by) == (world if n else 0)
            assert {r["id"] for r in got} == set(range(n))
            orders.append([by[k][p] for p in range(-(-n // world)) for k in range(world)])
            assert orders[-1][n:] == [orders[-1][i % n] for i in range(n, len(orders[-1]))]
    assert orders[0] == orders[1] and orders[2] == orders[3] and (n < 8 or orders[0] != orders[2])


def test_chat_equals_a_plain_loop(spark):
    """Conversations of 0 to 14 turns, null texts, a null conversation; the predictor sees the last exchanges and is asked once."""
    import hashlib

    from quillstone.operators import chat

    turns = [(c, t, None if (c, t) == (2, 3) else f"say {c} {t}") for c, n in ((1, 1), (2, 5), (3, 14), (None, 2)) for t in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, user string")
    asked = spark.sparkContext.accumulator(0)

    def predict(prompt):
        @F.pandas_udf("string")
        def answer(x):
            asked.add(len(x))
            return x.map(lambda p: hashlib.md5(p.encode()).hexdigest())

        return answer(prompt)

    got = {(r["conv_id"], r["turn"]): r for r in chat.chat(df, predict, system="S\n", keep=4).collect()}
    assert len(got) == len(turns) and asked.value == len(turns)
    for c in {c for c, _, _ in turns}:
        history = []
        for _, t, u in [x for x in turns if x[0] == c]:
            u = u or ""
            blocks = "".join(f"<|im_start|>user\n{a}<|im_end|>\n<|im_start|>assistant\n{b}<|im_end|>\n" for a, b in history[-4:])
            prompt = f"S\n{blocks}<|im_start|>user\n{u}<|im_end|>\n<|im_start|>assistant\n"
            answer = hashlib.md5(prompt.encode()).hexdigest()
            assert (got[c, t]["user"], got[c, t]["prompt"], got[c, t]["assistant"]) == (u, prompt, answer)
            history.append((u, answer))
    assert chat.chat(df.limit(0), predict).count() == 0
    said = df.limit(1).select(chat.asked(F.lit("do"), F.lit("")), chat.asked(F.lit("do"), F.lit("this"))).first()
    assert tuple(said) == ("do", "do\n\nthis")


def test_registry_files(spark, tmp_path):
    """A file that is one object over many lines, and files with an object on each line."""
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("model_name", T.StringType()), T.StructField("model_epochs", T.IntegerType())])
    held = {"m1": {"model_name": "a", "model_epochs": 3}, "m2": {"model_name": "b"}}
    (tmp_path / "whole.json").write_text(json.dumps(held, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({k: v}) for k, v in held.items()))
    for name, lines in (("whole.json", False), ("lines.json", True)):
        got = jsonl.keyed_object(spark, str(tmp_path / name), kind, lines=lines)
        assert sorted(tuple(r) for r in got.collect()) == [("m1", "a", 3), ("m2", "b", None)]


def test_registry_is_replaced_by_what_is_read_from_it(spark, tmp_path):
    from quillstone.sources.shared import replaced

    path = str(tmp_path / "registry")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "model_id string, epochs int")
    assert sorted(tuple(r) for r in replaced(first, path).collect()) == [("a", 1), ("b", 2)]
    held = spark.read.parquet(path)
    new = spark.createDataFrame([("b", 9), ("c", 3)], "model_id string, epochs int")
    assert sorted(tuple(r) for r in replaced(state.upserted(held, new), path).collect()) == [("a", 1), ("b", 9), ("c", 3)]
    bad = spark.read.parquet(path).withColumn("epochs", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        replaced(bad, path)
    gone = state.deleted(spark.read.parquet(path), new)
    assert [tuple(r) for r in replaced(gone, path).collect()] == [("a", 1)]
    assert {x.name for x in tmp_path.iterdir()} == {"registry"}
