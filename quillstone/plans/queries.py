"""Queries over the driver's tables, each with the DuckDB SQL that it equals where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import appraisal, prepare, requests, review, rules, spans, state, training_data
from ..sources import attachments, jsonl
from ..sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def c(name: str) -> Column:
    return F.col(name)


# Rule retrieval

BIGRAMS = """
SELECT {key}, CASE WHEN length(n) = 1 THEN n ELSE substr(n, i::BIGINT, 2) END AS term, count(*) AS tf
FROM (SELECT {key}, lower(regexp_replace({text}, '\\s+', '', 'g')) AS n FROM {table}),
     LATERAL (SELECT unnest(range(1, greatest(length(n), CASE WHEN length(n) = 1 THEN 2 ELSE 0 END))) AS i)
GROUP BY 1, 2"""
RULES_SQL = f"""
WITH q AS ({BIGRAMS.format(key="doc_id", text="substr(text, 1, 8000)", table="documents")}),
p AS ({BIGRAMS.format(key="item_id", text="text", table="benchmark")}),
w AS (SELECT term, ln((greatest((SELECT count(*) FROM benchmark), 1) + 1)::DOUBLE / (count(*) + 1) + 1) AS idf FROM p GROUP BY term),
s AS (SELECT doc_id, item_id, sum(least(q.tf, p.tf) * idf) AS score FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 8) DESC, item_id) AS rank FROM s)
SELECT doc_id, item_id, rank, round(score, 4) AS score FROM r WHERE rank <= 3"""


@query(RULES_SQL)
def rule_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", c("item_id").alias("ordinal"), "text")
    postings = rules.weighted_postings(items, "item_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, rules.CONTENT_CHARS).alias("text"))
    return rules.top_rules(docs, postings, "doc_id", c("text"), rule="item_id")


@query(f"SELECT term, count(*) AS df FROM ({BIGRAMS.format(key='item_id', text='text', table='benchmark')}) GROUP BY term")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.document_frequency(rules.term_counts(table(spark, sf_dir, "benchmark"), "item_id", c("text")))


@query("""SELECT doc_id, i AS chunk, md5(substr(text, i * 900 + 1, 1000)) AS digest
FROM documents, LATERAL (SELECT unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE (greatest(length(text) - 101, 0) // 900) + 1 END)) AS i)""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.fixed_chunks(c("text"), 1000, 100)).alias("chunk", "t")).select("doc_id", c("chunk").cast("long").alias("chunk"), F.md5("t").alias("digest"))


@query()
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand in for paragraphs; short chunks and repeats are gone."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.lit("hk").alias("kind"), F.lit("corpus").alias("source"), c("doc_id").alias("line"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("input"))
    return rules.corpus(lines, rules.paragraph_chunks(c("input")))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a rule corpus from recursive pieces."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(rules.recursive_pieces(c("text"))).alias("chunk", "text"))
    return rules.rule_samples(each).select("doc_id", "chunk", "instruction", "input", "output")


@query("SELECT i AS item_id, i % 3 = 0 AS missing FROM (SELECT item_id AS i FROM benchmark) WHERE i % 3 = 0")
def kinds_without_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "benchmark").select(c("item_id").cast("string").alias("kind"), "item_id")
    known = kinds.where("item_id % 3 <> 0")
    return rules.missing_kinds(kinds, known).select("item_id", F.lit(True).alias("missing"))


@query("""SELECT doc_id, substr(n, 1, 40) AS head FROM (
SELECT doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS n, row_number() OVER (PARTITION BY lower(regexp_replace(text, '\\s+', '', 'g')) ORDER BY doc_id) AS turn FROM documents) WHERE turn = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.normalized(c("text")).alias("n"))
    return prepare.first_wins(docs, [c("n")], ["doc_id"]).select("doc_id", F.substring("n", 1, 40).alias("head"))


# Training-set preparation


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.when(c("quality") == 1, L.OPEN).otherwise(L.CONTROL).alias("label"))


LABELS = "(SELECT doc_id, CASE WHEN quality = 1 THEN '开放' ELSE '控制' END AS label FROM labels)"


@query(f"SELECT label, count(*) AS n FROM {LABELS} GROUP BY 1")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.label_distribution(_labels(spark, sf_dir))


@query(f"""WITH n AS (SELECT label, count(*) AS n FROM {LABELS} GROUP BY 1)
SELECT 'samples: ' || sum(n) AS violation FROM n HAVING sum(n) < 5000
UNION ALL SELECT 'label ' || label || ': ' || n FROM n WHERE n < 100""")
def distribution_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.distribution_violations(label_distribution(spark, sf_dir), "hk", min_total=5000, min_each=100)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(_labels(spark, sf_dir), "doc_id", "left_anti").select("doc_id", "source")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as loosely structured records under candidate keys, with some missing values."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    code = F.when(c("quality") == 1, "kf").when(c("quality") == 0, "不开放").otherwise("undefined")
    title = F.when(c("doc_id") % 7 == 0, " NULL ").otherwise(F.concat(F.lit(" Title "), c("doc_id").cast("string")))
    basis = F.when(c("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("basis of "), c("source"), F.lit("。；")))
    period = F.when(c("quality") == 1, "定期30年").when(c("quality") == 0, "永久").otherwise("无")
    own = F.when(c("doc_id") % 3 == 0, F.to_json(F.array("lang", "source"))).when(c("doc_id") % 3 == 1, "[]")
    keys = F.create_map(F.lit("tm"), title, F.lit("title"), F.when(c("doc_id") % 14 == 0, "second"), F.lit("year"), c("lang"), F.lit("kzf"), code, F.lit("依据"), basis, F.lit("confidence"), F.concat((c("doc_id") % 120).cast("string"), F.lit("%")), F.lit("ml"), c("source"), F.lit("bgqx"), period, F.lit("files"), own)
    element = F.struct(keys.alias("record"), F.when(c("doc_id") % 5 == 0, F.array("source")).alias("files"))
    return docs.select("doc_id", "text", F.array(element, F.struct(F.lit(None).cast("map<string,string>").alias("record"), F.array("lang").alias("files"))).alias("data"))


def _projected(spark: SparkSession, sf_dir: str, kind: str = "hk") -> DataFrame:
    return prepare.projected(prepare.records(_records(spark, sf_dir), "doc_id", "text"), kind)


RECORDS = """(SELECT doc_id, text, CASE WHEN doc_id % 14 = 0 THEN 'second' WHEN doc_id % 7 = 0 THEN '无题名' ELSE 'Title ' || doc_id END AS title, lang AS date_time,
CASE WHEN quality = 1 THEN '开放' WHEN quality = 0 THEN '控制' END AS label, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'basis of ' || source || '。；' END AS basis,
round_even(least(10.0, CASE WHEN doc_id % 120 > 10 THEN (doc_id % 120)::DOUBLE / 10 ELSE (doc_id % 120)::DOUBLE END), 1)::DOUBLE AS confidence, source AS archive_category
FROM documents LEFT JOIN labels USING (doc_id))"""


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ',' || source WHEN doc_id % 5 = 0 THEN source ELSE '' END AS files, (doc_id % 3 = 0 OR doc_id % 5 = 0) AS has_files FROM documents""")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's own files come before those of its element."""
    each = prepare.records(_records(spark, sf_dir), "doc_id")
    return each.select("doc_id", F.array_join("files", ",").alias("files"), prepare.has_files(c("files")).alias("has_files"))


@query(f"SELECT doc_id, title, date_time, label, basis, confidence, archive_category FROM {RECORDS}")
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir).select("doc_id", "title", "date_time", "label", "basis", "confidence", "archive_category")


def _gated(spark: SparkSession, sf_dir: str, kind: str = "hk") -> DataFrame:
    prefix = {"hk": "依据标准", "jd": "依据档案保管规范"}[kind]
    return prepare.samples(_projected(spark, sf_dir, kind), kind, prefix)


@query(f"""SELECT coalesce(reject_reason, 'valid') AS reject_reason, count(*) AS n FROM (SELECT CASE WHEN label IS NULL THEN 'label is not valid' WHEN basis = '' THEN 'no basis' END AS reject_reason FROM {RECORDS}) GROUP BY 1""")
def sample_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reject_reason")).agg(F.count("*").alias("n"))


@query(f"""SELECT reject_reason, count(*) AS n FROM (SELECT CASE WHEN label IS NULL THEN 'label is not valid' WHEN basis = '' THEN 'no basis'
WHEN doc_id % 4 = 3 AND (doc_id % 3 = 0 OR doc_id % 5 = 0) THEN 'attachments without content' WHEN doc_id % 4 = 3 AND title = '无题名' THEN 'neither content nor title and date' ELSE 'valid' END AS reject_reason FROM {RECORDS}) GROUP BY 1""")
def sample_gates_without_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the records have no content: attachments, title and date decide."""
    rows = _projected(spark, sf_dir).withColumn("text", F.when(c("doc_id") % 4 == 3, "").otherwise(c("text")))
    gated = prepare.samples(rows, "hk", "依据标准")
    return gated.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reject_reason")).agg(F.count("*").alias("n"))


FIELD = "CASE WHEN doc_id % 4 = 0 AND doc_id % {n} = 0 THEN '' ELSE '{name} ' || source || doc_id END AS {name}"


@query(f"SELECT doc_id, {', '.join(FIELD.format(name=k, n=len(v)) for k, v in prepare.RETRIEVAL_KEYS.items())} FROM documents")
def retrieval_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field under each of its names in turn; for a quarter of the records the first name holds a text for null."""
    entries = []
    for field, keys in prepare.RETRIEVAL_KEYS.items():
        said = F.concat(F.lit(f"{field} "), c("source"), c("doc_id").cast("string"))
        for k, key in enumerate(keys):
            own = F.when(c("doc_id") % len(keys) == k, said)
            entries += [F.lit(key), F.when(c("doc_id") % 4 == 0, F.lit(" Null ")).otherwise(own) if k == 0 else own]
    data = F.array(F.struct(F.create_map(*entries).alias("record"), F.array().cast("array<string>").alias("files")))
    rows = prepare.records(table(spark, sf_dir, "documents").select("doc_id", data.alias("data")), "doc_id")
    return prepare.projected(rows, "hk").select("doc_id", *prepare.RETRIEVAL_KEYS)


ANSWER = "`审核结果` string, `审核依据` string, `置信度` double, `思考过程` string"


def _answers(samples: DataFrame) -> DataFrame:
    """The answers are read from their JSON again."""
    good = samples.where("reject_reason IS NULL").where(prepare.has_output_fields(c("output"))).withColumn("o", F.from_json("output", ANSWER))
    return good.select("doc_id", "input", c("o")["审核结果"].alias("label"), c("o")["审核依据"].alias("basis"), c("o")["置信度"].alias("confidence"))


@query(f"""SELECT doc_id, label, '依据标准，' || regexp_replace(basis, '[。.,;；]+$', '') AS basis, confidence FROM {RECORDS} WHERE label IS NOT NULL AND basis <> ''""")
def labelled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(_gated(spark, sf_dir)).drop("input")


@query(f"""SELECT doc_id, CASE label WHEN '开放' THEN '30年' ELSE '永久' END AS label, '依据档案保管规范，' || regexp_replace(basis, '[。.,;；]+$', '') AS basis, confidence,
title, date_time, archive_category AS category, '正文或附件' AS evidence, length(text) AS n_chars FROM {RECORDS} WHERE label IS NOT NULL AND basis <> ''""")
def retention_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of retention periods, with some fields of their questions."""
    field = lambda k: F.get_json_object("input", f"$.{k}")
    out = _answers(_gated(spark, sf_dir, "jd"))
    return out.select("doc_id", "label", "basis", "confidence", field("题名").alias("title"), field("成文日期").alias("date_time"), field("门类").alias("category"), field("训练证据类型").alias("evidence"), F.length(field("正文")).alias("n_chars"))


@query()
def training_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole samples: evidence excerpt, risk elements and the best rules inside the question."""
    items = table(spark, sf_dir, "benchmark")
    corpus = items.select(X.rule_id(F.lit("hk"), c("item_id"), F.lit(1)).alias("rule_id"), c("item_id").alias("ordinal"), F.lit("corpus").alias("source"), "text")
    rows = _projected(spark, sf_dir)
    valid = _gated(spark, sf_dir).where("reject_reason IS NULL")
    ranked = rules.top_rules(valid.select("doc_id", rules.query_text(c("title"), c("text"), c("date_time"), c("archive_category")).alias("q")), rules.weighted_postings(corpus), "doc_id", c("q"))
    full = rules.dealt(rows, "doc_id", c("text")).join(rules.attached(ranked, corpus, "doc_id"), "doc_id", "left").withColumn("excerpt", prepare.evidence_excerpt(c("text"), ["idiot", "license", "password"]))
    out = prepare.samples(full, "hk", "依据标准", excerpt=c("excerpt"), rules=c("rules"))
    return out.where("reject_reason IS NULL").select("doc_id", "input", "output")


@query(f"""SELECT count(*) AS n_raw, count(*) FILTER (reject IS NULL AND turn = 1) AS n_valid, count(*) FILTER (reject IS NULL AND turn > 1) AS n_duplicates FROM (
SELECT reject, row_number() OVER (PARTITION BY reject, title, date_time, archive_category, text, label, basis, confidence ORDER BY doc_id) AS turn
FROM (SELECT *, CASE WHEN label IS NULL OR basis = '' THEN 1 END AS reject FROM {RECORDS}))""")
def preparation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with an earlier one's question and answer are duplicates; counted while the samples are written."""
    return _written_counts(spark, _gated(spark, sf_dir))


def _written_counts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    samples, counts = prepare.distinct_samples(rows, ["doc_id"], ["instruction", "input", "output"])
    samples.write.json(shared_folder(spark))
    n = counts.get()
    return spark.range(1).select(*[F.lit(n[x]).alias(x) for x in ("n_raw", "n_valid", "n_duplicates")])


@query(f"""SELECT 3 * count(*) AS n_raw, count(*) FILTER (reject IS NULL AND turn = 1) AS n_valid, 3 * count(*) FILTER (reject IS NULL) - count(*) FILTER (reject IS NULL AND turn = 1) AS n_duplicates FROM (
SELECT reject, row_number() OVER (PARTITION BY reject, title, date_time, archive_category, text, label, basis, confidence ORDER BY doc_id) AS turn
FROM (SELECT *, CASE WHEN label IS NULL OR basis = '' THEN 1 END AS reject FROM {RECORDS}))""")
def repeated_preparation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record three times under its id, as when a set is fetched again."""
    return _written_counts(spark, _gated(spark, sf_dir).withColumn("again", F.explode(F.array(*[F.lit(i) for i in range(3)]))))


@query(f"""SELECT doc_id, turn > 1 OR copy > 0 AS duplicate FROM (
SELECT doc_id, row_number() OVER (PARTITION BY title, date_time, archive_category, text, label, basis, confidence ORDER BY doc_id) AS turn FROM {RECORDS} WHERE label IS NOT NULL AND basis <> ''), (SELECT unnest(range(2)) AS copy)""")
def marked_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record twice, the same in all values: one of both is the first."""
    twice = _gated(spark, sf_dir).where("reject_reason IS NULL").withColumn("again", F.explode(F.array(F.lit(0), F.lit(0))))
    return prepare.marked_duplicates(twice, ["doc_id"]).select("doc_id", "duplicate")


@query("""SELECT doc_id, CASE WHEN ('0x' || substr(sha1(source || '/' || doc_id), 1, 8))::BIGINT % 10000 < 1500 THEN 'validation' ELSE 'train' END AS part FROM documents""")
def train_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.concat_ws("/", "source", c("doc_id").cast("string")).alias("题名"))).alias("input"))
    return training_data.split(docs, training_data.split_key(c("input")), 0.15, "doc_id").select("doc_id", "part")


# Text


@query("""SELECT doc_id, CASE WHEN length(text) > 1500 THEN substr(text, 1, 1000) || ' [...] ' || right(text, 500) ELSE text END AS excerpt FROM documents""")
def head_tail_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.head_tail(c("text"), 1500, " [...] ").alias("excerpt"))


@query()
def evidence_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", prepare.evidence_excerpt(c("text"), ["idiot", "license", "password"]).alias("excerpt"))


@query("""WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS start_s, floor(epoch(ts))::BIGINT + floor(abs(value))::BIGINT AS end_s FROM events),
f AS (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3000 THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, min(start_s) AS start_s, max(end_s) AS end_s FROM g GROUP BY user_id, island""")
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_timestamp(c("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", start.alias("start_s"), (start + F.floor(F.abs("value"))).alias("end_s"))
    return spans.merged_intervals(rows, "user_id", "start_s", "end_s", 3000)


WORDS = {"article": ["the", "der", "la"], "and": ["und", "and"]}
RISKS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS category, array_to_string(list_filter([{', '.join(repr(w) for w in ws)}], lambda w: contains(text, w)), '、') AS words, list_filter([{', '.join(repr(w) for w in ws)}], lambda w: contains(text, w))[1] AS w1, text FROM documents" for k, ws in WORDS.items()
)


@query(f"""SELECT doc_id, category, words, replace(substr(text, greatest(instr(text, w1) - 60, 1)::BIGINT, (least(length(text), instr(text, w1) - 1 + length(w1) + 100) - greatest(instr(text, w1) - 61, 0))::BIGINT), chr(10), ' ') AS evidence
FROM ({RISKS}) WHERE w1 IS NOT NULL""")
def risk_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(L.risk_elements(c("text"), WORDS)).alias("r")).select("doc_id", "r.*")


@query("""SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'of', ''))) // 2)::BIGINT AS control_votes,
((length(text) - length(replace(text, 'and', ''))) // 3)::BIGINT AS open_votes FROM documents""")
def keyword_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.vote(c("text"), ["the", "of"]).alias("control_votes"), X.vote(c("text"), ["and"]).alias("open_votes"))


@query("""SELECT event_id, round_even(greatest(0.0, least(10.0, CASE WHEN v > 10 THEN v / 10 ELSE v END)), 1)::DOUBLE AS confidence
FROM (SELECT event_id, round(value)::BIGINT::DOUBLE AS v FROM events)""")
def confidence_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.round("value").cast("long").cast("string"), F.lit("%"))
    return table(spark, sf_dir, "events").select("event_id", X.confidence(said).alias("confidence"))


@query("SELECT o_orderkey, CASE WHEN floor(o_totalprice / 1000) BETWEEN 10 AND 200 THEN floor(o_totalprice / 1000)::INT ELSE 64 END AS batch_size FROM orders")
def bounded_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(c("o_orderkey") % 1 == 0, F.floor(c("o_totalprice") / 1000).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.bounded(said, 10, 200, 64, "int").alias("batch_size"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y%m%d') END AS formed FROM orders""")
def partial_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = c("o_orderdate").cast("date")
    said = F.when(c("o_orderkey") % 3 == 0, F.concat(F.date_format(day, "yyyy"), F.lit("0000"))).when(c("o_orderkey") % 3 == 1, F.concat(F.date_format(day, "yyyyMM"), F.lit("00"))).otherwise(F.date_format(day, "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.partial_date(said).alias("formed"))


@query("SELECT o_orderkey, 2026 - year(o_orderdate) >= 30 AS expired FROM orders")
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.retention_expired(F.lit(2026), F.year("o_orderdate"), F.lit(30)).alias("expired"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, json_keys(props::JSON)[1] = 'k' AS has_k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.array_contains(F.json_object_keys("props"), "k").alias("has_k"))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'no JSON object' WHEN 1 THEN 'instruction, input or output is missing' WHEN 2 THEN 'output is no JSON object'
WHEN 3 THEN 'output lacks: 审核依据' WHEN 4 THEN 'no result' END AS error, CASE doc_id % 7 WHEN 5 THEN lang || '|' || source || '|8.0|' || source WHEN 6 THEN lang || '|' || source || '|9.2|t' END AS answer FROM documents""")
def sample_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(output: Column) -> Column:
        return F.to_json(F.struct(c("lang").alias("instruction"), c("text").alias("input"), output.alias("output")))

    quoted = lambda c_: F.concat(F.lit("'"), c_, F.lit("'"))
    literal = F.concat(F.lit("{'审核结果': "), quoted(c("lang")), F.lit(", '审核依据': "), quoted(c("source")), F.lit("}"))
    full = F.to_json(F.struct(c("lang").alias("审核结果"), c("source").alias("审核依据"), F.lit("92%").alias("置信度"), F.lit("t").alias("思考过程")))
    shapes = [F.lit("[1"), line(F.lit("")), line(F.lit("[]")), line(F.to_json(F.struct(c("lang").alias("审核结果")))), line(F.to_json(F.struct(F.lit(" ").alias("审核结果"), c("source").alias("审核依据")))), line(literal), line(full)]
    rows = table(spark, sf_dir, "documents").withColumn("line", F.element_at(F.array(*shapes), (c("doc_id") % 7 + 1).cast("int")))
    o = F.from_json("output", ANSWER)
    answer = F.concat_ws("|", *[o[x].cast("string") for x in ("审核结果", "审核依据", "置信度", "思考过程")])
    return jsonl.checked_samples(rows, "line").select("doc_id", "error", F.when(c("output").isNotNull(), answer).alias("answer"))


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN '开放' WHEN lang = 'fr' THEN '控制' END AS label, CASE WHEN doc_id % 2 = 0 THEN '30年' ELSE '永久' END AS period,
CASE doc_id % 3 WHEN 0 THEN 'keywords without a result' WHEN 1 THEN 'a result without keywords' END AS violation FROM documents""")
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(c("lang") == "en", "open").when(c("lang") == "de", "应开放").when(c("lang") == "fr", "不开放").otherwise("?")
    period = F.when(c("doc_id") % 2 == 0, "定期30年").otherwise("永久保存，或10年")
    words = F.when(c("doc_id") % 3 == 1, F.array(F.lit(" "))).otherwise(F.array(F.lit(" a"), F.lit("a ")))
    said = F.when(c("doc_id") % 3 == 0, "").otherwise(L.OPEN)
    return table(spark, sf_dir, "documents").select("doc_id", L.open_label(code).alias("label"), L.period_label(period).alias("period"), L.keyword_contract(F.lit("hk"), words, said).alias("violation"))


# Conversations, progress and queues

HISTORY = """WITH m AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, turn, text AS u, CASE WHEN r2 = 'assistant' THEN t2 END AS a FROM m WHERE role = 'user'),
h AS (SELECT conv_id, turn, u, list(CASE WHEN a IS NOT NULL THEN '<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || a || '<|im_end|>' || chr(10) END)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS parts FROM e)
SELECT conv_id, turn, coalesce(array_to_string(list_filter(parts, lambda p: p IS NOT NULL), ''), '') || '<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM h"""


@query(HISTORY)
def conversation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = state.with_history(state.exchanges(table(spark, sf_dir, "conversations")))
    return pairs.select("conv_id", "turn", state.chat_prompt(c("history"), c("user")).alias("prompt"))


@query("""SELECT event_id, user_id, max(round_even(greatest(0.0, least(100.0, value)), 1)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS percentage FROM events""")
def progress_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.running_progress(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], c("value")).select("event_id", "user_id", "percentage")


@query("SELECT user_id, max(round_even(greatest(0.0, least(100.0, value)), 1))::DOUBLE AS percentage FROM events GROUP BY 1")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_progress(table(spark, sf_dir, "events"), "user_id", c("value"))


@query("SELECT user_id AS run_id, max(round_even(greatest(0.0, least(100.0, value)), 1))::DOUBLE AS percentage, count(*) AS n_events FROM events GROUP BY 1")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream; each micro-batch replaces the state table in the shared folder."""
    from ..streaming.state import progress

    folder = shared_folder(spark)
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events*.parquet")
    latest = progress(events.select(c("user_id").alias("run_id"), c("value").alias("percentage")))
    writer = latest.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint")
    run = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/state")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.queue_positions(table(spark, sf_dir, "events"), ["ts", "event_id"], ["event_type"]).select("event_id", "event_type", "position")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS shard FROM documents")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return training_data.rank_shard(training_data.batches(docs, "doc_id", 8, "source"), "doc_id", 4, "source")


@query("""WITH e AS (SELECT user_id, date_trunc('day', ts)::DATE AS epoch, avg(value) AS loss FROM events GROUP BY 1, 2)
SELECT user_id, arg_min(epoch, (round(loss, 6), epoch)) AS best_epoch, min(round(loss, 6)) AS best_loss FROM e GROUP BY 1""")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("user_id", c("ts").cast("date").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return training_data.best_epoch(daily, "user_id", "epoch", "loss")


@query("""SELECT event_type, round(avg(loss), 6) AS validation_loss FROM (SELECT event_type, event_id // 16 AS batch, avg(value) AS loss FROM events GROUP BY 1, 2) GROUP BY 1""")
def mean_of_batch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("batch", F.floor(c("event_id") / 16))
    return training_data.mean_of_batch_means(rows, "batch", "value", ["event_type"]).withColumn("validation_loss", F.round("validation_loss", 6))


@query("""SELECT min(n) AS min_tokens, max(n) AS max_tokens, avg(n) AS mean_tokens FROM (SELECT len(regexp_extract_all(text, '[^ \\t-\\r]+')) AS n FROM documents)""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.regexp_count("text", F.lit(r"[^ \t-\r]+"))
    return training_data.length_statistics(table(spark, sf_dir, "documents"), size)


def _tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), F.lit(0)), lambda t: F.length(t))


@query("""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^ \\t-\\r]+'), lambda x: length(x)) AS p, [length(source), length(lang)] AS a FROM documents),
k AS (SELECT *, CASE WHEN len(p) <= 126 THEN p ELSE list_concat(p[1:42], p[len(p) - 83:len(p)]) END AS kept FROM t)
SELECT doc_id, len(kept) + 2 AS n_tokens, list_sum(kept) + list_sum(a) AS checksum, 2 AS n_learnable, len(kept) + 2 AS n_mask FROM k""")
def mask_and_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _tokens(c("text")).alias("p"), F.array(F.length("source"), F.length("lang")).alias("a"))
    rows = docs.select("doc_id", *[v.alias(k) for k, v in training_data.token_sample(c("p"), c("a"), 128).items()])
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", F.size("input_ids").alias("n_tokens"), total.alias("checksum"), training_data.learnable(c("labels")).alias("n_learnable"), F.size("attention_mask").alias("n_mask"))


@query("""SELECT doc_id, source, max(n) OVER (PARTITION BY source) AS padded FROM (SELECT doc_id, source, len(regexp_extract_all(text, '[^ \\t-\\r]+')) AS n FROM documents)""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", _tokens(c("text")).alias("ids"))
    return training_data.padded(docs, "source", "ids", 0).select("doc_id", "source", F.size("ids").alias("padded"))


# Registry, callbacks and requests


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, s_name, s_name IS NULL AS miss FROM (SELECT l_orderkey, l_linenumber, l_suppkey + 2 AS l_suppkey FROM lineitem) LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_suppkey") + 2).alias("l_suppkey"))
    registry = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("l_suppkey"), "s_name")
    return state.registry_lookup(requests, registry, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", "s_name", "miss")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#12'")
def registry_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.registry_by_type(table(spark, sf_dir, "part"), "Brand#12", "p_brand").select("p_partkey", "p_name")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT -1, 'new'""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "supplier").select(c("s_suppkey").cast("int").alias("s_suppkey"), "s_name")
    new = registry.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("new").alias("s_name")).union(spark.range(1).select(F.lit(-1), F.lit("new")))
    return state.deleted(state.upserted(registry, new, "s_suppkey"), registry.where("s_suppkey % 5 = 0"), "s_suppkey")


@query("""SELECT o_orderkey AS model_id, CASE WHEN o_orderkey % 4 = 0 THEN 'own' WHEN o_custkey % 4 = 0 THEN 'base' ELSE 'new' END AS mode FROM orders""")
def model_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are all orders; registered are those of their keys that 4 divides."""
    requests = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("model_id"), c("o_custkey").alias("base_model_id"))
    keys = table(spark, sf_dir, "orders").select(F.explode(F.array("o_orderkey", "o_custkey")).alias("model_id"))
    registry = keys.where("model_id % 4 = 0").distinct().withColumn("model_path", F.lit("x"))
    return state.lineage(requests, registry).select("model_id", "mode")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'purchase'")
def pending_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    outbox = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (c("event_type") == "purchase").alias("sent"))
    return state.pending_callbacks(outbox, "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT count(*) AS n_records, count(*) FILTER (doc_id % 3 <> 0) AS n_with_keywords, sum(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS n_files FROM documents")
def request_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(c("doc_id") % 3 != 0, F.array("lang"))
    files = F.when(c("doc_id") % 3 == 0, F.array("lang", "source"))
    return state.request_statistics(table(spark, sf_dir, "documents").select(words.alias("keywords"), files.alias("files")))


@query("SELECT event_id, 2.0 * pow(2, event_id % 5) AS delay_s, event_id % 3 = 0 AS accepted FROM events")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(c("event_id") % 3 == 1, 500).otherwise(204)
    return table(spark, sf_dir, "events").select("event_id", X.backoff(F.lit(2.0), c("event_id") % 5 + 1).alias("delay_s"), state.accepted_reply(status, F.when(c("event_id") % 3 == 2, 1).otherwise(0)).alias("accepted"))


@query("""WITH t AS (SELECT p_partkey, p_size % 4 + 1 AS b, 2 AS a, p_size * 64 AS n FROM part)
SELECT p_partkey, len(list_distinct([[b, a, n], [1, CASE WHEN b > 1 THEN least(32, a * b) ELSE a END, n], [1, CASE WHEN b > 1 THEN least(32, a * b) ELSE a END, least(n, 2048)],
[1, CASE WHEN b > 1 THEN least(32, a * b) ELSE a END, least(n, 1536)], [1, CASE WHEN b > 1 THEN least(32, a * b) ELSE a END, least(n, 1024)]])) AS n_tries, least(n, 1024) AS last_length,
greatest(1, CASE WHEN b * 3 < 8 THEN 1 ELSE least(8, b * 3) END) AS world FROM t""")
def retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (c("p_size") % 4 + 1).alias("b"), (c("p_size") * 64).alias("n"))
    ladder = rows.withColumn("l", training_data.retry_ladder(c("b"), F.lit(2), c("n")))
    return ladder.select("p_partkey", F.size("l").alias("n_tries"), F.element_at("l", -1)["max_length"].alias("last_length"), X.world_size(F.lit(8), c("b") * 3).alias("world"))


# Attachments


@query("SELECT doc_id, md5(text) AS digest, CASE WHEN doc_id % 2 = 0 THEN 'base64' ELSE 'data_uri' END AS kind FROM documents")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = F.regexp_replace(F.translate(F.base64(c("text").cast("binary")), "+/", "-_"), "=+$", "")
    content = F.when(c("doc_id") % 2 == 0, safe).otherwise(F.concat(F.lit("data:text/plain;charset=utf-8;base64,"), safe))
    files = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.lit("a.txt").alias("name"), F.lit("").alias("content_type"), F.lit("base64").alias("encoding"))
    return attachments.classified(files).select("doc_id", F.md5("payload").alias("digest"), "kind")


@query("SELECT doc_id, sha256('v1' || chr(0) || text) AS cache_key FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", attachments.cache_key(c("text").cast("binary"), "v1").alias("cache_key"))


@query("""SELECT page_id, '【附件1 text】' || chr(10) || trim(html, chr(32) || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || '【附件2 decoded】' || chr(10) || trim(url, chr(32)) AS content FROM pages""")
def content_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as attachments: the raw markup as text, the address as base64, and one that cannot be read."""
    pages = table(spark, sf_dir, "pages")
    files = F.array(F.struct(c("html").alias("content"), F.lit("").alias("encoding")), F.struct(F.base64(c("url").cast("binary")).alias("content"), F.lit("base64").alias("encoding")), F.struct(F.lit("data:;base64,@@").alias("content"), F.lit("").alias("encoding")))
    each = pages.select("page_id", F.posexplode(files).alias("i", "f")).select("page_id", (c("i") + 1).alias("ordinal"), "f.*", F.lit("").alias("name"), F.lit("").alias("content_type"))
    texts = attachments.extracted(attachments.classified(each), "page_id", "ordinal")
    return attachments.content_sections(texts, "page_id", "ordinal")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://host/base/files/' || page_id ELSE NULL END AS url FROM pages")
def resolved_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(c("page_id") % 3 == 0, c("url")).when(c("page_id") % 3 == 1, F.concat(F.lit("/base/files/"), c("page_id").cast("string"))).otherwise(F.lit("ftp://x/y"))
    return table(spark, sf_dir, "pages").select("page_id", attachments.resolved_url(said, "https://host/base/").alias("url"))


# Review

ITEM_RULES = "array<struct<rank:int,rule_id:string,source:string,text:string,score:double>>"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archive items, every third without content, every fifth with keywords."""
    docs = table(spark, sf_dir, "documents")
    some = F.array(F.struct(F.lit(1).alias("rank"), F.lit("HK-001-01").alias("rule_id"), F.lit("corpus").alias("source"), F.concat(F.lit("text of "), c("source")).alias("text"), F.lit(1.0).alias("score")))
    none = F.array().cast(ITEM_RULES)
    return docs.select(
        c("doc_id").cast("string").alias("arid"), "doc_id", F.concat(F.lit("档案"), c("source")).alias("title"), F.lit("2024-05-06T00").alias("date_time"),
        F.when(c("doc_id") % 3 == 0, "").otherwise(c("text")).alias("content"), F.when(c("doc_id") % 2 == 0, some.cast(ITEM_RULES)).otherwise(none).alias("rules"),
        F.when(c("doc_id") % 5 == 0, F.array(F.lit("秘密"), F.lit(" 工资"))).otherwise(F.array().cast("array<string>")).alias("keywords"), F.when(c("doc_id") % 5 == 0, L.CONTROL).otherwise("").alias("audit_result"),
        *[F.lit(None).cast("string").alias(x) for x in review.METADATA.values()],
    )


SIGN, SAID = "命中关键字【秘密、工资】，关键字预审结果为【控制】", "按正文用词出现次数比较得出结论"


@query(f"""SELECT doc_id::VARCHAR AS arid, CASE WHEN doc_id % 5 = 0 THEN '控制' ELSE '开放' END AS jg,
CASE WHEN doc_id % 5 = 0 THEN '{SIGN}；' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '依据corpus（检索条款编号：HK-001-01），' ELSE '' END || '依据《延期开放档案标准及范围》，按正文用词判断'
|| CASE WHEN doc_id % 5 <> 0 AND (doc_id % 3 = 0 OR trim(text) = '') THEN '；{review.LIMITATION}' ELSE '' END AS yj,
CASE WHEN doc_id % 2 = 1 THEN 5.0 WHEN doc_id % 5 <> 0 AND (doc_id % 3 = 0 OR trim(text) = '') THEN 6.0 ELSE 8.0 END::DOUBLE AS zxd,
CASE WHEN doc_id % 5 = 0 THEN '{SIGN}。' ELSE '' END || '{SAID}' || CASE WHEN doc_id % 5 <> 0 AND (doc_id % 3 = 0 OR trim(text) = '') THEN '{review.LIMITATION}' ELSE '' END AS thinking FROM documents""")
def review_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = L.profile("hk")
    items = _items(spark, sf_dir)
    return review.response_rows(review.review(items, p, review.keyword_predictor(p), review.prompt(p)))


def _result(label: Column, basis: Column, sure: Column) -> Column:
    return review.result_of(label, basis, sure, F.lit("思考"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '开放' ELSE '控制' END AS result, CASE WHEN doc_id % 2 = 0 THEN '依据corpus（检索条款编号：HK-001-01），' || lang ELSE lang END AS basis,
CASE WHEN doc_id % 2 = 0 THEN 9.5 ELSE 5.0 END::DOUBLE AS confidence FROM documents""")
def rule_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(c("doc_id") % 4 == 0, "应开放").when(c("doc_id") % 4 == 1, "不开放").otherwise("?")
    items = _items(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    r = review.bounded_by_rules(_result(said, c("lang"), F.lit(9.5)), c("rules"), L.profile("hk"))
    return items.select("doc_id", r.alias("r")).select("doc_id", "r.result", "r.basis", "r.confidence")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '控制' ELSE '开放' END AS result,
CASE WHEN doc_id % 5 = 0 THEN '命中关键字【秘密、工资】，关键字预审结果为【控制】；b' ELSE 'b' END || CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN '；未提供档案正文，本次仅依据题名、日期及档案元数据辅助判断，建议人工复核。' ELSE '' END AS basis,
CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 6.0 ELSE 9.0 END::DOUBLE AS confidence FROM documents""")
def keyword_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword decision, then the missing-content guard."""
    first = review.decided_by_keywords(_result(F.lit(L.OPEN), F.lit("b"), F.lit(9.0)), c("keywords"), c("audit_result"))
    items = _items(spark, sf_dir).withColumn("r", first)
    return items.select("doc_id", review.guarded(c("r"), c("content"), c("keywords")).alias("r")).select("doc_id", "r.result", "r.basis", "r.confidence")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '永久' WHEN 2 THEN '10年' ELSE '30年' END AS result,
'依据档案保管规范，' || CASE doc_id % 4 WHEN 0 THEN '一般文件第' || length(text) || '条' WHEN 1 THEN '重大规划文件第' || length(text) || '条' WHEN 2 THEN '根据档案标题和内容特征，综合判定为【10年】' ELSE '根据档案标题和内容特征，综合判定为【30年】' END AS basis,
CASE doc_id % 4 WHEN 0 THEN greatest(6.0, round_even(length(text) % 90 / 10.0 + 1, 1)) WHEN 1 THEN 7.3 WHEN 2 THEN 8.5 ELSE 7.0 END::DOUBLE AS confidence,
CASE doc_id % 4 WHEN 0 THEN '一般行政管理文件共' || length(text) || '字' WHEN 1 THEN '具有历史意义的文件共' || length(text) || '字' ELSE '已对档案标题及基本信息完成合规性要素审查。' END AS thinking FROM documents""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in several shapes, which name the text's length, through the parse cascade and post-processing."""
    p = L.profile("jd")
    n = F.length("text").cast("string")
    sure = F.round(F.length("text") % 90 / 10 + 1, 1).cast("string")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    shapes = [
        said('<think>一般行政工作</think>```json\n{"审核结果":"30年","审核依据":"依据档案保管规范，一般文件第', n, '条","置信度":', sure, ',"思考过程":"一般行政管理文件共', n, '字"}\n```'),
        said("{'审核结果':'永久','审核依据':'重大规划文件第", n, "条','置信度':7.26,'思考过程':'具有历史意义的文件共", n, "字'}"),
        said("审核结果：10年\n审核依据：日常事务文件，无长期价值\n置信度：8.5"),
        said("nothing to parse ", n),
    ]
    answer = F.element_at(F.array(*shapes), (c("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"))
    thinking = review.sanitized(review.reasoning(c("answer")))
    docs = docs.withColumn("thinking", thinking).withColumn("body", review.cleaned_answer(review.split_thinking(c("answer"))[1]))
    docs = docs.withColumn("r", review.parsed(c("body"), c("thinking"), p))
    return docs.select("doc_id", review.postprocessed(c("r"), c("thinking"), p).alias("r")).select("doc_id", "r.*")




# Requests


def _request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON requests of two items each, with names in both languages and some faults."""
    docs, i = table(spark, sf_dir, "documents"), c("doc_id")
    words = F.when(i % 4 == 0, F.array(F.lit(" k1 "), F.lit("k2"), F.lit("k1"))).otherwise(F.array().cast("array<string>"))
    said = F.when(i % 4 == 0, L.OPEN).when(i % 13 == 5, L.CONTROL).otherwise("")
    first = F.struct(F.lit("a").alias("arid"), c("source").alias("题名"), F.lit("20240500").alias("成文日期"), c("text").alias("content"), words.alias("keywords"), said.alias("audit_result"), F.array("lang").alias("files"), F.lit("x").alias("other"))
    second = F.struct(F.lit("b").alias("arid"), F.when(i % 11 == 3, "").otherwise(c("lang")).alias("title"), F.lit(" 20230000").alias("date_time"), c("lang").alias("门类"))
    fields = {"modelId": c("source"), "aiAuditId": F.concat(F.lit("r"), i.cast("string")), "modelType": F.when(i % 6 == 1, "jd").otherwise("hk")}
    head = ", ".join(f'"{k}": "%s"' for k in fields)
    item = lambda s: F.to_json(s)
    more = F.when(i % 9 == 2, ', "extra": 1').otherwise("")
    data = F.when(i % 10 == 7, "[]").otherwise(F.concat(F.lit("["), item(first), F.lit(", "), item(second), F.lit("]")))
    line = F.concat(F.format_string("{" + head, *fields.values()), more, F.lit(', "data": '), data, F.lit("}"))
    return docs.select("doc_id", F.when(i % 17 == 4, "not JSON").otherwise(line).alias("text"))


REQUEST_ERROR = "CASE WHEN doc_id % 17 = 4 THEN 'no JSON object' WHEN doc_id % 9 = 2 THEN 'unknown field: extra' WHEN doc_id % 10 = 7 THEN 'data is empty' END"


@query(f"SELECT doc_id, {REQUEST_ERROR} AS error FROM documents")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.parsed_requests(_request_lines(spark, sf_dir)).select("doc_id", "error")


ITEM_ERROR = "CASE WHEN n = 1 AND doc_id % 4 <> 0 AND doc_id % 13 = 5 AND doc_id % 6 <> 1 THEN 'a result without keywords' WHEN n = 2 AND doc_id % 11 = 3 THEN 'title is empty' END"


@query(f"""SELECT doc_id, n AS number, CASE n WHEN 1 THEN source ELSE CASE WHEN doc_id % 11 = 3 THEN '' ELSE lang END END AS title, CASE n WHEN 1 THEN '2024-05' ELSE '2023' END AS date_time,
CASE n WHEN 1 THEN '' ELSE lang END AS archive_category, CASE WHEN n = 1 AND doc_id % 4 = 0 AND doc_id % 6 <> 1 THEN 'k1,k2' ELSE '' END AS keywords,
CASE WHEN n = 1 AND doc_id % 6 <> 1 THEN CASE WHEN doc_id % 4 = 0 THEN '开放' WHEN doc_id % 13 = 5 THEN '控制' ELSE '' END ELSE '' END AS audit_result,
CASE n WHEN 1 THEN lang ELSE '' END AS files, {ITEM_ERROR} AS error
FROM documents, (VALUES (1), (2)) AS v(n) WHERE {REQUEST_ERROR} IS NULL""")
def request_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = requests.request_items(requests.parsed_requests(_request_lines(spark, sf_dir)), "doc_id")
    return items.select("doc_id", "number", "title", "date_time", "archive_category", F.array_join("keywords", ",").alias("keywords"), "audit_result", F.array_join("files", ",").alias("files"), "error")


@query(f"""SELECT doc_id, count(*) AS n_items FROM documents, (VALUES (1), (2)) AS v(n) WHERE {REQUEST_ERROR} IS NULL GROUP BY doc_id HAVING count({ITEM_ERROR}) = 0""")
def accepted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One broken item refuses its request."""
    items = requests.request_items(requests.parsed_requests(_request_lines(spark, sf_dir)), "doc_id")
    return requests.accepted_items(items).groupBy("doc_id").agg(F.count("*").alias("n_items"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'unknown model' WHEN p_brand <> 'Brand#' || (11 + l_orderkey % 5) THEN 'another type of model' END AS model_error
FROM (SELECT *, l_partkey * 2 AS k FROM lineitem) LEFT JOIN part ON k = p_partkey""")
def model_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.concat(F.lit("Brand#"), (c("l_orderkey") % 5 + 11).cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") * 2).alias("model_id"), wanted.alias("model_type"))
    registry = table(spark, sf_dir, "part").select(c("p_partkey").alias("model_id"), c("p_brand").alias("model_type"))
    return requests.model_errors(lines, registry).select("l_orderkey", "l_linenumber", "model_error")


@query("SELECT p_brand, count(*) AS n_models FROM part GROUP BY 1")
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.registry_counts(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'o' || n_nationkey ELSE n_regionkey::VARCHAR END AS value FROM nation")
def resolved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    over = nations.where("n_nationkey % 3 <> 1").select(c("n_name").alias("name"), F.when(c("n_nationkey") % 3 == 0, F.concat(F.lit("o"), c("n_nationkey").cast("string"))).otherwise("").alias("value"))
    return requests.settings(nations.select(c("n_name").alias("name"), c("n_regionkey").cast("string").alias("value")), over.union(spark.range(1).select(F.lit("unknown"), F.lit("x"))))


@query("SELECT event_id, event_id % 3 <> 1 AS out_of_memory, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS n_values, round_even(18.0 + (event_id % 4 + 0.85 * (event_id % 7 + 1) / 7) * 76.0 / 4, 1)::DOUBLE AS percentage FROM events")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that say that memory is used up, single values as lists, and the percentage after a batch."""
    i = c("event_id")
    message = F.when(i % 3 == 0, "x NPU out of memory. y").when(i % 3 == 2, "ACL_ERROR_RT_MEMORY_ALLOCATION").otherwise("memory")
    one = F.when(i % 2 == 1, c("event_type"))
    return table(spark, sf_dir, "events").select("event_id", requests.out_of_memory(message).alias("out_of_memory"), F.size(requests.as_list(one)).alias("n_values"), X.training_progress(i % 4, F.lit(4), i % 7 + 1, F.lit(7)).alias("percentage"))


# Attachments as objects, and the cache of extracted texts


@query("""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'data_uri' WHEN 1 THEN 'url' WHEN 2 THEN 'text' WHEN 3 THEN 'base64' WHEN 4 THEN 'base64' WHEN 5 THEN 'bytes' WHEN 6 THEN 'url' WHEN 7 THEN 'text' ELSE 'failed' END AS kind,
CASE WHEN doc_id % 9 IN (0, 3, 4) THEN md5(text) WHEN doc_id % 9 = 5 THEN md5('AB') END AS digest, CASE doc_id % 9 WHEN 1 THEN '/files/' || doc_id WHEN 2 THEN source WHEN 6 THEN 'https://h/' || doc_id WHEN 7 THEN '/looks/like' END AS content,
CASE doc_id % 9 WHEN 3 THEN 'b.pdf' WHEN 4 THEN 'a.txt' ELSE '' END AS name, CASE WHEN doc_id % 9 = 4 THEN 'text/plain' ELSE '' END AS content_type FROM documents""")
def attachment_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments as JSON: strings and objects in nine shapes."""
    coded, i = F.base64(c("text").cast("binary")), c("doc_id")
    text = lambda x: F.get_json_object(F.to_json(F.struct(F.array(x).alias("v"))), "$.v")
    quoted = lambda x: F.regexp_extract(text(x), r"(?s)^\[(.*)\]$", 1)
    shapes = [
        quoted(F.concat(F.lit("data:text/plain;base64,"), coded)),
        quoted(F.concat(F.lit("/files/"), i.cast("string"))),
        quoted(c("source")),
        F.to_json(F.struct(coded.alias("content"), F.lit("B64").alias("encoding"), F.lit("").alias("name"), F.lit("b.pdf").alias("fileName"))),
        F.to_json(F.struct(F.lit("<base64>").alias("content"), coded.alias("fileData"), F.lit("a.txt").alias("originalName"), F.lit("text/plain").alias("mimeType"))),
        F.to_json(F.struct(F.array(F.lit(65), F.lit(66)).alias("binary"))),
        F.to_json(F.struct(F.lit("").alias("content"), F.concat(F.lit("https://h/"), i.cast("string")).alias("url"))),
        F.to_json(F.struct(F.lit("/looks/like").alias("content"), F.lit("https://h/never").alias("url"))),
        F.to_json(F.struct(F.array(F.lit(65), F.lit(300)).alias("bytes"))),
    ]
    files = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*shapes), (i % 9 + 1).cast("int")).alias("raw"))
    return attachments.dispatched(files).select("doc_id", "kind", F.md5("payload").alias("digest"), "content", "name", "content_type")


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.lit(1).alias("ordinal"), c("text").cast("binary").alias("payload"))
    known = docs.where("doc_id % 4 < 2").select(attachments.cache_key(c("text").cast("binary"), "v1").alias("cache_key"), F.lit("cached").alias("method"), F.when(c("doc_id") % 4 == 0, "t").otherwise(" ").alias("text"))
    return attachments.with_cache(files, known.groupBy("cache_key").agg(F.first("method").alias("method"), F.max("text").alias("text")), "v1", lambda df: attachments.decoded_rows(df, "doc_id", "ordinal"), "doc_id", "ordinal")


CACHED = "(SELECT DISTINCT text FROM documents WHERE doc_id % 4 = 0)"


@query(f"SELECT doc_id, CASE WHEN text IN {CACHED} THEN 'cached' ELSE 'decoded' END AS method, md5(CASE WHEN text IN {CACHED} THEN 't' ELSE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) END) AS digest FROM documents")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a fourth of the documents are in the cache; blank entries are no hits."""
    return _cached(spark, sf_dir)[0].select("doc_id", "method", F.md5("text").alias("digest"))


@query(f"SELECT sha256('v1' || chr(0) || text) AS cache_key, 'decoded' AS method, md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS digest FROM (SELECT DISTINCT text FROM documents WHERE text NOT IN {CACHED})")
def cache_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir)[1].select("cache_key", "method", F.md5("text").alias("digest"))


# Training text and tokens


def _code_points():
    return lambda text: [ord(x) for x in text]


@query("""WITH s AS (SELECT doc_id, '系统' || chr(10) || chr(10) || lang || chr(10) || chr(10) || trim(text, chr(32) || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || '输出：' AS p, source || '</s>' AS a FROM documents)
SELECT doc_id, md5(p) AS prompt, a AS answer FROM s""")
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training_text(spark, sf_dir).select("doc_id", F.md5("prompt").alias("prompt"), "answer")


def _training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(c("doc_id") % 2 == 0, F.concat(F.lit(" "), c("source"))).otherwise(F.concat(c("source"), F.lit("</s>\n")))
    prompt = F.replace(training_data.training_prompt(c("lang"), c("text"), "系统"), F.lit(training_data.ANSWER_MARK), F.lit("输出："))
    return table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"), training_data.answer_text(told, "</s>").alias("answer"))


@query("""WITH s AS (SELECT doc_id, length(lang) + length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) + 11 AS p, length(source) + 4 AS a FROM documents)
SELECT doc_id, least(p, 512 - a) + a AS n_tokens, a AS n_learnable, least(p, 512 - a) + a AS n_mask FROM s""")
def tokenized_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With code points as tokens."""
    rows = training_data.tokenized(_training_text(spark, sf_dir), "prompt", "answer", _code_points, 512, 3, "doc_id")
    return rows.select("doc_id", F.size("input_ids").alias("n_tokens"), training_data.learnable(c("labels")).alias("n_learnable"), F.size("attention_mask").alias("n_mask"))


@query("""WITH e AS (SELECT user_id, date_trunc('day', ts)::DATE AS epoch, round(avg(value), 6) AS loss, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, min(loss) AS best, count(*) AS n_epochs, sum(n)::BIGINT AS n_samples FROM e GROUP BY 1""")
def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics' JSON, read again."""
    events = table(spark, sf_dir, "events").withColumns({"epoch": c("ts").cast("date"), "part": F.when(c("event_id") % 4 == 0, "validation").otherwise("train")})
    out = training_data.training_metrics(training_data.epoch_losses(events, ["user_id", "epoch"], "value"), "user_id", "epoch", "loss", events)
    m = F.from_json("metrics", "best_validation_loss double, train_sample_count long, validation_sample_count long, history array<struct<epoch:string,validation_loss:double>>")
    return out.select("user_id", m.alias("m")).select("user_id", c("m.best_validation_loss").alias("best"), F.size("m.history").cast("long").alias("n_epochs"), (c("m.train_sample_count") + c("m.validation_sample_count")).alias("n_samples"))


@query("SELECT event_type, sum(user_id)::DOUBLE / sum(event_id % 7) AS seconds_per_record FROM events GROUP BY 1")
def seconds_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.seconds_per_record(table(spark, sf_dir, "events").withColumn("n", c("event_id") % 7), ["event_type"], "user_id", "n")


# Callbacks, conversations and appraisal


@query("""WITH o AS (SELECT event_id, event_id % 3 AS attempts, event_id % 5 = 0 AS sent, event_id % 4 AS kind FROM events)
SELECT event_id, CASE WHEN sent OR kind = 3 THEN attempts ELSE attempts + 1 END AS attempts, (sent OR kind = 0) AS sent,
(NOT sent AND kind IN (1, 2) AND attempts < 2) AS waits, (NOT sent AND kind IN (1, 2) AND attempts = 2) AS renewed FROM o""")
def callback_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round: of four kinds of entries one succeeds, two fail, one is not due; then those out of attempts begin anew."""
    i, now = c("event_id"), F.lit(100.0)
    box = table(spark, sf_dir, "events").select("event_id", (i % 3).cast("int").alias("attempts"), (i % 5 == 0).alias("sent"), F.when(i % 4 == 3, 200.0).otherwise(90.0).alias("next_at"), F.lit(None).cast("string").alias("last_error"))
    status = F.when(i % 4 == 2, 500).otherwise(200)
    outcome = state.due(box, now).select("event_id", status.alias("status"), F.when(i % 4 == 1, 7).when(i % 4 == 0, 200).alias("code"), F.lit(None).cast("string").alias("error"))
    after = state.attempted(box, outcome, "event_id", now)
    again = state.renewed(after, now).select("event_id", (c("attempts") == 0).alias("anew"))
    waits = ~c("sent") & (c("next_at") > now) & (c("next_at") < 200)
    return after.join(again, "event_id").select("event_id", "attempts", "sent", F.coalesce(waits, F.lit(False)).alias("waits"), (~c("sent") & c("next_at").isNull()).alias("renewed"))


@query("""SELECT o_custkey AS ai_audit_id, count(*) AS n, sum(o_totalprice > 100000)::BIGINT AS n_open, min(o_orderkey) AS first_id FROM orders GROUP BY 1""")
def review_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of each request's callback, read again."""
    rows = table(spark, sf_dir, "orders").select(c("o_custkey").alias("ai_audit_id"), c("o_orderkey").alias("number"), c("o_orderkey").cast("string").alias("arid"), F.when(c("o_totalprice") > 100000, L.OPEN).otherwise(L.CONTROL).alias("jg"), F.lit("b").alias("yj"), F.lit(8.0).alias("zxd"), F.lit("t").alias("thinking"))
    read = F.from_json("payload", "aiAuditId long, data array<struct<arid:string,jg:string,yj:string,zxd:double,thinking:string>>")
    said = state.review_callbacks(rows).select(read.alias("p"))
    return said.select(c("p.aiAuditId").alias("ai_audit_id"), F.size("p.data").cast("long").alias("n"), F.size(F.filter("p.data", lambda r: r["jg"] == L.OPEN)).cast("long").alias("n_open"), F.get("p.data", 0)["arid"].cast("long").alias("first_id"))


@query("SELECT event_id FROM events WHERE event_id % 100 > 60")
def cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (c("event_id") % 100).alias("changed"))
    return state.without_expired(rows, "changed", F.lit(100), 40).select("event_id")


@query("""WITH m AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, text AS "user", t2 AS assistant FROM m WHERE role = 'user' AND r2 = 'assistant'""")
def conversation_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations saved as JSON and loaded again."""
    return state.loaded_conversations(state.saved_conversations(state.exchanges(table(spark, sf_dir, "conversations"))))


def _clerk(text: Column) -> Column:
    """A predictor that answers first questions in words, and second ones by the year in the first."""
    year = F.regexp_extract(text, r"档案形成日期：(\d{4})", 1).cast("int")
    title = F.regexp_extract(text, r"档案题名：(.*)", 1)
    verdict = F.to_json(F.struct(F.when(2026 - year >= 30, L.OPEN).otherwise(L.CONTROL).alias("审核结果"), F.concat(title, F.lit("形成于"), year.cast("string")).alias("审核依据"), F.lit("8.5").alias("置信度")))
    told = F.when(year % 5 == 0, "没有结论").when(year % 2 == 0, verdict).otherwise(F.concat(F.lit("结果：\n"), verdict, F.lit("\n完")))
    return F.when(text.contains("请完成鉴定"), told).otherwise(F.concat(F.lit("将参考保管期限规定："), title))


@query("""SELECT o_orderkey, CASE WHEN none THEN NULL WHEN 2026 - y >= 30 THEN '开放' ELSE '控制' END AS result, CASE WHEN NOT none THEN o_orderstatus || ' ' || o_orderkey || '形成于' || y END AS basis, CASE WHEN NOT none THEN '8.5' END AS confidence
FROM (SELECT *, year(o_orderdate) AS y, year(o_orderdate) % 5 = 0 AS none FROM orders)""")
def two_turn_appraisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderstatus", c("o_orderkey").cast("string")).alias("title"), F.date_format("o_orderdate", "yyyyMMdd").alias("date_time"), F.lit("20260101").alias("date_now"))
    v = c("verdict")
    return appraisal.appraised(rows, _clerk).select("o_orderkey", v["审核结果"].alias("result"), v["审核依据"].alias("basis"), v["置信度"].alias("confidence"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN CASE WHEN doc_id % 4 = 1 THEN '10年' ELSE '' END WHEN doc_id % 4 = 0 THEN '永久' ELSE '' END AS result,
CASE WHEN doc_id % 2 = 0 THEN '依据corpus（检索条款编号：JD-001-01），保管期限为永久或30年' ELSE '未检索到可核验的规范条款，审核依据不足。' END AS basis, CASE WHEN doc_id % 2 = 0 THEN 9.5 ELSE 5.0 END::DOUBLE AS confidence FROM documents""")
def retention_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods that retrieved rules name bound the result: exactly one of them, or none."""
    docs = table(spark, sf_dir, "documents")
    rule = F.struct(F.lit(1).alias("rank"), F.lit("JD-001-01").alias("rule_id"), F.lit("corpus").alias("source"), F.lit("保管期限为永久或30年").alias("text"), F.lit(1.0).alias("score"))
    found = F.when(c("doc_id") % 2 == 0, F.array(rule).cast(ITEM_RULES)).otherwise(F.array().cast(ITEM_RULES))
    said = F.when(c("doc_id") % 4 == 0, "永久").when(c("doc_id") % 4 == 1, "10年").when(c("doc_id") % 4 == 2, "10年").otherwise("约30年")
    r = review.bounded_by_rules(_result(said, F.lit(""), F.lit(9.5)), found, L.profile("jd"))
    return docs.select("doc_id", r.alias("r")).select("doc_id", "r.result", "r.basis", "r.confidence")


# Sources


#: Characters of documents that a file of JSON Lines gets, about.
FILE_CHARS = 16_000_000


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, md5(text) AS digest FROM documents WHERE text <> ''")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text written as JSON Lines and read in order again: a file's lines are numbered whatever blocks it is
    read in. Every line is a sample, also of a document without a language or an id; one without an id comes last."""
    folder = shared_folder(spark)
    doc_id, lang = F.coalesce(c("doc_id").cast("string"), F.lit("none")), F.concat(F.lit("lang: "), F.coalesce("lang", F.lit("")))
    rows = table(spark, sf_dir, "documents").where("text <> ''").select(F.lit("i").alias("instruction"), c("text").alias("input"), F.to_json(F.struct(doc_id.alias("审核结果"), lang.alias("审核依据"))).alias("output"), "doc_id")
    chars = rows.agg(F.sum(F.length("input"))).first()[0] or 0
    files = max(4, -(-chars // FILE_CHARS))
    order = c("doc_id").asc_nulls_last()
    jsonl.write(rows.repartitionByRange(files, order).sortWithinPartitions(order).drop("doc_id"), folder)
    lines = jsonl.checked_samples(jsonl.lines_in_order(spark, folder)).where("error IS NULL")
    again = F.get_json_object("output", "$.审核结果").try_cast("long")
    n = lines.groupBy("file").agg(F.count("*").alias("n"), F.min(again).alias("first"))  # a row a file
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy(c("first").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = lines.join(F.broadcast(n.withColumn("before", before)), "file")
    return both.select(again.alias("doc_id"), (c("before") + c("line")).alias("place"), F.md5("input").alias("digest"))


@query("SELECT s_suppkey::VARCHAR AS model_id, s_name AS model_name, s_nationkey AS model_epochs FROM supplier")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry as JSON objects keyed by model, one of them on each line of files that ordinary rows have written."""
    from pyspark.sql import types as T

    folder = shared_folder(spark)
    value = F.struct(c("s_name").alias("model_name"), c("s_nationkey").alias("model_epochs"))
    table(spark, sf_dir, "supplier").select(F.to_json(F.create_map(c("s_suppkey").cast("string"), value))).write.text(folder)
    kind = T.StructType([T.StructField("model_name", T.StringType()), T.StructField("model_epochs", T.IntegerType())])
    return jsonl.keyed_object(spark, folder, kind, lines=True)
