"""Training-set preparation: nested records to samples, with gates, first-wins dedup and label distribution."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.labels import open_label, period_label, risk_elements
from ..functions.text import confidence, first_present, strip
from ..functions.variants import holds, leaves, parsed
from ..sources.shared import small_batches

# Candidate keys of a record's fields, in order, and defaults.
TITLE_KEYS = ["tm", "题名", "title", "archiveTitle"]
DATE_KEYS = ["cwrq", "成文日期", "date_time", "date", "gdnd", "归档年度", "year"]
BASIS_KEYS = ["lyg_audit_basis", "audit_basis", "审核依据", "依据", "reason"]
OPEN_KEYS = ["kzf", "开放意见", "审核结果", "result"]
PERIOD_KEYS = ["bgqx", "保管期限", "审核结果", "result"]
CONFIDENCE_KEYS = ["置信度", "confidence", "audit_confidence"]
RETRIEVAL_KEYS = {
    "archive_category": ["门类", "ml", "arcode"],
    "organization_problem": ["机构或问题", "jghwt", "jgwt"],
    "fonds_no": ["全宗号", "qzh"],
    "document_no": ["文号", "wh"],
    "responsible_org": ["责任者", "zrz"],
}
NO_TITLE, NO_DATE = "无题名", "未知"
NO_CONTENT = "（未提供档案正文或附件，本样本仅使用题名、日期及现有元数据）"
OMITTED = "\n……中间非关键内容已省略……\n"
OUTPUT_FIELDS = ["审核结果", "审核依据", "置信度", "思考过程"]


def of(record: Column, keys: list[str], default: str | None = "") -> Column:
    """The first present value of a map<string,string> under candidate keys."""
    return first_present(*[record[k] for k in keys], default=default)


#: A training payload: an object whose data holds records with loosely named fields.
PAYLOAD = "data array<struct<record:map<string,string>,files:array<string>>>"


def payload(spark: SparkSession, path: str) -> DataFrame:
    """data of landed payload files, one JSON object each (they are read whole). A file that holds anything else fails the job."""
    whole = spark.read.text(path, wholetext=True)
    good = F.json_object_keys("value").isNotNull()
    text = F.when(good, F.col("value")).otherwise(F.raise_error(F.lit("the payload is no JSON object")).cast("string"))
    return whole.select(F.from_json(text, PAYLOAD).alias("p")).select("p.data")


def records(payloads: DataFrame, *keep: str) -> DataFrame:
    """ordinal, record and files of each element of data: array<struct<record: map, files: array>>, and the columns to keep. A
    record's own files come first (its value files, a JSON array), else the element's; elements without a record go."""
    each = payloads.select(*keep, F.posexplode("data").alias("ordinal", "d")).where(F.col("d.record").isNotNull())
    own = F.from_json(F.col("d.record")["files"], "array<string>")
    files = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.coalesce("d.files", F.array().cast("array<string>")))
    return each.select(*keep, "ordinal", F.col("d.record").alias("record"), files.alias("files"))


def has_files(files: Column) -> Column:
    """Whether any of the attachments, texts or JSON of any depth, is there: an object with a field, or a text that does not stand
    for a missing value. Lists count by what is in them."""
    held = lambda x: F.exists(leaves(parsed(x), x), holds)
    return F.coalesce(F.exists(files, lambda x: x.isNotNull() & F.coalesce(held(x), F.lit(False))), F.lit(False))


def projected(rows: DataFrame, kind: str) -> DataFrame:
    """Adds the canonical fields of a record: title, date_time, basis, label, confidence and the retrieval metadata."""
    record = F.col("record")
    label = open_label(of(record, OPEN_KEYS)) if kind == "hk" else period_label(of(record, PERIOD_KEYS))
    columns = {
        "title": of(record, TITLE_KEYS, NO_TITLE),
        "date_time": of(record, DATE_KEYS, NO_DATE),
        "basis": of(record, BASIS_KEYS),
        "label": label,
        "confidence": confidence(of(record, CONFIDENCE_KEYS)),
    }
    return rows.withColumns(columns | {name: of(record, keys) for name, keys in RETRIEVAL_KEYS.items()})


REASONS = ["label is not valid", "no basis", "attachments without content", "neither content nor title and date"]


def reject_reason(label: Column, basis: Column, content: Column, attached: Column, title: Column, date: Column) -> Column:
    """Why a record makes no sample, null if it does."""
    empty = F.coalesce(content, F.lit("")) == ""
    return (
        F.when(label.isNull(), REASONS[0])
        .when(basis == "", REASONS[1])
        .when(empty & attached, REASONS[2])
        .when(empty & ((title == NO_TITLE) | (date == NO_DATE)), REASONS[3])
    )


def evidence(content: str, words: list[str], limit: int = 2200) -> str:
    """Head, tail, and between them windows around the first two occurrences of each word, as far as the limit goes."""
    content = (content or "").strip()
    if len(content) <= limit:
        return content
    head, tail = min(650, max(200, limit // 3)), len(content) - min(500, max(150, limit // 4))
    spans = sorted((max(0, m.start() - 130), min(len(content), m.end() + 220)) for w in words for m, _ in zip(re.finditer(re.escape(w), content), range(2)))
    left, chosen = limit - head - (len(content) - tail) - 2 * len(OMITTED), [(0, head)]
    for start, end in _merged(spans):
        start, end = max(start, head), min(end, tail, max(start, head) + left)
        if left > 0 and end > start:
            chosen.append((start, end))
            left -= end - start + len(OMITTED)
    parts = [content[a:b].strip() for a, b in _merged([*chosen, (tail, len(content))])]
    return OMITTED.join(filter(None, parts)).strip()[:limit]


def _merged(spans: list[tuple[int, int]], gap: int = 30) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def evidence_excerpt(content: Column, words: list[str], limit: int = 2200) -> Column:
    """A fold with a budget, so an Arrow function."""
    limit = max(500, limit)
    small_batches()

    @F.pandas_udf("string")
    def excerpt(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: evidence(t, words, limit))

    return excerpt(content)


def sample_output(label: Column, prefix: str, basis: Column, value: Column) -> Column:
    """The answer as JSON; full stops, commas and semicolons at the basis's end go; an empty basis gets a sentence."""
    plain = F.regexp_replace(strip(basis), "[。.,;；]+$", "")
    plain = F.when(plain == "", F.concat(F.lit("根据档案题名和日期综合判定为"), label)).otherwise(plain)
    return F.to_json(F.struct(label.alias("审核结果"), F.concat(F.lit(prefix + "，"), plain).alias("审核依据"), value.alias("置信度"), plain.alias("思考过程")))


def sample_input(kind: str, content: Column, excerpt: Column, rules: Column) -> Column:
    """The question as JSON, of the canonical columns, with candidate rules in order."""
    empty = F.coalesce(content, F.lit("")) == ""
    risk = risk_elements(content) if kind == "hk" else F.lit(None)
    fields = {
        "题名": F.col("title"),
        "成文日期": F.col("date_time"),
        "门类": F.col("archive_category"),
        "机构或问题": F.col("organization_problem"),
        "全宗号": F.col("fonds_no"),
        "文号": F.col("document_no"),
        "责任者": F.col("responsible_org"),
        "训练证据类型": F.when(empty, "题名和日期元数据").otherwise("正文或附件"),
        "正文": F.when(empty, NO_CONTENT).otherwise(excerpt),
        "正文是否节选": ~empty & (F.length(excerpt) < F.length(content)),
        "风险要素": F.transform(F.coalesce(risk, F.array().cast("array<struct<category:string,words:string,evidence:string>>")), lambda x: F.struct(x["category"].alias("类型"), x["words"].alias("关键词"), x["evidence"].alias("证据片段"))),
        "候选规范条款": F.transform(rules, lambda r: F.struct(r["rule_id"].alias("rule_id"), r["source"].alias("来源"), r["text"].alias("内容"))),
    }
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


#: What a sample asks for unless the caller says otherwise, by kind of review.
INSTRUCTIONS = {"hk": "请判断档案应当开放还是控制。", "jd": "请判定档案的保管期限。"}


def samples(rows: DataFrame, kind: str, basis_prefix: str, content: str = "text", excerpt: Column | None = None, rules: Column | None = None, instruction: str | None = None) -> DataFrame:
    """Adds reject_reason, instruction, input and output to projected records with content and files: whole training samples of
    the kind, hk or jd. Those with a reason are null in input and output."""
    body = F.col(content)
    reason = reject_reason(F.col("label"), F.col("basis"), body, has_files(F.col("files")), F.col("title"), F.col("date_time"))
    none = F.array().cast("array<struct<rank:int,rule_id:string,source:string,text:string,score:double>>")
    asked = sample_input(kind, body, body if excerpt is None else excerpt, F.coalesce(rules, none) if rules is not None else none)
    told = sample_output(F.col("label"), basis_prefix, F.col("basis"), F.col("confidence"))
    good = F.col("reject_reason").isNull()
    out = rows.withColumn("reject_reason", reason)
    return out.withColumns({"instruction": F.lit(instruction or INSTRUCTIONS[kind]), "input": F.when(good, asked), "output": F.when(good, told)})


def fingerprint(question: str = "input", answer: str = "output") -> Column:
    """Equal for samples with equal question and answer."""
    return F.sha2(F.to_json(F.struct(question, answer)), 256)


def _turn(rows: DataFrame, order: list[str]) -> Column:
    """The order of a row, with a hash of all its values where the order repeats."""
    plain = [F.to_json(F.col(c)) if isinstance(rows.schema[c].dataType, (MapType, ArrayType, StructType)) else F.col(c) for c in rows.columns]
    return F.struct(*order, F.xxhash64(*plain).alias("__hash"))


def marked_duplicates(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds duplicate: whether a valid sample is not the first by order of those with its input and output. Of rows that are
    equal in all values one is the first. The first of each is found by adding up, not by sorting; an order may repeat."""
    keyed = rows.withColumn("__key", F.when(F.col("reject_reason").isNull(), fingerprint())).withColumn("__turn", _turn(rows, order))
    first = keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.min("__turn").alias("__first"))
    both = keyed.join(first, "__key", "left").withColumn("__is", F.coalesce(F.col("__turn") == F.col("__first"), F.lit(False)))
    # only the first row, and rows equal to it in all values, are numbered together
    place = F.when(F.col("__is"), F.col("__key")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    twin = F.row_number().over(Window.partitionBy("__place").orderBy("__key"))
    marked = both.withColumn("__place", place).withColumn("__twin", twin)
    return marked.withColumn("duplicate", F.col("__key").isNotNull() & (~F.col("__is") | (F.col("__twin") > 1))).drop("__key", "__turn", "__first", "__is", "__place", "__twin")


class Counts:
    """What the pass that writes samples has seen: n_raw rows, the rejected ones by reason, n_valid and n_duplicates."""

    def __init__(self, raw: Observation, kept: Observation, reasons: list[str]):
        self.raw, self.kept, self.reasons = raw, kept, reasons

    def get(self) -> dict:
        """Waits for the pass. Keys: n_raw, n_valid, n_duplicates, and rejected: the number of each reason."""
        raw, kept = self.raw.get, self.kept.get
        valid = kept["n_valid"]
        rejected = {r: raw[f"r{k}"] for k, r in enumerate(self.reasons)}
        return {"n_raw": raw["n_raw"], "n_valid": valid, "n_duplicates": raw["n_good"] - valid, "rejected": rejected}


def distinct_samples(rows: DataFrame, order: list[str], keep: list[str]) -> tuple[DataFrame, Counts]:
    """The valid samples, of equal ones the first by order (the columns `keep`), and counts that are known when they have been
    written or collected once: they are observed as the rows pass, with no scan of their own. Samples are reduced to the
    first of each key before they are shuffled, so a sample that is there very often moves once from each task."""
    raw, kept = Observation(), Observation()
    reasons = [F.count_if(F.col("reject_reason") == r).alias(f"r{k}") for k, r in enumerate(REASONS)]
    seen = rows.observe(raw, F.count("*").alias("n_raw"), F.count_if(F.col("reject_reason").isNull()).alias("n_good"), *reasons)
    good = seen.withColumn("__turn", _turn(rows, order)).where("reject_reason IS NULL")
    first = good.groupBy(fingerprint().alias("__key")).agg(F.min_by(F.struct(*keep), F.col("__turn")).alias("s"))
    return first.select("s.*").observe(kept, F.count("*").alias("n_valid")), Counts(raw, kept, REASONS)


def first_wins(rows: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """Of rows with an equal key the first in order. The key is hashed, so long texts are not sorted."""
    w = Window.partitionBy(F.sha2(F.concat_ws("\0", *key), 256)).orderBy(*order)
    return rows.withColumn("__turn", F.row_number().over(w)).where("__turn = 1").drop("__turn")


def has_output_fields(output: Column) -> Column:
    keys = F.json_object_keys(output)
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(x) for x in OUTPUT_FIELDS]), keys)) == 0, F.lit(False))


def label_distribution(samples: DataFrame, label: str = "label") -> DataFrame:
    return samples.groupBy(label).agg(F.count("*").alias("n"))


def distribution_violations(counts: DataFrame, kind: str, label: str = "label", min_total: int = 10, min_each: int = 2, min_kinds: int = 2) -> DataFrame:
    """One row, violation, for each way in which the label counts fall short."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds"), F.array_sort(F.collect_set(label)).alias("labels"))
    missing = F.array_join(F.array_sort(F.array_except(F.array(F.lit("开放"), F.lit("控制")), "labels")), ",")
    few = total.select(F.when(F.col("total") < min_total, F.concat(F.lit("samples: "), F.col("total").cast("string"))).alias("violation"))
    kinds = total.select((F.when(missing != "", F.concat(F.lit("missing labels: "), missing)) if kind == "hk" else F.when(F.col("kinds") < min_kinds, F.concat(F.lit("kinds of labels: "), F.col("kinds").cast("string")))).alias("violation"))
    each = counts.where(F.col("n") < min_each).select(F.concat(F.lit("label "), F.col(label).cast("string"), F.lit(": "), F.col("n").cast("string")).alias("violation"))
    return few.union(kinds).union(each).where("violation IS NOT NULL")


def preparation_counts(rows: DataFrame) -> DataFrame:
    """n_raw, n_valid, n_duplicates of rows with reject_reason and duplicate."""
    valid = F.col("reject_reason").isNull()
    return rows.agg(F.count("*").alias("n_raw"), F.count_if(valid & ~F.col("duplicate")).alias("n_valid"), F.count_if(valid & F.col("duplicate")).alias("n_duplicates"))
