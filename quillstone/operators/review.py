"""The review chain: prompt, predictor, parsing of its answer, and the rules that bound it.

Order of the stages: post-process, rule engine, keyword decision, missing-content guard, sanitizer. All but the parse
cascade and the predictor are expressions; those two are Arrow functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CONTROL, OPEN, Profile, first_contained, inferred, keyword_list
from ..functions.text import collapse, head_tail, let, one_decimal, strip

RESULT = "struct<result:string,basis:string,confidence:double,thinking:string>"
# Sentences, marks and characters of answers.
NO_REASONING = "模型未输出明确的推理过程"
DEFAULT_REASONING = "已对档案标题及基本信息完成合规性要素审查。"
SANITIZED = "已根据档案题名、正文、关键字及候选规范条款完成综合审核。"
BAD_REASONING = ["<与think内容", "推理摘要", "模型未输出明确", "在此处结合"]
LIMITATION = "未提供档案正文，本次仅依据题名、日期及档案元数据辅助判断，建议人工复核。"
NO_RULES = "未检索到可核验的规范条款，审核依据不足。"
TRADITIONAL, SIMPLIFIED = "該為開權處審發", "该为开权处审发"
SPECIAL_TOKENS = ["<｜end▁of▁sentence｜>", "<|end_of_sentence|>", "<|endoftext|>", "</s>", "<|im_end|>", "<s>", "<pad>", "<unk>"]
CUT = "\n【正文过长，中间部分已省略】\n"
METADATA = {"门类": "archive_category", "机构或问题": "organization_problem", "全宗号": "fonds_no", "文号": "document_no", "责任者": "responsible_org", "原保管期限": "retention_period", "归档年度": "archive_year"}
BODY_CHARS = 4000


def split_thinking(raw: Column) -> tuple[Column, Column]:
    """The reasoning between think marks, white space collapsed, and the rest."""
    parts = F.regexp_extract_all(raw, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1))
    said = F.array_join(F.filter(F.transform(parts, collapse), lambda x: x != ""), " ")
    return said, strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))


def reasoning(raw: Column) -> Column:
    """Up to 1000 characters of reasoning: between think marks, else the answer's field, else what stands before its JSON."""
    said, body = split_thinking(raw)
    named = F.regexp_extract(body, "[\"']?思考过程[\"']?\\s*[:：]\\s*[\"']([^\"'}\\n]{5,})[\"']", 1)
    at = F.locate("{", body)
    before = collapse(F.substr(body, F.lit(1), F.greatest(at - 1, F.lit(0))))
    return F.when(said != "", F.substring(said, 1, 1000)).when(named != "", F.substring(strip(named), 1, 1000)).when((at - 1 > 30) & F.length(before).between(16, 1000), before).otherwise(NO_REASONING)


def sanitized(text: Column) -> Column:
    """Without Latin letters, spaces between Chinese characters and around punctuation; a fixed sentence if no Chinese is left."""
    t = F.regexp_replace(collapse(F.coalesce(text, F.lit(""))), "[A-Za-z]+", "")
    t = F.regexp_replace(t, r"(?<=[\u3400-\u9fff])\s+(?=[\u3400-\u9fff])", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+([，。；：、！？])", "$1"), r"(?U)([，。；：、！？])\s+", "$1")
    t = F.regexp_replace(t, "^[ ，,；;：:]+|[ ，,；;：:]+$", "")
    return F.when(t.rlike(r"[\u3400-\u9fff]"), t).otherwise(SANITIZED)


def cleaned_answer(body: Column) -> Column:
    """Without special tokens, long white space and Latin lines or words outside of JSON; seven characters simplified."""
    for token in SPECIAL_TOKENS:
        body = F.replace(body, F.lit(token), F.lit(""))
    body = F.translate(F.regexp_replace(body, r"(?U)\s{3,}", " "), TRADITIONAL, SIMPLIFIED)

    def latin(line: Column) -> Column:
        plain = strip(line)
        share = F.length(F.regexp_replace(plain, r"[^\x00-\x7f]", "")) / F.length(plain)
        return (plain != "") & ~plain.rlike(r"[\u4e00-\u9fff]") & (share > 0.8) & ~plain.rlike("[{}\\[\\]\"']\\s*[:，,]|[{}\\[\\]]")

    kept = F.filter(F.split(body, "\n"), lambda x: ~latin(x))
    return strip(F.array_join(F.transform(kept, lambda x: F.when(x.contains("{") | x.contains("}"), x).otherwise(F.regexp_replace(x, r"(?U)\b[a-zA-Z]{2,}\b", ""))), "\n"))


class Parser:
    """Finds an answer's fields: fenced JSON, JSON with all or most fields, single fields, labelled text."""

    FIELD = "[\"']?{}[\"']?\\s*[:：]"

    def __init__(self, p: Profile):
        self.labels, self.kind, self.basis = list(p.results), p.kind, p.basis
        gap = "[^{}]*?"
        field = {k: self.FIELD.format(k) for k in ("思考过程", "审核结果", "审核依据", "置信度")}
        chain = lambda *names: re.compile("\\{" + gap + gap.join(field[n] for n in names) + gap + "\\}", re.S)
        self.objects = [
            chain("思考过程", "审核结果", "审核依据", "置信度"),
            chain("审核结果", "审核依据", "置信度", "思考过程"),
            chain("审核结果", "审核依据", "置信度"),
            re.compile(r"\{[^{}]{15,800}?\}", re.S),
        ]
        self.single = [re.compile(field["审核结果"] + "\\s*[\"']?([^\"'}\\n,]{1,20})[\"']?"), re.compile(field["审核依据"] + "\\s*[\"']([^\"'}\\n]{5,200})[\"']"), re.compile(field["置信度"] + "\\s*([0-9]{1,2}(?:\\.[0-9])?)")]
        self.fence, self.mark = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S), re.compile(r"```(?:json)?\s*|\s*```")

    @staticmethod
    def loaded(text: str) -> object:
        repairs = (lambda s: s, lambda s: s.replace("'", '"'), lambda s: s.translate({0xFF1A: ":", 0xFF0C: ","}), lambda s: re.sub(r"(?<=[{,])\s*([^\s'\"{}:,]+)\s*(?=:)", r'"\1"', s))
        for repair in repairs:
            try:
                return json.loads(repair(text))
            except ValueError:
                continue
        return None

    def accepted(self, found: object, thinking: str) -> tuple | None:
        """The four fields, missing ones filled, if the result is a label and the confidence within 0 to 10."""
        if not isinstance(found, dict):
            return None
        result = str(found.get("审核结果", "")).strip()
        if not result or not any(x in result or (self.kind == "jd" and result in x) for x in self.labels):
            return None
        basis = str(found.get("审核依据", ""))
        if len(basis.strip()) < 5:
            basis = self.default_basis(thinking, result)
        try:
            sure = float(found.get("置信度", ""))
        except (TypeError, ValueError):
            sure = 7.5
        said = str(found.get("思考过程") or "")
        return (result, basis, sure, said if len(said) >= 5 else thinking) if 0 <= sure <= 10 else None

    def default_basis(self, thinking: str, result: str) -> str:
        key = thinking[:100].rstrip("，。,.")
        return f"{self.basis}，{key}" if key and key != NO_REASONING else f"{self.basis}，根据档案标题和内容特征，综合判定为【{result}】"

    def candidates(self, body: str, thinking: str) -> Iterator[object]:
        for block in self.fence.findall(body):
            yield self.loaded(block.strip())
        body = self.mark.sub("", body)
        for pattern in self.objects:
            for m in pattern.finditer(body):
                yield self.loaded(m[0])
        result, basis, sure = (p.search(body) for p in self.single)
        if result:
            yield {"审核结果": result[1].strip().strip("\"'"), "审核依据": basis[1].strip() if basis else "", "置信度": float(sure[1]) if sure else 8.0, "思考过程": thinking}
        result = re.search("(?:审核结果[：:]|【审核结果】)\\s*[\"']?([^\\n\\r\"'【]{1,20})[\"']?", body)
        if result:
            basis = re.search(r"(?:审核依据[：:]|【审核依据】)\s*(.*?)(?=\n[^\n]{0,15}[：:]|\n【|\Z)", body, re.S)
            said = " ".join(basis[1].split()).rstrip("。.,;；") if basis else ""
            if not said and (basis := re.search(r"(?:审核依据[：:]|【审核依据】)\s*(.{5,200})", body)):  # what follows, labels included
                said = basis[1].strip()
            sure = re.search(r"置信度[：:]\s*([0-9]{1,2}(?:\.[0-9])?)", body)
            yield {"审核结果": result[1].strip().strip("\"'"), "审核依据": said, "置信度": float(sure[1]) if sure else 7.5, "思考过程": thinking}

    def parse(self, body: str, thinking: str) -> tuple | None:
        return next((x for c in self.candidates(body, thinking) if (x := self.accepted(c, thinking))), None)


def parsed(body: Column, thinking: Column, p: Profile) -> Column:
    """RESULT, null where nothing parses."""
    parser = Parser(p)

    @F.pandas_udf(RESULT)
    def parse(bodies: pd.Series, thoughts: pd.Series) -> pd.DataFrame:
        rows = [parser.parse(b or "", t or "") or (None, None, None, None) for b, t in zip(bodies, thoughts, strict=True)]
        return pd.DataFrame(rows, columns=["result", "basis", "confidence", "thinking"]).astype({"confidence": "float64"})

    return parse(body, thinking)


def result_of(result: Column, basis: Column, confidence: Column, thinking: Column) -> Column:
    return F.struct(result.alias("result"), basis.alias("basis"), confidence.cast("double").alias("confidence"), thinking.alias("thinking"))


def basis_of_thinking(thinking: Column, result: Column, p: Profile) -> Column:
    key = F.regexp_replace(F.substring(thinking, 1, 100), "[，。,.]+$", "")
    named = F.concat(F.lit(f"{p.basis}，根据档案标题和内容特征，综合判定为【"), result, F.lit("】"))
    return F.when((key != "") & (key != NO_REASONING), F.concat(F.lit(p.basis + "，"), key)).otherwise(named)


def postprocessed(found: Column, thinking: Column, p: Profile) -> Column:
    """RESULT with a label as result, the required basis in front, and a confidence of 6 to 10."""
    none, guess = found["result"].isNull(), inferred(thinking, p)
    raw = F.when(none, guess).otherwise(strip(found["result"]))
    if p.kind == "jd":
        label = F.lit(p.default)
        for x in reversed(list(p.results)):
            label = F.when((raw != "") & (raw.contains(x) | F.contains(F.lit(x), raw)), x).otherwise(label)
    else:
        label = F.coalesce(first_contained(raw, p.results), F.lit(p.default))
        if p.strict_negation:
            label = F.when(raw.contains("不开放"), CONTROL).otherwise(label)
    said = F.coalesce(F.when(none, thinking).otherwise(strip(found["thinking"])), F.lit(""))
    bad = lambda t: F.coalesce(first_contained(t, BAD_REASONING).isNotNull(), F.lit(False))
    said = F.when((said == "") | bad(said), F.when((thinking != "") & ~bad(thinking), thinking).otherwise(DEFAULT_REASONING)).otherwise(said)
    basis = F.when(none, basis_of_thinking(thinking, guess, p)).otherwise(found["basis"])
    basis = F.regexp_replace(strip(F.coalesce(basis, F.lit(""))), "[。.,;；]+$", "")
    full = F.when(F.length(basis) >= 5, F.concat(F.lit(p.basis + "，"), basis)).otherwise(F.concat(F.lit(p.basis + "，根据档案内容综合判定为【"), label, F.lit("】")))
    basis = F.when((F.length(basis) < 10) | ~basis.contains(p.basis), full).otherwise(basis)
    sure = one_decimal(F.greatest(F.lit(6.0), F.least(F.lit(10.0), F.when(none, 7.0).otherwise(F.coalesce(found["confidence"], F.lit(8.0))))))
    return result_of(label, basis, sure, sanitized(said))


def bounded_by_rules(result: Column, rules: Column, p: Profile) -> Column:
    """RESULT bound by retrieved rules: array<struct<rank, rule_id, source, text, score>>; null or empty: none retrieved."""
    some, value = F.coalesce(F.size(rules) > 0, F.lit(False)), F.coalesce(strip(result["result"]), F.lit(""))
    if p.kind == "hk":
        label = F.when(value.contains("控制") | value.contains("不开放"), CONTROL).when((value == "开放") | value.contains("应开放"), OPEN).otherwise(CONTROL)
    else:
        text = F.array_join(F.transform(rules, lambda r: r["text"]), "\n")
        allowed = F.array(*[F.lit(x) for x in p.rule_results])
        hits = F.filter(allowed, lambda x: text.contains(x))
        allowed = F.when(some & (F.size(hits) > 0), hits).otherwise(allowed)
        label = F.when(F.array_contains(allowed, value), value).otherwise("")
    first = F.get(rules, 0)
    basis = strip(F.coalesce(result["basis"], F.lit("")))
    excerpt = F.substring(collapse(first["text"]), 1, 180)
    cited = F.concat(F.lit("依据"), first["source"], F.lit("（检索条款编号："), first["rule_id"], F.lit("），"), F.when(basis == "", excerpt).otherwise(basis))
    with_rules = F.when(basis.contains(first["source"]) & basis.contains(first["rule_id"]), basis).otherwise(cited)
    basis = F.when(some, with_rules).when(basis == "", NO_RULES).otherwise(basis)
    sure = F.coalesce(result["confidence"], F.lit(0.0))
    sure = one_decimal(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.when(some, sure).otherwise(F.least(sure, F.lit(5.0))))))
    return result_of(label, basis, sure, strip(F.coalesce(result["thinking"], F.lit(""))))


def _joined(sign: Column, text: Column, between: str, after: bool) -> Column:
    both = F.concat(text, F.lit(between), sign) if after else F.concat(sign, F.lit(between), text)
    return F.when(text.contains(sign), text).when(text == "", sign).otherwise(both)


def decided_by_keywords(result: Column, keywords: Column, said: Column) -> Column:
    """RESULT with the keyword rules' result where keywords were met."""
    words = keyword_list(keywords)
    sign = F.concat(F.lit("命中关键字【"), F.array_join(words, "、"), F.lit("】，关键字预审结果为【"), said, F.lit("】"))
    basis, thinking = (strip(F.coalesce(result[x], F.lit(""))) for x in ("basis", "thinking"))
    forced = result_of(said, _joined(sign, basis, "；", False), result["confidence"], _joined(sign, thinking, "。", False))
    return F.when(F.size(words) > 0, forced).otherwise(result)


def guarded(result: Column, content: Column, keywords: Column) -> Column:
    """RESULT with a confidence of 6 at most, and a note, where there is neither content nor keywords."""
    bare = (F.coalesce(strip(content), F.lit("")) == "") & (F.coalesce(F.size(keywords), F.lit(0)) <= 0)
    basis, thinking = (strip(F.coalesce(result[x], F.lit(""))) for x in ("basis", "thinking"))
    sure = one_decimal(F.greatest(F.lit(0.0), F.least(F.lit(6.0), F.coalesce(result["confidence"], F.lit(0.0)))))
    note = F.lit(LIMITATION)
    weak = result_of(result["result"], _joined(note, basis, "；", True), sure, _joined(note, thinking, " ", True))
    return F.when(bare, weak).otherwise(result)


def keyword_block() -> Column:
    """What the keyword rules have decided, of the columns keywords and audit_result."""
    words = keyword_list(F.col("keywords"))
    said = F.col("audit_result")
    met = F.concat(
        F.lit("【关键字规则预审】命中关键字："), F.array_join(words, "、"), F.lit("\n关键字预审结果："), said,
        F.lit("\n审核结果已经由关键字规则确定为【"), said, F.lit("】，不得改成其他结果。请结合命中关键字、档案正文和候选规范条款，生成审核依据、思考过程和置信度，并在JSON的审核结果字段中原样返回该结论。\n"),
    )
    return F.when(F.size(words) > 0, met).otherwise("【关键字规则预审】未提供或未命中关键字，请结合档案内容和候选规范条款独立判断开放或控制。\n")


def prompt(p: Profile, system: str = "") -> Column:
    """The model's question from the canonical columns title, date_time, content, METADATA and rules; for hk also keywords
    and audit_result."""
    lines = [F.when(F.coalesce(strip(F.col(c)), F.lit("")) != "", F.concat(F.lit(label + "："), strip(F.col(c)))) for label, c in METADATA.items()]
    metadata = F.concat_ws("\n", *lines)
    metadata = F.when(metadata == "", "（未提供其他档案元数据）").otherwise(metadata)
    content = head_tail(strip(F.coalesce(F.col("content"), F.lit(""))), BODY_CHARS, CUT)
    content = F.when(content == "", "（未提供档案正文）").otherwise(content)
    rules = F.array_join(F.transform("rules", lambda r: F.concat(F.lit("["), r["rule_id"], F.lit("] 来源："), r["source"], F.lit("\n"), r["text"])), "\n\n")
    rules = F.when(F.coalesce(rules, F.lit("")) == "", "（未检索到候选规范条款）").otherwise(rules)
    head = F.concat(F.lit("题名为："), F.coalesce("title", F.lit("无题名")), F.lit(", 日期为："), F.substring(F.coalesce("date_time", F.lit("")), 1, 10))
    block = [keyword_block()] if p.kind == "hk" else []
    question = F.concat_ws("\n", F.lit(system), F.lit("可选结果：" + "、".join(p.results)), *block, head, F.lit("【档案元数据】"), metadata, F.lit("【档案正文】"), content, F.lit("【RAG检索到的候选规范条款】"), rules, F.lit("输出："))
    return question


Predictor = Callable[[pd.Series], pd.Series]


def keyword_predictor(p: Profile) -> Callable[[Column], Column]:
    """A deterministic predictor: the result that the words of the text speak for, as JSON. All built-in functions."""

    def predict(text: Column) -> Column:
        said = let(text, lambda t: inferred(t, p))  # the text is made once for all words
        fields = F.struct(said.alias("审核结果"), F.lit(p.basis + "，按正文用词判断").alias("审核依据"), F.lit(8.0).alias("置信度"), F.lit("按正文用词出现次数比较得出结论").alias("思考过程"))
        return F.to_json(fields)

    return predict


def model_predictor(load: Callable[[], Predictor]) -> Callable[[Column], Column]:
    """A predictor from a model that is loaded once in each worker and called in batches."""

    @F.pandas_udf("string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield model(b)

    return predict


def review(items: DataFrame, p: Profile, predict: Callable[[Column], Column], question: Column) -> DataFrame:
    """Adds answer and result to items with content, rules, keywords (array) and audit_result."""
    answered = items.withColumn("answer", predict(question))
    thinking = sanitized(reasoning(F.col("answer")))
    _, body = split_thinking(F.col("answer"))
    out = answered.withColumn("__thinking", thinking).withColumn("__body", cleaned_answer(body))
    out = out.withColumn("result", parsed(F.col("__body"), F.col("__thinking"), p))
    out = out.withColumn("result", postprocessed(F.col("result"), F.col("__thinking"), p))
    out = out.withColumn("result", bounded_by_rules(F.col("result"), F.col("rules"), p))
    if p.kind == "hk":
        out = out.withColumn("result", decided_by_keywords(F.col("result"), F.col("keywords"), F.col("audit_result")))
    out = out.withColumn("result", guarded(F.col("result"), F.col("content"), F.col("keywords")))
    return out.withColumn("result", F.col("result").withField("thinking", sanitized(F.col("result.thinking")))).drop("__thinking", "__body")


def response_rows(reviewed: DataFrame, key: str = "arid") -> DataFrame:
    r = F.col("result")
    return reviewed.select(F.col(key).alias("arid"), r["result"].alias("jg"), r["basis"].alias("yj"), r["confidence"].alias("zxd"), r["thinking"].alias("thinking"))
