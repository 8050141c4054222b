"""Label vocabularies as one table of parameters, and the expressions that use them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, vote

# Labels, code sets and word lists that results depend on.
OPEN, CONTROL = "开放", "控制"
OPEN_CODES = ["kf", "开放", "open", "OPEN", "1", "true", "True"]
CONTROL_CODES = ["kz", "控制", "不开放", "control", "CONTROL", "0", "false", "False"]
PERIODS = ["永久", "60年", "30年", "15年", "10年"]
RULE_PERIODS = ["永久", "30年", "10年", "长期", "短期", "15年", "60年"]
REVIEW_PERIODS = ["10年", "15年", "30年", "60年", "永久"]
CONTROL_WORDS = ["控制", "延期", "敏感", "涉密", "秘密", "机密", "内部", "人事", "工资", "个人信息", "隐私", "不宜公开", "限制"]
OPEN_WORDS = ["开放", "公开", "通知", "公告", "总结", "报告", "批复", "规划", "符合开放", "可以公开", "无涉密"]
PERIOD_WORDS = {
    "永久": ["永久", "重要政策", "重大规划", "历史意义", "永久保存"],
    "60年": ["60年", "人事档案", "土地", "产权", "不动产"],
    "30年": ["30年", "一般行政", "常规", "普通文件", "行政管理"],
    "15年": ["15年", "临时工作", "阶段性", "短期项目"],
    "10年": ["10年", "日常事务", "一般事务", "例行"],
}
EVIDENCE_WORDS = ["绝密", "机密", "秘密", "保密", "解密", "身份证", "住址", "电话", "工资", "待遇", "任免", "处分", "考察", "干部", "案件", "立案", "判刑", "产权", "股权", "房产", "补偿", "信访", "举报", "投诉"]
PERIOD_EVIDENCE_WORDS = ["永久", "定期", "保管期限", "重大", "重要", "决策", "历史研究", "凭证", "权益", "资产", "合同", "会议记录", "年度总结"]
RISK_WORDS = {
    "涉密信息": ["绝密", "机密", "秘密", "保密期限", "解密"],
    "个人信息": ["身份证", "住址", "电话", "工资", "待遇", "个人简历"],
    "人事信息": ["任免", "处分", "考察", "干部", "职工登记"],
    "案件信息": ["立案", "审理", "判刑", "枪决", "犯罪", "案件"],
    "权益信息": ["产权", "债权", "股权", "宅基地", "房产", "补偿标准"],
    "信访信息": ["信访", "来信", "举报", "投诉"],
}


@dataclass(frozen=True)
class Profile:
    """What a kind of review allows. kind: hk (open or restricted) or jd (retention period)."""

    kind: str
    source: str
    basis: str
    results: Sequence[str]
    rule_results: Sequence[str]
    default: str
    control_words: Sequence[str] = field(default_factory=lambda: CONTROL_WORDS)
    open_words: Sequence[str] = field(default_factory=lambda: OPEN_WORDS)
    period_words: Mapping[str, Sequence[str]] = field(default_factory=lambda: PERIOD_WORDS)
    #: 不开放 counts as restricted before any test for 开放.
    strict_negation: bool = True


PROFILES = {
    "hk": Profile("hk", "《延期开放档案标准及范围》", "依据《延期开放档案标准及范围》", [OPEN, CONTROL], [OPEN, CONTROL], OPEN),
    "jd": Profile("jd", "档案归档范围和保管期限规范", "依据档案保管规范", REVIEW_PERIODS, RULE_PERIODS, "30年"),
}


def profile(kind: str) -> Profile:
    if kind not in PROFILES:
        raise ValueError(f"unknown kind of review: {kind}")
    return PROFILES[kind]


def open_label(value: Column) -> Column:
    """开放 or 控制 of a code or text, null if neither."""
    text = strip(F.coalesce(value, F.lit("")))
    return F.when(text.isin(OPEN_CODES), OPEN).when(text.isin(CONTROL_CODES), CONTROL).when(text.contains("开放") & ~text.contains("不开放"), OPEN)


def first_contained(text: Column, labels: Sequence[str]) -> Column:
    """The first of the labels, in their order, that the text contains; else null."""
    return F.coalesce(*[F.when(text.contains(x), F.lit(x)) for x in labels])


def period_label(value: Column) -> Column:
    return first_contained(strip(F.coalesce(value, F.lit(""))), PERIODS)


def inferred(thinking: Column, p: Profile) -> Column:
    """The result that a reasoning text speaks for; the default for an empty one."""
    if p.kind == "hk":
        said = F.when(vote(thinking, p.control_words) > vote(thinking, p.open_words), CONTROL).otherwise(OPEN)
    else:
        said = F.lit(p.default)
        for label, words in reversed(list(p.period_words.items())):
            any_word = F.lit(False)
            for w in words:
                any_word = any_word | thinking.contains(w)
            said = F.when(any_word, label).otherwise(said)
    return F.when(F.coalesce(thinking, F.lit("")) == "", F.lit(p.default)).otherwise(said)


def keyword_list(words: Column) -> Column:
    """Trimmed, without empty ones, first-seen order, each once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), strip), lambda x: x != ""))


def keyword_contract(kind: Column, words: Column, result: Column) -> Column:
    """Why a keyword signal breaks its contract; null if it holds. Words and a result come together, for hk only."""
    some, said = F.size(keyword_list(words)) > 0, F.coalesce(result, F.lit("")) != ""
    return F.when(kind != "hk", F.lit(None)).when(some & ~said, "keywords without a result").when(~some & said, "a result without keywords").when(said & ~result.isin(OPEN, CONTROL), "unknown result")


def risk_elements(text: Column, categories: Mapping[str, Sequence[str]] = RISK_WORDS, before: int = 60, after: int = 100) -> Column:
    """array<struct<category, words, evidence>> of the categories whose words occur: the words joined by 、, and the text
    around the first occurrence of the first listed word."""
    kind = "struct<category:string,words:string,evidence:string>"
    found = []
    for name, words in categories.items():
        matched = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))
        first = F.get(matched, 0)
        at = F.position(first, text)
        start = F.greatest(at - 1 - before, F.lit(0))
        end = F.least(F.length(text), at - 1 + F.length(first) + after)
        excerpt = F.translate(F.substr(text, start + 1, end - start), "\n", " ")
        found.append(F.when(F.size(matched) > 0, F.struct(F.lit(name).alias("category"), F.array_join(matched, "、").alias("words"), excerpt.alias("evidence"))).cast(kind))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


