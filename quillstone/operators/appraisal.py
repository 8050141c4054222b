"""Appraisal of records in two turns of a conversation with a predictor, record by record over a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import CONVERSATION, chat_prompt

#: Fields of the answer, as the second question asks for them.
FIELDS = ("审核结果", "审核依据", "置信度")


def first_question(title: Column, formed: Column, today: Column) -> Column:
    """Asks how the record will be appraised."""
    return F.concat(F.lit("请说明如何鉴定下面的档案，以及将参考的制度条款。\n档案题名："), title, F.lit("\n档案形成日期："), formed, F.lit("\n当前参考日期："), today)


def second_question() -> Column:
    """Asks for the verdict as JSON: expired if the year now less the record's is at least its period."""
    return F.lit("请完成鉴定：当前年份减去档案形成年份大于等于规定的保管期限即为过期。只输出JSON，字段为" + "、".join(FIELDS) + "。")


def answer_object(answer: Column) -> Column:
    """What stands from the first brace to the last one, as a struct of FIELDS; null if that is no JSON object."""
    text = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.when(F.json_object_keys(text).isNotNull(), F.from_json(text, ", ".join(f"`{x}` string" for x in FIELDS)))


def appraised(records: DataFrame, predict: Callable[[Column], Column], title: str = "title", formed: str = "date_time", today: str = "date_now") -> DataFrame:
    """Adds first_answer, second_answer, and verdict: the second answer's object, null if it has none (the answer then stands
    for itself). The second question is asked with the first exchange as history; each record is a conversation of its own."""
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    asked = records.withColumn("__first", first_question(value(title), value(formed), value(today)))
    none = F.array().cast(CONVERSATION)
    asked = asked.withColumn("first_answer", predict(chat_prompt(none, F.col("__first"))))
    history = F.array(F.struct(F.col("__first").alias("user"), F.col("first_answer").alias("assistant")))
    told = asked.withColumn("second_answer", predict(chat_prompt(history, second_question())))
    return told.withColumn("verdict", answer_object(F.col("second_answer"))).drop("__first")
