"""Conversations of any number of turns with a predictor, over a table of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written
from .ranks import numbered
from .state import CONVERSATION, chat_prompt

KEEP = 10


def asked(instruction: Column, text: Column) -> Column:
    """What the user says: the instruction, and a text after a blank line if there is one."""
    return F.trim(F.concat_ws("\n\n", instruction, F.when(F.coalesce(text, F.lit("")) != "", text)))


def chat(turns: DataFrame, predict: Callable[[Column], Column], conversation: str = "conv_id", turn: str = "turn", user: str = "user", system: str = "", keep: int = KEEP, **how) -> DataFrame:
    """conversation, turn, user, prompt and assistant for each turn (conversation, turn, user).

    Goes in rounds: the first turns of all conversations are answered in one pass of the predictor over all executors, then
    the second ones, whose prompts hold the first exchange, and so on; the last `keep` exchanges are held. A round's answers
    are written before the next one, so that each turn is asked once; conversations that are over take no part. There are as
    many rounds as the longest conversation has turns. A null user text is an empty one; conversations are told apart by
    value, and null is one of them."""
    spark = turns.sparkSession
    folder = shared_folder(spark)
    given = turns.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.coalesce(user, F.lit("")).alias("u"))
    given = written(numbered(given, ["t", "u"], ["c"], "k", **how), f"{folder}/turns")
    last = given.agg(F.max("k")).first()[0] or 0
    histories, rounds = None, []
    for k in range(1, last + 1):
        now = given.where(F.col("k") == k)
        if histories is None:
            held = now.withColumn("h", F.array().cast(CONVERSATION))
        else:
            held = now.join(histories.select(F.col("c").alias("__c"), "h"), F.col("c").eqNullSafe(F.col("__c"))).drop("__c")
        told = held.withColumn("p", chat_prompt(F.col("h"), F.col("u"), system))
        told = written(told.withColumn("a", predict(F.col("p"))), f"{folder}/round-{k}")
        longer = F.concat("h", F.array(F.struct(F.col("u").alias("user"), F.col("a").alias("assistant"))))
        histories = told.select("c", F.slice(longer, F.greatest(F.size(longer) - keep + 1, F.lit(1)), keep).alias("h"))
        rounds.append(f"{folder}/round-{k}")
    schema = f"c {given.schema['c'].dataType.simpleString()}, t {given.schema['t'].dataType.simpleString()}, u string, p string, a string"
    out = spark.read.schema(schema).parquet(*rounds) if rounds else spark.createDataFrame([], schema)
    return out.select(F.col("c").alias(conversation), F.col("t").alias(turn), F.col("u").alias(user), F.col("p").alias("prompt"), F.col("a").alias("assistant"))
