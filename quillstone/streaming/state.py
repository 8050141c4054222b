"""Streams of progress events, queued requests and callbacks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.text import percentage


def progress(events: DataFrame, run: str = "run_id", value: str = "percentage") -> DataFrame:
    """The largest percentage of each run so far; a reset is a new run. Write it in update or complete mode."""
    return events.groupBy(run).agg(F.max(percentage(F.col(value))).alias("percentage"), F.count("*").alias("n_events"))


def admitted(requests: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Requests, each key once within the watermark: a task in flight is not queued again."""
    return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def activity(events: DataFrame, time: str, size: str, delay: str, *keys: str) -> DataFrame:
    """Events by window and keys; windows close as the watermark passes them."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n_events"))


def outbox(pending: DataFrame, folder: str, checkpoint: str, send: Callable[[DataFrame], DataFrame], key: str = "model_id", attempts: int = 3, delay: float = 0.0, every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Sends batches of callbacks, and with each batch those of earlier ones that failed, unless their key has a newer one.
    Each batch's outcome (the rows, batch_id, sent, attempts) stands in folder/outcomes by itself, which a repeated batch
    overwrites; the last outcome has all that is not sent.

    send: adds sent (boolean) to the rows; it runs on the executors. What fails is sent again up to `attempts` times, after
    delay, twice the delay and so on."""

    def deliver(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = batch.withColumn("batch_id", F.lit(number).cast("long"))
        if number:
            older = spark.read.schema(T.StructType([*waiting.schema.fields, T.StructField("sent", T.BooleanType()), T.StructField("attempts", T.IntegerType())])).parquet(f"{folder}/outcomes/batch={number - 1}")
            older = older.where("NOT sent").drop("sent", "attempts")
            waiting = waiting.unionByName(older.join(batch.select(key), key, "left_anti"))
        done = None
        for turn in range(attempts):
            if turn and delay:
                time.sleep(delay * 2 ** (turn - 1))
            path = f"{folder}/tries/{number}-{turn}"
            send(waiting).withColumn("attempts", F.lit(turn + 1)).write.mode("overwrite").parquet(path)
            tried = spark.read.parquet(path)
            last = turn == attempts - 1 or tried.where("NOT sent").isEmpty()
            good = tried if last else tried.where("sent")
            done = good if done is None else done.unionByName(good)
            waiting = tried.where("NOT sent").drop("sent", "attempts")
            if last:
                break
        done.write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")

    writer = pending.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def conversations(turns: DataFrame, conversation: str = "conv_id", keep: int = 10) -> DataFrame:
    """conversation and history of a stream of exchanges (conversation, turn, user, assistant): the last `keep` ones by turn,
    held as state. Write it in update mode."""
    kind = turns.schema[conversation].dataType.simpleString()
    entry = "turn long, user string, assistant string"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(zip(*held.get, strict=True)) if held.exists else []
        for b in batches:  # no more than `keep` rows are held beside those of one piece
            rows += list(zip(b["turn"].tolist(), b["user"].tolist(), b["assistant"].tolist(), strict=True))
            rows = sorted(dict((r[0], r) for r in rows).values())[-keep:]
        held.update(tuple(list(x) for x in zip(*rows, strict=True)))
        yield pd.DataFrame({conversation: [key[0]], "history": [[{"turn": t, "user": u, "assistant": a} for t, u, a in rows]]})

    given = turns.select(conversation, F.col("turn").cast("long").alias("turn"), "user", "assistant")
    return given.groupBy(conversation).applyInPandasWithState(follow, f"{conversation} {kind}, history array<struct<{', '.join(x.replace(' ', ':') for x in entry.split(', '))}>>", "turns array<long>, users array<string>, assistants array<string>", "update", "NoTimeout")
