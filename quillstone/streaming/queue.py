"""Queues of tasks and keys that go idle, as keyed state of a stream with event-time timers.

Both need Spark's RocksDB state store (`rocksdb_state`), whose changes are kept in the query's checkpoint, so that a lost
executor's state is loaded by another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ranks import numbered

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVES, ENDS = "arrive", "end"
QUEUED, DUPLICATE, DONE, UNKNOWN = "queued", "duplicate", "done", "unknown"


#: Groups that keys are dealt into by hash. A group is one entry of the state, as each call to the state store costs
#: milliseconds, however small the entry is.
GROUPS = 1024


def group_of(key: str) -> Column:
    """The group of a key; null keys are a group of their own."""
    return F.coalesce(F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")), F.lit(-1))


def rocksdb_state(spark: SparkSession) -> None:
    """Lets streams that start from now on hold their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class TaskQueue(StatefulProcessor):
    """The waiting tasks in line of each queue of a group; a task is admitted once to a queue until it ends."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getValueState("lines", f"queues array<{self.kind}>, tasks array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines: dict = {}
        for queue, task in zip(*(self.lines.get() or ((), ())), strict=True):
            lines.setdefault(queue, {})[task] = None
        batch = pd.concat(list(rows))
        order = np.lexsort((batch["seq"].to_numpy(), batch["at"].to_numpy()))  # missing times last
        seqs, tasks, kinds = (batch[x].to_numpy()[order].tolist() for x in ("seq", "task", "kind"))
        queues = [None] * len(seqs) if key[0] < 0 else batch["queue"].to_numpy()[order].tolist()
        outcomes, places, waiting = [], [], []
        for queue, task, kind in zip(queues, tasks, kinds, strict=True):
            line, place = lines.setdefault(queue, {}), None
            if kind == ARRIVES:
                outcome = DUPLICATE if task in line else QUEUED
                if outcome == QUEUED:
                    line[task] = None
                    place = len(line)
            elif task in line:
                del line[task]
                outcome = DONE
            else:
                outcome = UNKNOWN
            outcomes.append(outcome)
            places.append(place)
            waiting.append(len(line))
        left = [(queue, task) for queue, line in lines.items() for task in line]
        self.lines.update(tuple(list(x) for x in zip(*left, strict=True)) or ([], []))
        yield pd.DataFrame({"queue": pd.Series(queues, dtype=object), "seq": seqs, "task": tasks, "outcome": outcomes, "position": pd.array(places, dtype="Int64"), "waiting": waiting})


def queued(events: DataFrame, queue: str, task: str, kind: str, at: str, seq: str) -> DataFrame:
    """queue, seq, task, outcome, position, waiting for each event of a stream of arrivals and ends of tasks.

    An arrival is queued, at the position after all that wait, unless its task waits already: then it is a duplicate. An end
    takes the task out, wherever in line it is; of a task that does not wait it is unknown. waiting: the tasks in line after
    the event. The events of a queue go in order of (at, seq) within a batch, batches in order. The lines of a group of
    queues are held by one task; groups are dealt over all."""
    given = events.select(F.col(queue).alias("queue"), F.col(task).cast("string").alias("task"), F.col(kind).alias("kind"), F.col(at).alias("at"), F.col(seq).cast("long").alias("seq"))
    of = given.schema["queue"].dataType.simpleString()
    schema = f"queue {of}, seq long, task string, outcome string, position long, waiting long"
    return given.where(F.col("kind").isin(ARRIVES, ENDS) & F.col("task").isNotNull()).withColumn("group", group_of("queue")).groupBy("group").transformWithStateInPandas(TaskQueue(of), schema, "Append", "None")


def standing(outcomes: DataFrame, **how) -> DataFrame:
    """queue, task, seq (of its arrival) and position of the tasks that wait after all outcomes (rows of `queued`, whose seq rises
    with time): those whose last event is no end. Positions close up as tasks before them end."""
    last = outcomes.groupBy("queue", "task").agg(F.max_by("outcome", "seq").alias("last"), F.max(F.when(F.col("outcome") == QUEUED, F.col("seq"))).alias("seq"))
    waiting = last.where(F.col("last").isin(QUEUED, DUPLICATE)).select("queue", "task", "seq")
    return numbered(waiting, ["seq"], ["queue"], "position", **how)


class IdleSessions(StatefulProcessor):
    """The open sessions of a group of keys in order: (key, first, last, n), micros, with one timer for all of them, at the end of
    the first to end. A timer that fires tells all sessions that have ended by the watermark, however many they are."""

    def __init__(self, idle_ms: int, kind: str):
        self.idle_ms, self.kind = idle_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"key array<{self.kind}>, first array<long>, last array<long>, n array<long>")

    def expiry(self, session: tuple) -> int:
        return session[2] // 1000 + self.idle_ms

    def held(self) -> list[tuple]:
        found = self.open.get()
        return list(zip(*found, strict=True)) if found else []

    def hold(self, sessions: list[tuple]) -> None:
        self.open.update(tuple(list(x) for x in zip(*sessions, strict=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.held()
        parts = list(before)
        for batch in rows:
            parts += [(k, x, x, 1) for k, x in zip(batch["key"].tolist(), batch["micros"].tolist(), strict=True)]
        now: list[tuple] = []
        for own, first, last, n in sorted(parts):
            if now and own == now[-1][0] and first // 1000 <= self.expiry(now[-1]):
                now[-1] = (own, now[-1][1], max(now[-1][2], last), now[-1][3] + n)
            else:
                now.append((own, first, last, n))
        old, new = (min(map(self.expiry, x), default=None) for x in (before, now))
        if old != new:
            if before:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        self.hold(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, sessions = timerValues.getCurrentWatermarkInMs(), self.held()
        left = [x for x in sessions if self.expiry(x) > until]
        if left:
            self.hold(left)
            self.handle.registerTimer(min(map(self.expiry, left)))
        else:
            self.open.clear()
        told = [x for x in sessions if self.expiry(x) <= until]
        if told:
            keys, first, last, n = zip(*told, strict=True)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "first_us": first, "last_us": last, "n_events": n})


def idle_sessions(events: DataFrame, key: str, time: str, idle_ms: int, delay: str) -> DataFrame:
    """key, first_us, last_us and n_events of each session of a key that has ended: no event came for `idle_ms` milliseconds after
    its last one, by the watermark, which is `delay` behind the newest event. A session that is told is gone from the state,
    and so is a key without others; the keys of a group are held together. Later events than the watermark allows are left out; null keys and times too."""
    given = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", delay)
    given = given.select(F.col(key).alias("key"), "__time", F.unix_micros("__time").alias("micros"))
    of = given.schema["key"].dataType.simpleString()
    schema = f"key {of}, first_us long, last_us long, n_events long"
    return given.withColumn("group", group_of("key")).groupBy("group").transformWithStateInPandas(IdleSessions(idle_ms, of), schema, "Append", "EventTime")
