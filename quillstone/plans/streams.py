"""Queries whose state is a stream's: queues and idle keys, over the events as a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..streaming import queue
from .queries import c, query, table

IDLE_MS = 6 * 3_600_000


def streamed(spark: SparkSession, sf_dir: str, name: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over a table's files has written when it has read them all."""
    folder = shared_folder(spark)
    queue.rocksdb_state(spark)
    schema = table(spark, sf_dir, name).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}*.parquet")
    out = plan(source)
    writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


OUTCOMES = """WITH e AS (SELECT event_id, ts, user_id, 't' || (json_extract_string(props, '$.k')::BIGINT % 5) AS task, CASE WHEN event_type IN ('purchase', 'error') THEN 'end' ELSE 'arrive' END AS kind FROM events),
p AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY user_id, task ORDER BY ts, event_id), 'end') AS before FROM e),
o AS (SELECT *, CASE WHEN kind = 'arrive' AND before = 'arrive' THEN 'duplicate' WHEN kind = 'arrive' THEN 'queued' WHEN before = 'arrive' THEN 'done' ELSE 'unknown' END AS outcome FROM p)"""


@query(f"""{OUTCOMES},
w AS (SELECT *, sum(CASE outcome WHEN 'queued' THEN 1 WHEN 'done' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS waiting FROM o)
SELECT user_id AS queue, event_id AS seq, task, outcome, CASE WHEN outcome = 'queued' THEN waiting END AS position, waiting FROM w""")
def task_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user has a queue of tasks; purchases and errors end a task, other events ask for it."""
    task = F.concat(F.lit("t"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string"))
    kind = F.when(c("event_type").isin("purchase", "error"), queue.ENDS).otherwise(queue.ARRIVES)
    return streamed(spark, sf_dir, "events", lambda e: queue.queued(e.withColumns({"task": task, "kind": kind}), "user_id", "task", "kind", "ts", "event_id"))


@query(f"""{OUTCOMES},
l AS (SELECT user_id, task, arg_max(outcome, event_id) AS last, max(event_id) FILTER (outcome = 'queued') AS seq FROM o GROUP BY 1, 2)
SELECT user_id AS queue, task, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS position FROM l WHERE last IN ('queued', 'duplicate')""")
def queue_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who waits in each queue at the end, and at which position."""
    return queue.standing(task_queue(spark, sf_dir))


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events),
f AS (SELECT *, CASE WHEN us // 1000 <= lag(us) OVER (PARTITION BY user_id ORDER BY us) // 1000 + {IDLE_MS} THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id AS key, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events FROM g GROUP BY user_id, island
HAVING max(us) // 1000 + {IDLE_MS} <= (SELECT max(us) // 1000 FROM e) - 86400000""")
def idle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without an event for six hours are told with their session and leave the state; the watermark is a day behind."""
    return streamed(spark, sf_dir, "events", lambda e: queue.idle_sessions(e, "user_id", "ts", IDLE_MS, "1 day"))
