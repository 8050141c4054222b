"""Registry, queue, progress, conversations and callbacks as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff, percentage
from .ranks import numbered, overlapping, running_max


def registry_lookup(requests: DataFrame, registry: DataFrame, key: str = "model_id") -> DataFrame:
    """Requests with their registry rows, null where there is none, and miss: whether the key is unknown."""
    return requests.join(registry.withColumn("__hit", F.lit(True)), key, "left").withColumn("miss", F.col("__hit").isNull()).drop("__hit")


def registry_by_type(registry: DataFrame, kind: str | None, column: str = "model_type") -> DataFrame:
    """Rows of the type; a null type matches null only."""
    return registry.where(F.col(column).eqNullSafe(F.lit(kind)))


def upserted(registry: DataFrame, new: DataFrame, key: str = "model_id") -> DataFrame:
    """The registry with new rows in place of those with their keys. Write it to a new place, then swap."""
    return registry.join(new.select(key), key, "left_anti").unionByName(new)


def deleted(registry: DataFrame, ids: DataFrame, key: str = "model_id") -> DataFrame:
    return registry.join(ids.select(key), key, "left_anti")


def lineage(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """For requests (model_id, base_model_id) the model to start from: own (trained before), base (its base was trained), new."""
    own = registry.select("model_id", F.col("model_path").alias("own_path"))
    base = registry.select(F.col("model_id").alias("base_model_id"), F.col("model_path").alias("base_path"))
    both = requests.join(own, "model_id", "left").join(base, "base_model_id", "left")
    mode = F.when(F.col("own_path").isNotNull(), "own").when(F.col("base_path").isNotNull(), "base").otherwise("new")
    return both.withColumn("mode", mode).withColumn("start_path", F.coalesce("own_path", "base_path"))


def admitted(requests: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Requests whose task is not active."""
    return requests.join(active.select(key), key, "left_anti")


def queue_positions(waiting: DataFrame, order: list[str], group: list[str]) -> DataFrame:
    """Adds position, from 1 in each queue; the first column of the order is a number or a time."""
    return numbered(waiting, order, group, "position")


def running_progress(events: DataFrame, run: str, order: list[str], value: Column, **how) -> DataFrame:
    """Adds percentage: the largest so far of the run, kept in 0 to 100; late lower values change nothing."""
    return running_max(events, percentage(value), order, [run], "percentage", **how)


def latest_progress(events: DataFrame, run: str, value: Column) -> DataFrame:
    return events.groupBy(run).agg(F.max(percentage(value)).alias("percentage"))


def pending_callbacks(outbox: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest entry of each key that is not sent."""
    last = outbox.groupBy(key).agg(F.max_by(F.struct(*[c for c in outbox.columns if c != key]), F.struct(*order)).alias("e")).select(key, "e.*")
    return last.where(~F.col("sent"))


def attempted(outbox: DataFrame, outcome: DataFrame, key: str, now: Column, delay: float = 2.0, most: int = 3) -> DataFrame:
    """The outbox (key, attempts, sent, next_at in seconds, last_error) after a round: outcome holds key, status, code and error
    of the entries that were tried. A failed one waits twice as long after each attempt, and after `most` attempts until it
    is sent again as a whole (`renewed`)."""
    both = outbox.join(outcome.withColumn("__tried", F.lit(True)), key, "left")
    tried, good = F.coalesce("__tried", F.lit(False)), F.coalesce(accepted_reply(F.col("status"), F.coalesce("code", F.lit(0))), F.lit(False))
    n = F.col("attempts") + tried.cast("int")
    wait = F.when(n < most, now + backoff(F.lit(delay), n))
    text = F.when(good, F.lit(None)).otherwise(F.coalesce("error", F.concat_ws(" ", F.lit("status"), F.col("status").cast("string"), F.lit("code"), F.col("code").cast("string"))))
    columns = {"attempts": n, "sent": F.col("sent") | (tried & good), "next_at": F.when(tried & ~good, wait).when(~tried, F.col("next_at")), "last_error": F.when(tried, text).otherwise(F.col("last_error"))}
    return both.select(*[columns.get(c, F.col(c)).alias(c) for c in outbox.columns])


def due(outbox: DataFrame, now: Column) -> DataFrame:
    """Entries that are not sent and whose time has come."""
    return outbox.where(~F.col("sent") & (F.col("next_at") <= now))


def renewed(outbox: DataFrame, now: Column) -> DataFrame:
    """The outbox in which entries that have used up their attempts begin anew."""
    over = ~F.col("sent") & F.col("next_at").isNull()
    return outbox.withColumns({"attempts": F.when(over, 0).otherwise(F.col("attempts")), "next_at": F.when(over, now).otherwise(F.col("next_at"))})


def review_callbacks(responses: DataFrame, request: str = "ai_audit_id", order: str = "number") -> DataFrame:
    """request and payload: the JSON with all response rows of a request, in order of its items."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, "arid", "jg", "yj", "zxd", "thinking"))), lambda r: r.dropFields(order))
    return responses.groupBy(request).agg(rows.alias("data")).select(request, F.to_json(F.struct(F.col(request).alias("aiAuditId"), "data")).alias("payload"))


def without_expired(rows: DataFrame, changed: str, now: Column, seconds: int) -> DataFrame:
    """Rows that changed within the last seconds; the others are cleaned up."""
    return rows.where(F.col(changed) > now - seconds)


def seconds_per_record(tasks: DataFrame, group: list[str], seconds: str, records: str) -> DataFrame:
    """Mean seconds for a record over all tasks of a group; null without records."""
    n = F.sum(records)
    return tasks.groupBy(*group).agg(F.when(n > 0, F.sum(seconds) / n).alias("seconds_per_record"))


def registry_counts(registry: DataFrame, column: str = "model_type") -> DataFrame:
    return registry.groupBy(column).agg(F.count("*").alias("n_models"))


CONVERSATION = "array<struct<user:string,assistant:string>>"


def saved_conversations(pairs: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conversation and history: JSON of a conversation's answered exchanges in order."""
    done = pairs.where("assistant IS NOT NULL").groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct(turn, "user", "assistant"))).alias("h"))
    return done.select(conversation, F.to_json(F.transform("h", lambda x: x.dropFields(turn))).alias("history"))


def loaded_conversations(saved: DataFrame, conversation: str = "conv_id", history: str = "history") -> DataFrame:
    """conversation, place (from 0), user and assistant of saved histories; what is no such JSON has no rows."""
    return saved.select(conversation, F.posexplode(F.from_json(history, CONVERSATION)).alias("place", "x")).select(conversation, "place", "x.*")


def accepted_reply(status: Column, code: Column) -> Column:
    """A reply counts if its HTTP status is 2xx and its own code 0 or 200."""
    return status.between(200, 299) & code.isin(0, 200)


def exchanges(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **how) -> DataFrame:
    """conversation, turn, user, assistant: user messages with the assistant's message that comes next, if one does."""
    told = overlapping(messages.where(F.col(role).isin("user", "assistant")), [turn], [conversation], 0, 1, **how)
    w = Window.partitionBy(conversation, "__chunk").orderBy("__number")
    nxt = told.withColumn("__role", F.lead(role).over(w)).withColumn("__text", F.lead(text).over(w))
    pairs = nxt.where((F.col(role) == "user") & ~F.col("__copy"))
    return pairs.select(conversation, turn, F.col(text).alias("user"), F.when(F.col("__role") == "assistant", F.col("__text")).alias("assistant"))


def with_history(pairs: DataFrame, conversation: str = "conv_id", turn: str = "turn", keep: int = 10, **how) -> DataFrame:
    """Adds history: the answered ones of the last `keep` exchanges before, in order. A conversation of any length is dealt in
    chunks, each with the `keep` exchanges before it."""
    near = overlapping(pairs, [turn], [conversation], keep, 0, **how)
    w = Window.partitionBy(conversation, "__chunk").orderBy("__number")
    entry = F.when(F.col("assistant").isNotNull(), F.struct("user", "assistant"))
    told = near.withColumn("history", F.collect_list(entry).over(w.rowsBetween(-keep, -1)))
    return told.where(~F.col("__copy")).drop("__number", "__chunk", "__copy")


def chat_prompt(history: Column, user: Column, system: str = "") -> Column:
    """History blocks, then the open turn."""
    blocks = F.array_join(F.transform(history, lambda x: F.concat(F.lit("<|im_start|>user\n"), x["user"], F.lit("<|im_end|>\n<|im_start|>assistant\n"), x["assistant"], F.lit("<|im_end|>\n"))), "")
    return F.concat(F.lit(system), blocks, F.lit("<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def request_statistics(items: DataFrame, keywords: str = "keywords", files: str = "files") -> DataFrame:
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return items.agg(F.count("*").alias("n_records"), F.count_if(size(keywords) > 0).alias("n_with_keywords"), F.sum(size(files)).alias("n_files"))
