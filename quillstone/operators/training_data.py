"""Splits, token arrays and training metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hash_bucket, strip
from ..sources.jsonl import any_json
from .ranks import numbered

IGNORED = -100
#: What a training prompt begins with unless the caller says otherwise, and what it ends with.
SYSTEM = "请只输出合法JSON，审核依据和思考过程使用简体中文。"
ANSWER_MARK = "请只输出一行JSON，不要输出解释性前缀。\n输出："


def training_prompt(instruction: Column, question: Column, system: str = SYSTEM) -> Column:
    """System text, instruction and question with a blank line between, and the mark of the answer."""
    return F.concat_ws("\n\n", F.lit(system), strip(instruction), strip(question), F.lit(ANSWER_MARK))


def answer_text(output: Column, eos: str) -> Column:
    """The stripped output with one end mark; a literal in quotes of either kind becomes JSON."""
    plain = any_json(strip(output))
    return F.when(F.endswith(plain, F.lit(eos)), plain).otherwise(F.concat(plain, F.lit(eos)))


def tokenized(samples: DataFrame, prompt: str, answer: str, load: Callable[[], Callable[[str], list[int]]], limit: int, eos_id: int, keep: str) -> DataFrame:
    """keep (a column), input_ids, attention_mask and labels of samples, by a tokenizer that each task loads. An answer at the
    limit is cut and ends with eos_id; the prompt keeps its first third and its end in what room is left."""
    schema = f"`{keep}` {samples.schema[keep].dataType.simpleString()}, input_ids array<int>, attention_mask array<int>, labels array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load()
        for b in batches:
            ids, labels = [], []
            for p, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                asked, told = tokens(p or ""), tokens(a or "")
                if len(told) >= limit:
                    told = [*told[: limit - 1], eos_id]
                room = limit - len(told)
                if len(asked) > room:
                    head = max(1, room // 3) if room else 0
                    asked = asked[:head] + asked[len(asked) - (room - head) :]
                ids.append(asked + told)
                labels.append([IGNORED] * len(asked) + told)
            kind = pa.list_(pa.int32())
            columns = [b.column(0), pa.array(ids, kind), pa.array([[1] * len(x) for x in ids], kind), pa.array(labels, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[keep, "input_ids", "attention_mask", "labels"])

    return samples.select(keep, prompt, answer).mapInArrow(encode, schema)


def split_key(input_json: Column) -> Column:
    """The title in an input's JSON, else the whole input."""
    return F.coalesce(F.get_json_object(input_json, "$.题名"), input_json)


def split(samples: DataFrame, key: Column, ratio: float, order: str, min_samples: int = 0) -> DataFrame:
    """Adds part: validation where the key's bucket is below ratio, else train. Rows of a key stay together. If one side is
    empty and the other has several rows, exactly one row goes there: the last by order, nulls first, and a hash of its values
    where the order repeats. Fewer rows than `min_samples` are refused."""
    marked = samples.withColumn("part", F.when(hash_bucket(key) < int(ratio * 10_000), "validation").otherwise("train"))
    place = F.struct(F.col(order).alias("o"), F.xxhash64(*[F.to_json(c) if isinstance(samples.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(c) for c in samples.columns]).alias("h"))
    n, train, last = marked.agg(F.count("*"), F.count_if(F.col("part") == "train"), F.max(place)).first()
    if n < min_samples:
        raise ValueError(f"{n} samples, fewer than {min_samples}")
    if n < 2 or 0 < train < n:
        return marked
    is_last = place.eqNullSafe(F.struct(F.lit(last["o"]).cast(samples.schema[order].dataType).alias("o"), F.lit(last["h"]).cast("long").alias("h")))
    twins = marked.where(is_last).withColumn("__turn", F.row_number().over(Window.orderBy(F.lit(0))))  # rows equal in all values: one moves
    moved = twins.withColumn("part", F.when(F.col("__turn") > 1, F.col("part")).otherwise("train" if train == 0 else "validation")).drop("__turn")
    return marked.where(~is_last).unionByName(moved)


def truncated(prompt: Column, answer: Column, limit: int) -> Column:
    """The prompt's tokens that leave room for the answer: the first third and the last two thirds of the room."""
    room = F.greatest(F.lit(0), F.lit(limit) - F.size(answer))
    head = F.floor(room / 3).cast("int")
    tail = room - head
    kept = F.concat(F.slice(prompt, 1, head), F.slice(prompt, F.greatest(F.size(prompt) - tail + 1, F.lit(1)), tail))
    return F.when(F.size(prompt) <= room, prompt).otherwise(kept)


def token_sample(prompt: Column, answer: Column, limit: int) -> dict[str, Column]:
    """input_ids, attention_mask and labels, with the prompt's labels ignored; a longer answer is cut at the limit."""
    answer = F.slice(answer, 1, limit)
    kept = truncated(prompt, answer, limit)
    size = F.size(kept) + F.size(answer)
    return {
        "input_ids": F.concat(kept, answer),
        "attention_mask": F.array_repeat(F.lit(1), size),
        "labels": F.concat(F.array_repeat(F.lit(IGNORED), F.size(kept)), answer),
    }


def padded(rows: DataFrame, batch: str, ids: str, pad: int) -> DataFrame:
    """ids right-padded to the longest of the row's batch: a maximum for each batch, joined back, so that a large batch is
    neither sorted nor held by one task."""
    longest = rows.groupBy(F.col(batch).alias("__batch")).agg(F.max(F.size(ids)).alias("__longest"))
    both = rows.join(longest, F.col(batch).eqNullSafe(F.col("__batch"))).drop("__batch")
    return both.withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad), F.col("__longest") - F.size(ids)))).drop("__longest")


def learnable(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def length_statistics(rows: DataFrame, size: Column) -> DataFrame:
    return rows.agg(F.min(size).alias("min_tokens"), F.max(size).alias("max_tokens"), F.avg(size).alias("mean_tokens"))


def batches(rows: DataFrame, order: str, size: int, group: str) -> DataFrame:
    """Adds batch: rows of a group in order, `size` at a time; the last may be short."""
    turn = F.col("__turn") - 1
    return numbered(rows, [order], [group], "__turn").withColumn("batch", F.floor(turn / size).cast("long")).drop("__turn")


def rank_shard(rows: DataFrame, order: str, world: int, group: str) -> DataFrame:
    turn = F.col("__turn") - 1
    return numbered(rows, [order], [group], "__turn").withColumn("shard", F.pmod(turn, F.lit(world)).cast("long")).drop("__turn")


def epoch_shards(rows: DataFrame, key: str, world: int, seed: int, epoch: int, **how) -> DataFrame:
    """Adds shard and place (both from 0): the rows in an order drawn for the epoch, dealt over `world` shards in turn. Shards are
    equal in size: the first rows of the order come again at its end until they are. The order is that of a digest of seed,
    epoch and key, so that it is the same on every run and cluster; rows are numbered by ranges of it, not sorted as a
    whole. An empty table stays empty."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.lit(epoch).cast("string"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    placed = numbered(rows.withColumn("__drawn", drawn).withColumn("__all", F.lit(0)), ["__drawn", key], ["__all"], "__turn", **how)
    total = rows.agg(F.count("*").alias("__n"))
    both = placed.join(F.broadcast(total))  # one row
    padded = F.ceil(F.col("__n") / world) * world
    at = F.explode(F.sequence(F.col("__turn").cast("long") - 1, padded - 1, F.col("__n")))
    out = both.withColumn("__at", at)
    return out.withColumns({"shard": F.pmod("__at", F.lit(world)), "place": F.floor(F.col("__at") / world)}).drop("__drawn", "__all", "__turn", "__n", "__at")


def epoch_losses(steps: DataFrame, group: list[str], loss: str) -> DataFrame:
    """Mean loss of each group's steps, to six decimals."""
    return steps.groupBy(*group).agg(F.round(F.avg(loss), 6).alias("loss"))


def training_metrics(epochs: DataFrame, run: str, epoch: str, loss: str, samples: DataFrame) -> DataFrame:
    """run and metrics: JSON with best epoch and loss, sample counts (run, part: train or validation), and the losses by epoch."""
    history = epochs.groupBy(run).agg(F.sort_array(F.collect_list(F.struct(F.col(epoch).alias("epoch"), F.round(loss, 6).alias("validation_loss")))).alias("history"))  # a run's epochs
    part = lambda name: F.count_if(F.col("part") == name)
    counts = samples.groupBy(run).agg(part("train").alias("train_sample_count"), part("validation").alias("validation_sample_count"))
    both = best_epoch(epochs, run, epoch, loss).join(history, run).join(counts, run, "left")
    fields = ["best_epoch", F.round("best_loss", 6).alias("best_validation_loss"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("train_sample_count", "validation_sample_count")), "history"]
    return both.select(run, F.to_json(F.struct(*fields)).alias("metrics"))


def mean_of_batch_means(rows: DataFrame, batch: str, loss: str, group: list[str]) -> DataFrame:
    """Mean over batches of each batch's mean loss, for each group."""
    return rows.groupBy(*group, batch).agg(F.avg(loss).alias("loss")).groupBy(*group).agg(F.avg("loss").alias("validation_loss"))


def best_epoch(epochs: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """The first epoch with the least loss of each run, and that loss."""
    return epochs.groupBy(run).agg(F.min(F.struct(F.col(loss), F.col(epoch))).alias("b")).select(run, F.col(f"b.{epoch}").alias("best_epoch"), F.col(f"b.{loss}").alias("best_loss"))


def retry_ladder(batch: Column, accumulation: Column, length: Column) -> Column:
    """Settings to try after running out of memory, each once, in order: as given; single rows with more accumulation, 32 at
    most; then shorter lengths."""
    one = lambda b, a, n: F.struct(b.cast("int").alias("batch_size"), a.cast("int").alias("accumulation"), n.cast("int").alias("max_length"))
    more = F.when(batch > 1, F.least(F.lit(32), accumulation * batch)).otherwise(accumulation)
    steps = [one(batch, accumulation, length), one(F.least(batch, F.lit(1)), more, length)]
    steps += [one(F.least(batch, F.lit(1)), more, F.least(length, F.lit(n))) for n in (2048, 1536, 1024)]
    return F.array_distinct(F.array(*steps))
