"""Intermediate tables in the folder that the whole cluster shares, and joins that spare most rows or spread hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in the filter that spares rows a shuffle.
FILTER_WORDS = 1 << 17
#: Rows of an Arrow batch: some MB of text.
BATCH_ROWS = 1024
_OWN: dict[str, str] = {}
#: Tables of the jobs that are open, the innermost last. Each thread has its own.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("quillstone_open", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in tests, a temporary one, on a local master only: other
    executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _OWN.setdefault(context.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        _OWN[context.applicationId] = folder
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lets Python workers take BATCH_ROWS rows at a time, or fewer if the session says so: tables of texts have long rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def stored(df: DataFrame, level: int = 0) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and its path. level: which of the open blocks removes it, the innermost 1."""
    path = f"{shared_folder(df.sparkSession)}/quillstone-{uuid.uuid4().hex}"
    if 0 < level <= len(_OPEN.get()):
        _OPEN.get()[-level].append(path)
    eased(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def eased(spark: SparkSession) -> None:
    """Has the driver collect its garbage where its heap has come to three quarters of its limit: what is left of the plans of many
    joins would take it there, and the memory stays with the process."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > 0.75 * runtime.maxMemory():
        spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, is computed once, and survives lost executors."""
    return stored(df, 1)[0]


def lasting(df: DataFrame) -> DataFrame:
    """As written, for a table that outlives the `temporary` block around it: the block outside of that one removes it, if
    there is one."""
    return stored(df, 2)[0]


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that `written` makes inside. What is used later must be `lasting`."""
    own: list[str] = []
    outer = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(outer)
        for path in own:
            removed(spark, path)
        gc.collect()  # Spark removes shuffle files as the plans that made them are collected
        spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str, salts: int = 16, few: bool = False) -> DataFrame:
    """Joins `right`, which has a key once at most, with a left side in which one key may have a third of the rows: these
    are dealt over `salts` places by a hash of `spread`, and right's rows are repeated for each. The copies are alike and shuffle
    to a few bytes each, so Spark, which goes by these bytes, would broadcast tables that the driver then holds many times as
    large: they are merged, unless there are `few`, as of sources."""
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(F.lit("salt"), spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return dealt.join(copies if few else copies.hint("merge"), [*on, "__salt"], how).drop("__salt")


def split_by(rows: DataFrame, keys: DataFrame, on: list[str], once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in the table of keys, and rows whose key surely is not, by a bitmap over a hash of the key, which
    is broadcast (FILTER_WORDS rows at most). If it fills up, the first are more. once: it is not written, for a single use."""
    bit = F.pmod(F.xxhash64(F.lit("bit"), *on), F.lit(FILTER_WORDS * 64))
    place = lambda df: df.withColumn("__word", F.floor(bit / 64).cast("int")).withColumn("__bit", F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")))
    words = place(keys.select(*on)).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    words = words if once else written(words)
    met = place(rows).join(F.broadcast(words), "__word", "left")
    maybe = F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    return tuple(met.where(x).drop("__word", "__bit", "__bits") for x in (maybe, ~maybe))
