"""Tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and the master is this process."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(folder or 'file://' + tempfile.mkdtemp(prefix='quillstone-')).rstrip('/')}/tables-{uuid.uuid4().hex}"


#: Rows and bytes that a Python worker takes at once, at most.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def small_batches() -> None:
    """Lets the active session's Python workers take BATCH_ROWS rows or about BATCH_BYTES at a time, or fewer if the session says
    so: a batch, its strings and what is made of them are held together, for each core, and texts are long."""
    spark = SparkSession.getActiveSession()
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)) if spark else ():
        key = f"spark.sql.execution.arrow.{name}"
        said = spark.conf.get(key).rstrip("bB")
        if not (said.isdigit() and 0 < int(said) <= most):
            spark.conf.set(key, str(most))


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table: computed once, without the plan that they came from, and there for any executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, path: str) -> DataFrame:
    """Puts the rows in place of the table at a path, which the rows may have been read from: they are written beside it and, only
    when they stand whole, take its name. A write that fails leaves the table as it was; should the last renaming fail, it
    gets its name back."""
    spark = df.sparkSession
    new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new.toString())
        held = store.exists(own)
        if held and not store.rename(own, old):
            raise OSError(f"{path} cannot be renamed")
        if not store.rename(new, own):
            if held:
                store.rename(old, own)
            raise OSError(f"{path} cannot be replaced")
        store.delete(old, True)
    finally:
        store.delete(new, True)
    return spark.read.schema(df.schema).parquet(path)
