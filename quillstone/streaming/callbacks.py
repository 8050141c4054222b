"""Callbacks that are sent by a streaming sink, and what failed as a file stream that comes back to it.

The sink (`callbacks`) posts the rows of a micro-batch from its tasks and keeps the outcome of each row. A row that has been
sent is noted at once; so if a batch breaks off and runs again, it is not sent twice. A batch's outcomes appear, as JSON lines
in folder/outcomes, when it is committed. `deliver` reads them again as a stream: rows that failed come back with the next
batch until they are sent or their attempts are used up.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

OUTCOME = [T.StructField("sent", T.BooleanType()), T.StructField("status", T.IntegerType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("batch_id", T.LongType())]


def posted(url: str, body: str, timeout: float) -> tuple[bool, int | None, str | None]:
    """Whether a callback was accepted (HTTP 2xx, and its reply's code 0, 200 or none), the status, and why not."""
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json; charset=utf-8"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            status, text = reply.status, reply.read(1 << 16).decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return False, e.code, f"status {e.code}"
    except (OSError, ValueError, http.client.HTTPException) as e:
        return False, None, f"{type(e).__name__}: {e}"[:500]
    try:
        said = json.loads(text)
        code = said.get("code", 0) if isinstance(said, dict) else 0
    except ValueError:
        code = 0
    return (True, status, None) if code in (0, 200) else (False, status, f"code {code}")


@dataclass
class Tried(WriterCommitMessage):
    """The file with the outcomes of a task, null if it had no rows."""

    name: str | None


class CallbackSink(DataSource):
    """Options: url, folder (one that the cluster shares, as a URI), payload (the column that is posted), timeout (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "callbacks"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return CallbackWriter(dict(self.options))


class CallbackWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.url, self.folder, self.payload, self.timeout = options["url"], options["folder"].rstrip("/"), options["payload"], float(options.get("timeout", 10))

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.folder)
        before, task, done = None, uuid.uuid4().hex, []
        for row in iterator:
            held = row.asDict(recursive=True)
            name = hashlib.sha256(json.dumps(held, sort_keys=True, default=str).encode()).hexdigest()
            if before is None:  # what this batch has sent before it broke off
                store.create_dir(f"{root}/tries", recursive=True)
                before = {x.base_name: x.path for x in store.get_file_info(fs.FileSelector(f"{root}/tries")) if x.base_name.endswith(".sent")}
            held["attempts"] = (held.get("attempts") or 0) + 1
            if f"{name}.sent" in before:
                held |= {"sent": True, "status": None, "error": None}
            else:
                held["sent"], held["status"], held["error"] = posted(self.url, held[self.payload] or "", self.timeout)
                if held["sent"]:
                    with store.open_output_stream(f"{root}/tries/{name}.sent"):
                        pass
            done.append(json.dumps(held, ensure_ascii=False, default=str))
        if not done:
            return Tried(None)
        with store.open_output_stream(f"{root}/tries/{task}.jsonl") as out:
            out.write(("\n".join(done) + "\n").encode())
        return Tried(f"{task}.jsonl")

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(f"{root}/outcomes", recursive=True)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{root}/tries/{m.name}", f"{root}/outcomes/{batchId}-{m.name}")
        if store.get_file_info(f"{root}/tries").type != fs.FileType.NotFound:
            store.delete_dir_contents(f"{root}/tries")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        """What was sent stays noted for the batch's next run; outcomes that were not committed do not count."""


def outcome_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([f for f in rows.schema.fields if f.name != "attempts"] + [x for x in OUTCOME if x.name != "batch_id"])


def outcomes(rows: DataFrame, folder: str) -> DataFrame:
    """All attempts that have been committed: the rows' columns, sent, status, error, attempts and batch_id."""
    read = rows.sparkSession.read.schema(outcome_schema(rows)).json(f"{folder}/outcomes")
    return read.withColumn("batch_id", F.regexp_extract("_metadata.file_name", r"^(\d+)-", 1).cast("long"))


def deliver(rows: DataFrame, url: str, folder: str, checkpoint: str, payload: str = "payload", most: int = 3, timeout: float = 10, every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Sends a stream of rows, and with each batch those of batches before it that failed, `most` attempts in all.

    folder: a URI that all executors share. once: stops when all that is there now has been tried once."""
    spark = rows.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/outcomes", recursive=True)
    spark.dataSource.register(CallbackSink)
    failed = spark.readStream.schema(outcome_schema(rows)).json(f"{folder}/outcomes").where((~F.col("sent")) & (F.col("attempts") < most))
    both = rows.withColumn("attempts", F.lit(0)).unionByName(failed.drop("sent", "status", "error"))
    writer = both.writeStream.format("callbacks").option("url", url).option("folder", folder).option("payload", payload).option("timeout", str(timeout)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
