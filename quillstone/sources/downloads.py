"""Files and training sets fetched from URLs, by tasks: as a data source (`downloads`), and over a table of URLs.

Every URL gives a row: its content, or why there is none. A server that is down or a file that is too large fails its row only.
"""

from __future__ import annotations

import http.client
import json
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .attachments import MAX_BYTES

FIELDS = "url string, status int, content_type string, content binary, error string"
#: Bytes of a read, and seconds that a server may take for one.
CHUNK, TIMEOUT = 1 << 20, 30.0


def fetched(url: str | None, limit: int = MAX_BYTES, timeout: float = TIMEOUT) -> tuple:
    """A row of FIELDS. Larger files than the limit are refused by the size that the server declares, or as soon as more has come;
    at most the limit and a read are held. No bytes are an error too. The type is without parameters, in lower case."""
    if not (url or "").lower().startswith(("http://", "https://")):
        return url, None, None, None, "no http(s) URL"
    status = kind = None
    try:
        with urllib.request.urlopen(url, timeout=timeout) as reply:
            status, kind = reply.status, (reply.headers.get("Content-Type") or "").split(";", 1)[0].strip().lower()
            declared = reply.headers.get("Content-Length") or ""
            if declared.isdigit() and int(declared) > limit:
                return url, status, kind, None, f"declared size {declared} is above {limit}"
            parts, size = [], 0
            while chunk := reply.read(CHUNK):
                parts.append(chunk)
                size += len(chunk)
                if size > limit:
                    return url, status, kind, None, f"size is above {limit}"
    except urllib.error.HTTPError as e:
        return url, e.code, None, None, f"status {e.code}"
    except (OSError, ValueError, http.client.HTTPException) as e:
        return url, status, kind, None, f"{type(e).__name__}: {e}"[:500]
    return (url, status, kind, b"".join(parts), None) if size else (url, status, kind, None, "empty")


class Downloads(DataSource):
    """Options: urls (a JSON list, for as many as a driver may hold; a table of any size goes through `downloaded`), limit (bytes),
    timeout (seconds), together (URLs of a partition, 1 by default)."""

    @classmethod
    def name(cls) -> str:
        return "downloads"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return DownloadReader(json.loads(self.options["urls"]), int(self.options.get("limit", MAX_BYTES)), float(self.options.get("timeout", TIMEOUT)), int(self.options.get("together", 1)))


class DownloadReader(DataSourceReader):
    def __init__(self, urls: list[str], limit: int, timeout: float, together: int):
        self.urls, self.limit, self.timeout, self.together = urls, limit, timeout, max(1, together)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[k : k + self.together]) for k in range(0, len(self.urls), self.together)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.value:
            yield fetched(url, self.limit, self.timeout)


def from_urls(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """Rows of FIELDS of a list of URLs."""
    spark.dataSource.register(Downloads)
    reader = spark.read.format("downloads").option("urls", json.dumps(urls))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def downloaded(files: DataFrame, url: str = "url", limit: int = MAX_BYTES, timeout: float = TIMEOUT) -> DataFrame:
    """Rows of FIELDS for each distinct URL of a table. URLs are dealt by hash, so that one server's stand in many tasks; a null
    URL gives no row. Batches are small, as contents are large."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for u in batch.column(0).to_pylist():
                row = fetched(u, limit, timeout)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    return files.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct().mapInArrow(fetch, FIELDS)


def failures(files: DataFrame) -> DataFrame:
    """url, status and error of what could not be fetched."""
    return files.where("error IS NOT NULL").select("url", "status", "error")


def payload(files: DataFrame, schema: str) -> DataFrame:
    """data of fetched training sets, one JSON object each, by the schema of its fields. Any failure, or a file that holds
    anything else, fails the job: a training set is fetched whole or not at all."""
    text = F.decode("content", "UTF-8")
    good = F.col("error").isNull() & F.json_object_keys(text).isNotNull()
    why = F.concat(F.lit("training set "), F.coalesce("url", F.lit("")), F.lit(": "), F.coalesce("error", F.lit("no JSON object")))
    return files.select(F.from_json(F.when(good, text).otherwise(F.raise_error(why).cast("string")), schema).alias("p")).select("p.data")
