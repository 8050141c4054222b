"""Attachments of records: kinds, decoding and text, content by content in filtered branches.

Built-in functions decide the kind and decode; Arrow functions run only on the branch that needs them, as Spark does not
keep a Python function inside `when` from running on other rows. PDF and OCR engines are plugged in; none is bundled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NULL_TOKENS, clean_text, let, strip

# Signatures, names and limits of attachments.
TEXT_TYPES = ["txt", "md", "csv", "json", "xml", "html", "htm", "log"]
IMAGE_TYPES = ["png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp", "gif"]
DATA_URI = r"^data:([^;,]*)((?:;[^;,]*)*?)(;base64)?,([\s\S]*)$"
MAX_BYTES, MAX_PAGES = 50 << 20, 200
BASE64_KEYS = ["base64", "contentBase64", "fileBase64", "fileData", "fileContent"]
BYTES_KEYS = ["bytes", "binary"]
NAME_KEYS = ["name", "fileName", "filename", "originalName"]
TYPE_KEYS = ["contentType", "content_type", "mimeType", "mime_type"]


def base64_bytes(text: Column) -> Column:
    """Bytes of base64 in either alphabet, white space and missing padding allowed; null if invalid or empty."""
    core = F.regexp_replace(F.translate(F.regexp_replace(text, r"(?U)\s+", ""), "-_", "+/"), "=+$", "")
    whole = lambda t: F.when(t.rlike("^[A-Za-z0-9+/]+$") & (F.length(t) % 4 != 1), F.rpad(t, ((F.length(t) + 3) / 4).cast("int") * 4, F.lit("=")))
    return F.try_to_binary(let(core, whole), F.lit("base64"))


def signature(data: Column) -> Column:
    """pdf or image by the first bytes, else null."""
    image = "^(89504E470D0A1A0A|FFD8FF|424D|47494638|49492A00|4D4D002A|52494646.{8}57454250)"
    return let(F.hex(F.substring(data, 1, 12)), lambda h: F.when(h.startswith("25504446"), "pdf").when(h.rlike(image), "image"))


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def is_url(text: Column) -> Column:
    return F.lower(text).startswith("http://") | F.lower(text).startswith("https://") | text.startswith("/")


def classified(files: DataFrame, content: str = "content", name: str = "name", content_type: str = "content_type", encoding: str = "encoding") -> DataFrame:
    """Adds kind (data_uri, url, base64, text, empty) and payload (bytes) to string attachments. Order: data URI, URL,
    declared base64, detected base64 (16 characters at least that decode and have a declared file type or a signature), text."""
    typed = suffix(F.col(name)).isin("pdf", *IMAGE_TYPES) | F.coalesce(F.col(content_type), F.lit("")).rlike("^(application/pdf|image/)")
    declared = F.lower(F.coalesce(F.col(encoding), F.lit(""))) == "base64"

    def kind_and_payload(body: Column) -> Column:
        uri = F.regexp_extract(body, DATA_URI, 4)
        inside = F.when(F.regexp_extract(body, DATA_URI, 3) != "", base64_bytes(uri)).otherwise(F.encode(F.try_url_decode(uri), "UTF-8"))
        tried = F.when(~body.startswith("data:"), base64_bytes(body))

        def chosen(decoded: Column) -> Column:
            detected = (F.length(body) >= 16) & decoded.isNotNull() & (typed | signature(decoded).isNotNull())
            kind = F.when(body.isin("", "base64", "<base64>"), "empty").when(body.startswith("data:"), "data_uri").when(is_url(body), "url").when(declared | F.coalesce(detected, F.lit(False)), "base64").otherwise("text")
            return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "data_uri", inside).when(k == "base64", decoded).alias("payload")))

        return let(tried, chosen)

    found = let(strip(F.coalesce(F.col(content), F.lit(""))), kind_and_payload)
    return files.withColumn("__found", found).withColumn("kind", F.col("__found.kind")).withColumn("payload", F.col("__found.payload")).drop("__found")


def dispatched(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds kind, payload (bytes), content (inline text or URL), name and content_type to attachments given as JSON: a string, or
    an object with any of the keys above.

    A string is, in this order: data URI, URL, detected base64, text. An object's content is data URI, declared base64,
    detected base64, or text (the words base64 and <base64> are none); then come its base64 fields, its bytes (numbers from
    0 to 255), its URL. What has none of these, or does not decode, is failed."""
    given = F.col(raw)
    text = F.when(F.trim(given).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), given, F.lit("}")), "$.v"))
    fields = F.from_json(F.when(F.trim(given).startswith("{"), given), "map<string,string>")
    out = files.withColumns({"__text": text, "__f": fields})
    field = lambda k: F.col("__f")[k]
    first = lambda keys: F.coalesce(*[F.when(field(k) != "", field(k)) for k in keys])
    content, encoding = clean_text(field("content")), F.lower(F.coalesce(field("encoding"), F.lit("")))
    inline = F.when(~F.lower(content).isin("", "base64", "<base64>"), content)
    encoded = F.coalesce(*[F.when(F.trim(field(k)) != "", field(k)) for k in BASE64_KEYS])
    numbers = F.coalesce(*[F.from_json(F.when(field(k).startswith("["), field(k)), "array<int>") for k in BYTES_KEYS])
    in_range = F.coalesce((F.size(numbers) > 0) & F.forall(numbers, lambda x: F.coalesce(x.between(0, 255), F.lit(False))), F.lit(False))
    raw_bytes = F.unhex(F.array_join(F.transform(F.when(in_range, numbers), lambda x: F.lpad(F.hex(x), 2, F.lit("0"))), ""))
    out = out.withColumns({"name": F.coalesce(first(NAME_KEYS), F.lit("")), "content_type": F.coalesce(first(TYPE_KEYS), F.lit("")), "__encoding": F.when(encoding.isin("base64", "b64"), "base64").otherwise("")})
    # an object's content that looks like a URL is text, as it is never downloaded: the mark keeps it from the URL test
    body = F.coalesce(F.col("__text"), F.when(is_url(strip(inline)) & (F.col("__encoding") == ""), F.concat(F.lit("\x01"), inline)).otherwise(inline))
    out = classified(out.withColumn("__body", body), content="__body", encoding="__encoding")
    bare, coded = F.col("__body").isNull(), base64_bytes(encoded)
    url = clean_text(field("url"))
    kind = F.when(~bare, F.col("kind")).when(encoded.isNotNull(), "base64").when(in_range, "bytes").when(url != "", "url").otherwise("failed")
    payload = F.when(~bare, F.col("payload")).when(encoded.isNotNull(), coded).when(in_range, raw_bytes)
    said = F.when(~bare & (F.col("kind") == "text"), clean_text(F.regexp_replace(F.col("__body"), "^\x01", ""))).when(~bare & (F.col("kind") == "url"), strip(F.col("__body"))).when(bare & (kind == "url"), url)
    out = out.withColumns({"content": said, "payload": payload, "kind": kind})
    lost = F.col("kind").isin("base64", "data_uri", "bytes") & F.col("payload").isNull()
    return out.withColumn("kind", F.when(lost | (F.col("kind") == "empty"), "failed").otherwise(F.col("kind"))).drop("__text", "__f", "__encoding", "__body")


def resolved_url(url: Column, base: str) -> Column:
    """Absolute http(s) URLs as they are, other schemes null, relative ones joined to the base without repeating its path."""
    root = base.rstrip("/")
    path = "/" + root.split("://", 1)[1].partition("/")[2] if "/" in root.split("://", 1)[1] else ""
    plain = strip(url)
    relative = F.concat(F.lit("/"), F.ltrim(plain, F.lit("/")))
    within = F.when(relative.startswith(path + "/"), F.substr(relative, F.lit(len(path) + 1))).otherwise(relative) if path else relative
    return F.when(plain.rlike("^(?i)https?://"), plain).when(plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(plain == "", F.lit(None)).otherwise(F.concat(F.lit(root), within))


def decoded_text(data: bytes) -> str:
    """UTF-8 with or without a mark, UTF-16 with one, else GB18030; '' if nothing fits."""
    for encoding in ["utf-8-sig", *(["utf-16"] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else []), "gb18030"]:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


def decoded_rows(binary: DataFrame, key: str, ordinal: str) -> DataFrame:
    """key, ordinal, method, text of rows with a payload, the text as clean_text has it."""
    rows = binary.select(key, ordinal, "payload")
    schema = T.StructType([rows.schema[key], rows.schema[ordinal], T.StructField("method", T.StringType()), T.StructField("text", T.StringType())])

    def one(data) -> str:
        text = decoded_text(bytes(data)).replace("\0", "").strip()
        return "" if text.lower() in NULL_TOKENS else text

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[key, ordinal]].assign(method="decoded", text=[one(x) for x in b["payload"]])

    return rows.mapInPandas(decode, schema)


def cache_key(payload: Column, config: str) -> Column:
    """SHA-256 of the configuration, a zero byte and the bytes."""
    return F.sha2(F.concat(F.lit(config.encode() + b"\0"), payload), 256)


def with_cache(files: DataFrame, cache: DataFrame, config: str, extract: Callable[[DataFrame], DataFrame], key: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """key, ordinal, method and text of files with a payload, and the rows that the cache (cache_key, method, text) lacks. Equal
    payloads are extracted once; a cached text that is blank is no hit. extract: key, ordinal, method and text of such
    files. The new rows are to be written before the texts are read, or both come from one table."""
    keyed = files.where("payload IS NOT NULL").withColumn("cache_key", cache_key(F.col("payload"), config))
    known = cache.where(F.trim("text") != "").select("cache_key", "method", F.trim("text").alias("text"))
    one = keyed.join(known.select("cache_key"), "cache_key", "left_anti")
    one = one.groupBy("cache_key").agg(F.min_by(F.struct(*[c for c in files.columns]), F.struct(key, ordinal)).alias("f")).select("cache_key", "f.*")
    fresh = extract(one).join(one.select("cache_key", key, ordinal), [key, ordinal]).where(F.trim("text") != "").select("cache_key", "method", F.trim("text").alias("text"))
    texts = keyed.select(key, ordinal, "cache_key").join(known.unionByName(fresh), "cache_key", "left")
    return texts.select(key, ordinal, F.coalesce("method", F.lit("failed")).alias("method"), F.coalesce("text", F.lit("")).alias("text")), fresh


PageReader = Callable[[bytes], list[str]]


def extracted(files: DataFrame, key: str, ordinal: str, pdf: Callable[[], PageReader] | None = None, ocr: Callable[[], PageReader] | None = None) -> DataFrame:
    """key, ordinal, method, text of classified attachments. Kinds without an engine, or that fail, get '' and 'failed'; one
    attachment never fails the record."""
    base = files.select(key, ordinal, "kind", "payload", clean_text(F.col("content")).alias("content"), signature(F.col("payload")).alias("format"))
    plain = base.where("kind = 'text'").select(key, ordinal, F.lit("text").alias("method"), F.col("content").alias("text"))
    binary = base.where("payload IS NOT NULL")
    texts = decoded_rows(binary.where("format IS NULL"), key, ordinal)
    out = plain.union(texts)
    for kind, load in (("pdf", pdf), ("image", ocr)):
        some = binary.where(F.col("format") == kind)
        if load is None:
            out = out.union(some.select(key, ordinal, F.lit("failed"), F.lit("")))
        else:
            read = _pages_udf(load)(F.col("payload"))
            out = out.union(some.withColumn("text", read).select(key, ordinal, F.when(F.col("text") == "", "failed").otherwise(kind), "text"))
    rest = base.where("kind IN ('url', 'empty') OR (kind IN ('data_uri', 'base64') AND payload IS NULL)")
    return out.union(rest.select(key, ordinal, F.lit("failed"), F.lit("")))


def _pages_udf(load: Callable[[], PageReader]):
    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = load()  # one engine for a worker

        def one(data) -> str:
            try:
                pages = engine(bytes(data)) if data is not None and len(data) <= MAX_BYTES else []
            except Exception:  # a broken file gives no text, and the record goes on
                return ""
            return "\n\n".join(f"【第{i}页】\n{p.strip()}" for i, p in enumerate(pages[:MAX_PAGES], 1) if p.strip())

        for b in batches:
            yield b.map(one)

    return read


def content_sections(texts: DataFrame, key: str, ordinal: str) -> DataFrame:
    """key and content: a record's texts in order, each under its label, with a blank line between; empty texts go."""
    label = F.concat(F.lit("【附件"), F.col(ordinal).cast("string"), F.lit(" "), F.col("method"), F.lit("】\n"), F.col("text"))
    section = F.when(F.col("text") != "", F.struct(F.col(ordinal), label.alias("section")))
    return texts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(section)), lambda x: x["section"]), "\n\n").alias("content"))


def record_content(items: DataFrame, sections: DataFrame, key: str, direct: list[str]) -> DataFrame:
    """Adds content: the first direct field that is not null, else the attachments' sections, else ''."""
    both = items.join(sections.withColumnRenamed("content", "__sections"), key, "left")
    return both.withColumn("content", clean_text(F.coalesce(*[F.col(c) for c in direct], F.col("__sections")))).drop("__sections")


def landed_files(spark, folder: str, limit: int = MAX_BYTES) -> DataFrame:
    """Files of a folder with their bytes; larger ones are not read (the length filter is pushed to the source)."""
    return spark.read.format("binaryFile").load(folder).where((F.col("length") > 0) & (F.col("length") <= limit))
