"""JSON Lines tables: strict and lenient loads, rule corpora, writes."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import confidence, strip

SAMPLE = T.StructType([T.StructField(x, T.StringType()) for x in ("instruction", "input", "output")])
RULE_LINE = T.StructType([T.StructField("input", T.StringType())])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines count) and text of whole small files, such as rule corpora."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "text"))
    return whole.select("file", (F.col("i") + 1).alias("line"), "text").where(F.trim("text") != "")


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines count) and text of files of any size. Lines are numbered within each block that a task
    reads, and blocks by their counts, so no file meets in one task."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    lines = spark.read.text(path).select(*place, F.col("value").alias("text"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = F.broadcast(blocks.withColumn("before", before))  # a row a block, so the lines stay where they are read
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "text")


def rule_lines(spark: SparkSession, path: str, kind: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Lines for rules.corpus, and the lines that are no JSON objects with an input text."""
    read = numbered_lines(spark, path).withColumn("j", F.from_json("text", RULE_LINE))
    good = F.col("j.input").isNotNull()
    return read.where(good).select(F.lit(kind).alias("kind"), F.lit(source).alias("source"), "line", F.col("j.input").alias("input")), read.where(~good).select("file", "line", "text")


def as_json(text: Column) -> Column:
    """An object's JSON: the text itself if it is one, else what a literal in quotes of either kind says; null if neither."""

    @F.pandas_udf("string")
    def literal(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                found = ast.literal_eval(t) if t else None
                return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        return texts.map(one)

    good = F.json_object_keys(text).isNotNull()
    return F.when(good, text).otherwise(literal(F.when(~good, text)))  # other rows reach Python as nulls


def any_json(text: Column) -> Column:
    """The text itself if it is JSON of any type; what a literal in quotes of either kind says as JSON; else the text."""

    @F.pandas_udf("string")
    def literal(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return json.dumps(ast.literal_eval(t), ensure_ascii=False) if t else None
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        return texts.map(one)

    good = F.try_parse_json(text).isNotNull()
    return F.when(good, text).otherwise(F.coalesce(literal(F.when(~good, text)), text))  # other rows reach Python as nulls


ANSWER = "`审核结果` string, `审核依据` string, `置信度` string, `思考过程` string"


def checked_samples(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds instruction, input, output and error to lines of JSON: why a line is no training sample, null if it is one. The
    output becomes JSON with four fields: a missing confidence is 8, missing reasoning the basis."""
    row = F.from_json(F.col(text), SAMPLE, {"maxStringLen": str(2**31 - 1)})  # else texts of over 20 million characters are null
    out = lines.withColumns({"__keys": F.json_object_keys(text), "__row": row}).withColumn("__out", as_json(F.col("__row.output")))
    out = out.withColumns({"__had": F.json_object_keys("__out"), "__answer": F.from_json("__out", ANSWER)})
    names = ["instruction", "input", "output"]
    some = F.lit(True)
    for n in names:
        some = some & (F.coalesce(F.col(f"__row.{n}"), F.lit("")) != "")
    result, basis, thinking = (strip(F.coalesce(F.col("__answer")[x], F.lit(""))) for x in ("审核结果", "审核依据", "思考过程"))
    missing = F.array_sort(F.array_except(F.array(F.lit("审核结果"), F.lit("审核依据")), "__had"))
    error = (
        F.when(F.col("__keys").isNull(), "no JSON object")
        .when(~some, "instruction, input or output is missing")
        .when(F.col("__had").isNull(), "output is no JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("output lacks: "), F.array_join(missing, ",")))
        .when(result == "", "no result")
        .when(basis == "", "no basis")
    )
    full = F.to_json(F.struct(result.alias("审核结果"), basis.alias("审核依据"), confidence(F.col("__answer")["置信度"]).alias("置信度"), F.when(thinking == "", basis).otherwise(thinking).alias("思考过程")))
    out = out.withColumn("error", error)
    out = out.withColumns({"instruction": F.col("__row.instruction"), "input": F.col("__row.input"), "output": F.when(F.col("error").isNull(), full)})
    return out.drop("__keys", "__row", "__out", "__had", "__answer")


def training_samples(spark: SparkSession, path: str, max_samples: int | None = None, min_samples: int = 1) -> DataFrame:
    """instruction, input, output of a .jsonl file, the first `max_samples` by line. Any invalid line before the last of them
    fails the load and the first five are named; so do an empty file and fewer samples than `min_samples`, one for each
    process that trains."""
    if not path.endswith(".jsonl"):
        raise ValueError(f"training data must be a .jsonl file: {path}")
    lines = checked_samples(lines_in_order(spark, path).where(F.trim("text") != ""))
    good, place = lines.where("error IS NULL"), F.struct("file", "line")
    if max_samples:
        good = good.orderBy("file", "line").limit(max_samples)
    n, last = good.agg(F.count("*"), F.max(place)).first()
    before = place <= F.struct(F.lit(last[0]).alias("file"), F.lit(last[1]).cast("long").alias("line")) if max_samples and n >= max_samples else F.lit(True)
    bad = lines.where(F.col("error").isNotNull() & before).select("line", "error").orderBy("file", "line").limit(5).collect()
    if bad:
        raise ValueError("invalid samples: " + "; ".join(f"line {r['line']}: {r['error']}" for r in bad))
    if n < max(1, min_samples):
        raise ValueError(f"{n} samples, fewer than {max(1, min_samples)}")
    return good.select("instruction", "input", "output")


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank; 0 if there is no such path."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path).where(F.trim("value") != "").count()
    except AnalysisException:
        return 0


def keyed_object(spark: SparkSession, path: str, value: T.StructType, key: str = "model_id", lines: bool = False) -> DataFrame:
    """A JSON object of objects as rows: key and the value's fields. lines: each line of the files is such an object; else each
    file is one and is read whole, which is for registries that fit in a task."""
    whole = spark.read.text(path, wholetext=not lines).select(F.from_json("value", T.MapType(T.StringType(), value)).alias("m"))
    return whole.select(F.explode("m").alias(key, "v")).select(key, *[F.col(f"v.{f.name}") for f in value.fields if f.name != key])


def write(df: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON Lines; a folder appears whole or not at all, by the committer. one_file is for bounded results only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)
