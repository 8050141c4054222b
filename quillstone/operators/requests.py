"""Review requests: JSON lines with names in two languages to typed requests and items, with the reason of each refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CONTROL, OPEN, keyword_contract, keyword_list
from ..functions.text import partial_date, strip
from ..functions.variants import elements, parsed, text_of

# Fields of a request and of an item, each with the other name that it may have.
REQUEST = {"model_id": "modelId", "ai_audit_id": "aiAuditId", "model_type": "modelType", "data": "data"}
ITEM = {
    "arid": "arid",
    "title": "题名",
    "date_time": "成文日期",
    "content": "content",
    "audit_result": "audit_result",
    "archive_category": "门类",
    "organization_problem": "机构或问题",
    "fonds_no": "全宗号",
    "document_no": "文号",
    "responsible_org": "责任者",
    "retention_period": "保管期限",
    "archive_year": "归档年度",
}


def _named(fields: Column, name: str, other: str) -> Column:
    """A field by its other name, else by its own."""
    return F.coalesce(fields[other], fields[name])


def parsed_requests(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds model_id, ai_audit_id, model_type, data (array of maps) and error to lines of JSON objects. A request has all four,
    none of them empty, and no other field."""
    fields = F.from_json(F.col(text), "map<string,string>")
    known = F.array(*[F.lit(x) for x in sorted({*REQUEST, *REQUEST.values()})])
    out = lines.withColumns({"__keys": F.json_object_keys(text), "__fields": fields})
    out = out.withColumns({n: _named(F.col("__fields"), n, o) for n, o in REQUEST.items() if n != "data"})
    out = out.withColumn("data", F.from_json(F.col("__fields")["data"], "array<map<string,string>>"))
    others = F.array_sort(F.array_except("__keys", known))
    error = F.when(F.col("__keys").isNull(), "no JSON object").when(F.size(others) > 0, F.concat(F.lit("unknown field: "), F.array_join(others, ",")))
    for n in ("model_id", "ai_audit_id", "model_type"):
        error = error.when(F.coalesce(F.col(n), F.lit("")) == "", f"{n} is empty")
    error = error.when(F.coalesce(F.size("data"), F.lit(0)) <= 0, "data is empty")
    return out.withColumn("error", error).drop("__keys", "__fields")


def request_items(requests: DataFrame, *keep: str) -> DataFrame:
    """A row for each item of requests without an error: ai_audit_id, model_id, model_type, number (from 1), the item's fields,
    files and keywords (arrays), and error. Names in either language count; other fields are left; keywords are trimmed, once
    each, and with their result cleared for other kinds than hk; partial dates are shortened."""
    each = requests.where("error IS NULL").select(*keep, "ai_audit_id", "model_id", "model_type", F.posexplode("data").alias("number", "item"))
    hk = F.col("model_type") == "hk"
    columns = {n: F.coalesce(_named(F.col("item"), n, o), F.lit("")) for n, o in ITEM.items()}
    columns["date_time"] = partial_date(strip(columns["date_time"]))
    columns["keywords"] = keyword_list(F.from_json(F.col("item")["keywords"], "array<string>"))
    columns["files"] = F.coalesce(F.from_json(F.col("item")["files"], "array<string>"), F.array().cast("array<string>"))
    out = each.withColumn("number", F.col("number") + 1).withColumns(columns)
    broken = keyword_contract(F.col("model_type"), F.col("keywords"), F.col("audit_result"))
    error = F.when(F.col("arid") == "", "arid is empty").when(F.col("title") == "", "title is empty").when(~F.col("audit_result").isin("", OPEN, CONTROL), "unknown result").when(broken.isNotNull(), broken)
    none = F.array().cast("array<string>")
    return out.withColumn("error", error).withColumns({"keywords": F.when(hk, F.col("keywords")).otherwise(none), "audit_result": F.when(hk, F.col("audit_result")).otherwise("")}).drop("item")


def accepted_items(items: DataFrame) -> DataFrame:
    """Items of the requests in which no item has an error: one refuses the request."""
    bad = items.where("error IS NOT NULL").select("ai_audit_id").distinct()
    return items.join(bad, "ai_audit_id", "left_anti").drop("error")


def model_errors(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds model_error to requests (model_id, model_type): the model is not registered, or is of another type."""
    known = registry.select("model_id", F.col("model_type").alias("__type"))
    out = requests.join(known.withColumn("__hit", F.lit(True)), "model_id", "left")
    error = F.when(F.col("__hit").isNull(), "unknown model").when(~F.col("model_type").eqNullSafe(F.col("__type")), "another type of model")
    return out.withColumn("model_error", error).drop("__hit", "__type")


def as_list(value: Column) -> Column:
    """A value of any type as an array of texts: a JSON list's elements, anything else as one; null as none. Elements that are
    lists or objects are JSON."""
    return F.transform(elements(parsed(value.cast("string"))), text_of)


def settings(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """name and value: the override if it is not empty, else the default. Overrides of unknown names go."""
    over = overrides.select("name", F.col("value").alias("__over"))
    return defaults.join(over, "name", "left").select("name", F.when(F.coalesce("__over", F.lit("")) != "", F.col("__over")).otherwise(F.col("value")).alias("value"))


def out_of_memory(message: Column) -> Column:
    """Whether an error says that a device's memory was used up."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return text.contains("npu out of memory") | text.contains("acl_error_rt_memory_allocation")
