"""Queries of chats, shards and values of any type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat, prepare, requests, training_data
from .queries import c, query, table


def _echo(prompt: Column) -> Column:
    """A predictor whose answer depends on the whole prompt."""
    return F.concat(F.lit("answer "), F.substring(F.md5(prompt), 1, 12))


BLOCK = "'<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


@query(f"""WITH RECURSIVE m AS (SELECT conv_id, turn, text AS u, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, k, []::VARCHAR[] AS h, u, 'answer ' || substr(md5({BLOCK}), 1, 12) AS a FROM m WHERE k = 1
UNION ALL SELECT conv_id, turn, k, h, u, 'answer ' || substr(md5(array_to_string(h, '') || {BLOCK}), 1, 12) FROM (
SELECT m.conv_id, m.turn, m.k, list_append(r.h, '<|im_start|>user' || chr(10) || r.u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || r.a || '<|im_end|>' || chr(10))[-10:] AS h, m.u
FROM r JOIN m ON m.conv_id = r.conv_id AND m.k = r.k + 1))
SELECT conv_id, turn, md5(u) AS user, a AS assistant FROM r""")
def chat_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of every conversation, asked anew with the predictor's own answers as history."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", c("text").alias("user"))
    return chat.chat(turns, _echo).select("conv_id", "turn", F.md5("user").alias("user"), "assistant")


EPOCHS, WORLD, SEED = 2, 8, 42


@query(f"""WITH r AS (SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY ('0x' || substr(md5('{SEED}:' || epoch || ':' || doc_id), 1, 15))::BIGINT, doc_id) - 1 AS n, count(*) OVER (PARTITION BY epoch) AS total
FROM documents, (SELECT unnest(range({EPOCHS})) AS epoch)),
p AS (SELECT doc_id, epoch, unnest(range(n, ((total + {WORLD - 1}) // {WORLD}) * {WORLD}, total)) AS pos FROM r)
SELECT epoch, doc_id, pos % {WORLD} AS shard, pos // {WORLD} AS place FROM p""")
def epoch_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt over equal shards, in another order each epoch."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    parts = [training_data.epoch_shards(docs, "doc_id", WORLD, SEED, e).select(F.lit(e).cast("long").alias("epoch"), "doc_id", "shard", "place") for e in range(EPOCHS)]
    return parts[0].union(parts[1])


VALUES = """(SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '["' || lang || '",["' || source || '",[]]]' WHEN 1 THEN '{"url":""}' WHEN 2 THEN '[{}, [" none "]]' WHEN 3 THEN lang WHEN 4 THEN '[' || doc_id || ', null, true]' WHEN 5 THEN '[[{"a":{"b":' || doc_id || '}}]]' END AS v FROM documents)"""


@query(f"""SELECT doc_id, coalesce(CASE WHEN starts_with(v, '[') THEN list_transform(from_json(CASE WHEN starts_with(v, '[') THEN v ELSE '[]' END, '["JSON"]'), lambda x: CASE WHEN json_type(x) = 'NULL' THEN NULL ELSE json_extract_string(x, '$') END) ELSE [v] END[1], '') AS first,
CASE WHEN v IS NULL THEN 0 WHEN starts_with(v, '[') THEN json_array_length(CASE WHEN starts_with(v, '[') THEN v ELSE '[]' END) ELSE 1 END::INT AS n_values, doc_id % 7 NOT IN (2, 6) AS has_files FROM {VALUES}""")
def values_of_any_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files given as text, list, object, lists in lists, or not at all."""
    i = c("doc_id").cast("string")
    kinds = [F.concat(F.lit('["'), c("lang"), F.lit('",["'), c("source"), F.lit('",[]]]')), F.lit('{"url":""}'), F.lit('[{}, [" none "]]'), c("lang"), F.concat(F.lit("["), i, F.lit(", null, true]")), F.concat(F.lit('[[{"a":{"b":'), i, F.lit("}}]]"))]
    value = F.coalesce(*[F.when(c("doc_id") % 7 == k, v) for k, v in enumerate(kinds)])
    docs = table(spark, sf_dir, "documents").select("doc_id", value.alias("v"))
    listed = requests.as_list(c("v"))
    return docs.select("doc_id", F.coalesce(F.get(listed, F.lit(0)), F.lit("")).alias("first"), F.size(listed).alias("n_values"), prepare.has_files(F.array("v")).alias("has_files"))
