"""op10: all conversations formatted, written, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokes.llm import chat_format
from spokes.llm._text import table
from spokes.storage import save

#: Fixed value: the text of conversation -7.
CONTROL = "\\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return chat_format.digest(save(chat_format.expand(rows.unionByName(extra)), "chat"))


SQL = r"""
WITH extra AS (
  SELECT -7::BIGINT AS conv_id, i::BIGINT AS turn, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END AS role,
         '\### Assistant: </turn> ok' AS text FROM range(2) t(i)),
rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM extra),
sized AS (
  SELECT *,
    16 + length(replace(replace(replace(role, '&', '&a'), '<', '&l'), '>', '&g'))
       + length(replace(replace(replace(text, '&', '&a'), '<', '&l'), '>', '&g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS total
  FROM rows_),
run AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = total)::BIGINT AS formatted_chars
FROM run GROUP BY conv_id
"""
