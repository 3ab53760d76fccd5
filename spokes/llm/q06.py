"""op6: benchmark items in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokes.llm import decontaminate
from spokes.llm._text import table


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH norm AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT kind, id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]', '', 'g'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM norm),
s AS (
  SELECT kind, id, n, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, len(w) AS n, unnest(range(1, len(w) - 3)) AS i FROM w)),
d AS (SELECT id AS doc_id, n AS total, pos, s FROM s WHERE kind = 0),
b AS (SELECT id AS item_id, n, pos AS q, s FROM s WHERE kind = 1),
hits AS (SELECT DISTINCT doc_id, item_id, n, total, pos FROM d JOIN b USING (s)),
tries AS (
  SELECT DISTINCT doc_id, item_id, n, unnest(range(greatest(0, pos - (n - 5)), least(pos, greatest(0, total - n)) + 1)) AS start FROM hits),
win AS (
  SELECT doc_id, item_id, start, s, count(*) AS k FROM tries JOIN d USING (doc_id)
  WHERE pos >= start AND pos <= start + n - 5 GROUP BY ALL),
item AS (SELECT item_id, s, count(*) AS k FROM b GROUP BY ALL),
common AS (
  SELECT doc_id, win.item_id, start, sum(win.k) AS a, sum(least(win.k, coalesce(item.k, 0))) AS i
  FROM win LEFT JOIN item ON win.item_id = item.item_id AND win.s = item.s GROUP BY ALL),
scored AS (
  SELECT doc_id, common.item_id, start, i * 1000 // (a + z.k - i) AS similarity
  FROM common JOIN (SELECT item_id, sum(k) AS k FROM item GROUP BY ALL) z ON common.item_id = z.item_id
  WHERE 5 * i >= 4 * (a + z.k - i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM scored)
SELECT doc_id, item_id, start::BIGINT AS start_word, similarity::BIGINT AS similarity FROM ranked WHERE r = 1
"""
