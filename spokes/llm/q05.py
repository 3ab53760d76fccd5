"""op5: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokes.llm import quality_rules
from spokes.llm._text import table

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(*COLUMNS)


SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS k FROM win) WHERE k > 1),
cover AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cover USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
    n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 10 // greatest(n_words, 1) AS length
  FROM base),
long AS (
  SELECT lang, source, 'symbols' AS feature, symbols AS bin FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_lines', dup_lines FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeats', repeats FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'length', length FROM f WHERE NOT base_failed),
own AS (SELECT lang, source, feature, count(*) AS total, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM long GROUP BY ALL),
by_lang AS (SELECT lang, feature, count(*) AS total, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM long GROUP BY ALL),
by_all AS (SELECT feature, count(*) AS total, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM long GROUP BY ALL),
pick AS (
  SELECT o.lang, o.source, o.feature,
    CASE WHEN o.total >= 50 THEN o.q1 WHEN l.total >= 50 THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN o.total >= 50 THEN o.q3 WHEN l.total >= 50 THEN l.q3 ELSE a.q3 END AS q3,
    CASE o.feature WHEN 'symbols' THEN 30 WHEN 'dup_lines' THEN 400 WHEN 'repeats' THEN 140 ELSE 15 END AS slack
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.feature = l.feature JOIN by_all a ON o.feature = a.feature),
cut AS (
  SELECT lang, source,
    max(q3 + 4 * (q3 - q1) + slack) FILTER (feature = 'symbols') AS symbols_high,
    max(q3 + 4 * (q3 - q1) + slack) FILTER (feature = 'dup_lines') AS dup_high,
    max(q3 + 4 * (q3 - q1) + slack) FILTER (feature = 'repeats') AS repeats_high,
    max(q3 + 4 * (q3 - q1) + slack) FILTER (feature = 'length') AS length_high,
    max(q1 - 4 * (q3 - q1) - slack) FILTER (feature = 'length') AS length_low
  FROM pick GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= symbols_high AND dup_lines <= dup_high AND repeats <= repeats_high
    AND length <= length_high AND length >= length_low, false) AS kept
FROM f LEFT JOIN cut ON f.lang IS NOT DISTINCT FROM cut.lang AND f.source IS NOT DISTINCT FROM cut.source
"""
