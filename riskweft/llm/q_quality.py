"""op2: quality rules over all documents, hosts being their sources."""

from pyspark.sql import DataFrame, SparkSession

from .quality import quality_rules

MAX_DOCS, MIN_LEFT = 20, 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_docs=MAX_DOCS, min_left=MIN_LEFT)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
repw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
wl AS (SELECT doc_id, source, line, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM wl GROUP BY doc_id),
freq AS (SELECT source, k, count(DISTINCT doc_id) AS docs FROM wl GROUP BY ALL),
share AS (SELECT doc_id, sum(CASE WHEN docs > {MAX_DOCS} THEN 0 ELSE n END) / sum(n)::DOUBLE AS s FROM wl JOIN freq ON wl.source IS NOT DISTINCT FROM freq.source AND wl.k = freq.k GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repw.n, 0)::BIGINT AS n_repeat_words, coalesce(s, 1.0) AS s
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repw USING (doc_id) LEFT JOIN share USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND s >= {MIN_LEFT}) AS kept
FROM base
"""
