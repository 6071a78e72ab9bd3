"""op6: all documents mixed by source."""

from pyspark.sql import DataFrame, SparkSession

from .mixing import BIN_ROWS, MAX_EPOCHS, mix_report

SEED = 17


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), seed=SEED)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    1 - 0.5::DOUBLE * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::DOUBLE / greatest(length(coalesce(text, '')), 1) AS q,
    ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{SEED}'), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / pow(2::DOUBLE, 52) AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
s1 AS (SELECT *, {MAX_EPOCHS}::DOUBLE * s AS cap, {MAX_EPOCHS}::DOUBLE * s / w AS ratio FROM s0),
s2 AS (SELECT *, ((sum(s) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s1),
s3 AS (SELECT source, s, least(cap, w * first_value(CASE WHEN lv <= ratio THEN lv END IGNORE NULLS) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS target FROM s2),
k AS (SELECT doc_id, size, s, target, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS e,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source)
SELECT doc_id, size, s AS source_size, target, (size * (least(e, {MAX_EPOCHS}) + CASE WHEN e < {MAX_EPOCHS} AND before + size / 2::DOUBLE <= target - e * s THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""
