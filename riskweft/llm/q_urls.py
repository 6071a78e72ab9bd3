"""op5: every page against dated lists.

Pages carry no fetch time, so one is derived from page_id: a day of 2024. The lists are derived from all pages by digits
of hashes, so they grow with the table: hosts, parents of hosts, and prefixes that end within a segment, at its end or
within a host, added, mostly removed and often added again, some on the very day of the capture.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .urls import host, path, report


def _digit(name: str, i: int) -> Column:
    return F.conv(F.substring(name, i, 1), 16, 10).cast("int")


def list_entries(pages: DataFrame) -> DataFrame:
    """(list, kind, value, action, at) of pages with fetched_at: dates from the hash of the page or of the host."""
    page = pages.select(host(F.col("url")).alias("host"), F.concat(host(F.col("url")), F.lower(path(F.col("url")))).alias("page"), "fetched_at", F.md5(F.coalesce("url", F.lit("")).cast("binary")).alias("h"))
    page = page.where("host <> ''").withColumn("g", F.md5(F.col("host").cast("binary")))
    cut = F.substr("page", F.lit(1), F.greatest(F.length("page") - _digit("h", 2) % 4, F.lit(1)))
    within = F.substr("host", F.lit(1), F.greatest(F.length("host") - 2, F.lit(1)))
    parent = F.substring_index("host", ".", -3)
    seeds = page.where(_digit("h", 1) < 6).select(F.lit("prefix").alias("kind"), cut.alias("value"), "h", "fetched_at")
    seeds = seeds.union(page.where(_digit("g", 1) == 0).select(F.lit("host"), "host", "g", F.lit(None).cast("date")))
    seeds = seeds.union(page.where(_digit("g", 1) == 1).select(F.lit("prefix"), within, "g", F.lit(None).cast("date")))
    seeds = seeds.union(page.where(_digit("g", 1) == 2).select(F.lit("host"), parent, "g", F.lit(None).cast("date"))).distinct()
    day = lambda n: F.date_add(F.col("first"), n)
    first = F.date_add(F.lit("2024-01-01").cast("date"), 20 * _digit("h", 3) + _digit("h", 4))
    dated = seeds.withColumn("first", F.when(_digit("h", 5) < 4, F.coalesce("fetched_at", first)).otherwise(first))
    gone, back = 1 + 4 * _digit("h", 6), 2 + 4 * _digit("h", 6) + 3 * _digit("h", 7)
    moments = [
        F.struct(F.lit("add").alias("action"), F.col("first").alias("at")),
        F.when(_digit("h", 8) < 10, F.struct(F.lit("remove").alias("action"), day(gone).alias("at"))),
        F.when(_digit("h", 8) < 7, F.struct(F.lit("add").alias("action"), day(back).alias("at"))),
    ]
    name = F.concat(F.lit("list"), (_digit("h", 9) % 3).cast("string")).alias("list")
    return dated.select(name, "kind", "value", F.explode(F.array_compact(F.array(*moments))).alias("x")).select("list", "kind", "value", "x.action", "x.at")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    pages = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    return report(pages, list_entries(pages), "page_id")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1)) AS path, DATE '2024-01-01' + (page_id % 366)::INTEGER AS d FROM pages),
q AS (SELECT *, host || path AS page, [strpos('0123456789abcdef', c) - 1 FOR c IN string_split(md5(coalesce(url, '')), '')] AS h, [strpos('0123456789abcdef', c) - 1 FOR c IN string_split(md5(host), '')] AS g FROM p WHERE host <> ''),
s AS (SELECT DISTINCT * FROM (
    SELECT 'prefix' AS kind, substr(page, 1, greatest(length(page) - h[2] % 4, 1)) AS value, h, d FROM q WHERE h[1] < 6
    UNION ALL SELECT 'host', host, g, NULL FROM q WHERE g[1] = 0
    UNION ALL SELECT 'prefix', substr(host, 1, greatest(length(host) - 2, 1)), g, NULL FROM q WHERE g[1] = 1
    UNION ALL SELECT 'host', array_to_string(list_slice(string_split(host, '.'), -3, -1), '.'), g, NULL FROM q WHERE g[1] = 2)),
f AS (SELECT 'list' || h[9] % 3 AS list, kind, value, h, CASE WHEN h[5] < 4 AND d IS NOT NULL THEN d ELSE DATE '2024-01-01' + (20 * h[3] + h[4])::INTEGER END AS first FROM s),
e AS (SELECT list, kind, value, true AS up, first AS day FROM f
    UNION ALL SELECT list, kind, value, false, first + (1 + 4 * h[6])::INTEGER FROM f WHERE h[8] < 10
    UNION ALL SELECT list, kind, value, true, first + (2 + 4 * h[6] + 3 * h[7])::INTEGER FROM f WHERE h[8] < 7),
mo AS (SELECT list, kind, value, day, bool_or(up) AS up FROM e GROUP BY ALL),
ch AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY list, kind, value ORDER BY day), false) AS was FROM mo),
iv AS (SELECT * FROM (SELECT list, kind, value, up, day AS since, lead(day) OVER (PARTITION BY list, kind, value ORDER BY day) AS until FROM ch WHERE up <> was) WHERE up),
m AS (SELECT page_id, url, list, kind, value FROM p JOIN iv ON d >= since AND (until IS NULL OR d < until)
    AND CASE kind WHEN 'host' THEN host = value OR ends_with(host, '.' || value) ELSE starts_with(host || path, value) END)
SELECT p.page_id, any_value(p.host) AS host, count(list) AS n_matches, coalesce(string_agg(DISTINCT list, ',' ORDER BY list), '') AS lists, count(list) > 0 AS blocked
FROM p LEFT JOIN m USING (page_id) GROUP BY p.page_id
"""
