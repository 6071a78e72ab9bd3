"""op11: the vectors of 64 components in 40 clusters, after five rounds."""

from pyspark.sql import DataFrame, SparkSession

from .centroids import cluster, digest

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
_EMPTY = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), K, ROUNDS, DIMS, SCALE, SEED)
    return digest(found) if found else spark.createDataFrame([], _EMPTY)


def _round(r: int, last: bool) -> str:
    """Assignments to the centroids of round r, and from them the next centroids."""
    near = f"""a{r} AS MATERIALIZED (
        SELECT row_id, arg_min(c, (distance, c)) AS c, min(distance) AS distance
        FROM (SELECT v.row_id, m.c, sum((v.x - m.x) * (v.x - m.x)) AS distance FROM v JOIN m{r} m USING (i) GROUP BY v.row_id, m.c) GROUP BY row_id)"""
    if last:
        return near
    return f"""{near}, m{r + 1} AS MATERIALIZED (
        SELECT m.c, m.i, coalesce(n.x, m.x) AS x FROM m{r} m LEFT JOIN
        (SELECT a.c, v.i, CAST(floor(sum(v.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM v JOIN a{r} a USING (row_id) GROUP BY a.c, v.i) n USING (c, i))"""


_ROUNDS = ",\n".join(_round(r, r == ROUNDS) for r in range(ROUNDS + 1))
ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda y: CAST(floor({SCALE} * y::DOUBLE) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {DIMS}),
v AS MATERIALIZED (SELECT row_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM kept),
first AS (SELECT row_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), vec_id, q) - 1 AS c FROM kept QUALIFY c < {K}),
m0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN v USING (row_id)),
{_ROUNDS},
own AS (SELECT c, sum(distance)::BIGINT AS inertia FROM a{ROUNDS} GROUP BY c),
name AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance, own.inertia AS cluster_inertia, (SELECT sum(inertia)::BIGINT FROM own) AS inertia, centroid_sha256
FROM kept JOIN a{ROUNDS} USING (row_id) JOIN own USING (c) JOIN name USING (c)
"""
