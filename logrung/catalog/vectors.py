"""Queries on vectors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from logrung import fixtures
from logrung.catalog import sql
from logrung.catalog.base import landed, masked_logs, parsed_logs, query
from logrung.operators import cluster as cl
from logrung.operators.embed import embed_messages, fit_embedder, pool_tokens, reduce_dims
from logrung.operators.mixture import bayes_gmm
from logrung.plans.clustering import filter_level


@query(
    "pool_tokens",
    """SELECT vec_id, CAST(d AS INTEGER) AS dim,
        round(sum(CAST(embedding[t * 8 + d + 1] AS DOUBLE) * m) / greatest(sum(m), 1e-9), 6) AS pooled
       FROM (SELECT vec_id, embedding, t, CASE WHEN (vec_id + t) % 3 < 2 THEN 1e0 ELSE 0e0 END AS m
             FROM embeddings, range(8) tt(t)), range(8) dd(d) GROUP BY vec_id, d""",
)
def _(spark, sf):
    flat = fixtures.emb(spark, sf).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    rows = flat.select(
        "vec_id",
        (F.col("pos") % 8).cast("int").alias("dim"),
        F.col("x").cast("double").alias("value"),
        F.when((F.col("vec_id") + F.expr("pos div 8")) % 3 < 2, 1.0).otherwise(0.0).alias("mask"),
    )
    return pool_tokens(rows, "vec_id").withColumn("pooled", F.round("pooled", 6))


# Users in five groups stand in for clusters.
_GROUPS = "grouped AS (SELECT event_id AS row_id, CAST(user_id % 5 AS INTEGER) AS cluster, level, message FROM leveled JOIN events USING (event_id))"
_LEVELED = "leveled AS (SELECT event_id, upper(line_level) AS level, message FROM parsed WHERE message <> '' AND upper(line_level) <> 'UNKNOWN')"
_MAJORITY = """majority AS (SELECT cluster, level AS majority_level, n AS majority_n, size FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first_row) AS place, CAST(sum(n) OVER (PARTITION BY cluster) AS BIGINT) AS size
  FROM (SELECT cluster, level, count(*) AS n, min(row_id) AS first_row FROM grouped GROUP BY 1, 2)) WHERE place = 1)"""
_CLUSTERS = f"{sql.WITH_PARSED}, {_LEVELED}, {_GROUPS}, {_MAJORITY}"


def _grouped(spark, sf):
    users = fixtures.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 5).cast("int").alias("cluster")
    )
    rows = filter_level(parsed_logs(spark, sf), include_unknown=False).join(users, "event_id")
    return rows.select(F.col("event_id").alias("row_id"), "cluster", "level", "message")


@query(
    "cluster_purity",
    f"{_CLUSTERS} SELECT cluster, size, majority_level, majority_n, round(majority_n * 1e2 / size, 6) AS purity_pct FROM majority",
)
def _(spark, sf):
    out = cl.cluster_purity(_grouped(spark, sf)).drop("level_counts")
    return out.withColumn("purity_pct", F.round("purity_pct", 6))


@query("cluster_levels", f"{_CLUSTERS} SELECT cluster, level, count(*) AS n, min(row_id) AS first_row FROM grouped GROUP BY 1, 2")
def _(spark, sf):
    return cl.cluster_levels(_grouped(spark, sf))


@query(
    "cluster_outliers",
    f"""{_CLUSTERS} SELECT row_id, cluster, concat('[Cluster ', CAST(cluster AS VARCHAR), '] Tagged as [', level, ']: ', message) AS outlier
        FROM grouped JOIN majority USING (cluster) WHERE level <> majority_level""",
)
def _(spark, sf):
    return cl.cluster_outliers(_grouped(spark, sf))


_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


@query(
    "cluster_gaussian",
    "SELECT label AS cluster, count(*) AS n, "
    + ", ".join(f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 6) AS mean_{i}" for i in range(3))
    + ", "
    + ", ".join(
        f"round(covar_samp(CAST(embedding[{i + 1}] AS DOUBLE), CAST(embedding[{j + 1}] AS DOUBLE)), 6) AS cov_{i}_{j}"
        for i, j in _PAIRS
    )
    + " FROM embeddings GROUP BY label HAVING count(*) >= 4",
)
def _(spark, sf):
    moments = cl.gaussian_moments(fixtures.emb(spark, sf), "embedding", 3, "label")
    exact = [c for c in moments.columns if c not in ("cluster", "n")]
    return moments.withColumns({c: F.round(c, 6) for c in exact})


@query("cluster_axes")
def _(spark, sf):
    return cl.gaussian_axes(cl.gaussian_moments(fixtures.emb(spark, sf), "embedding", 3, "label"), 3)


# What holds for any eigen decomposition: trace, determinant, unit and orthogonal axes.
@query(
    "cluster_axes_invariants",
    """WITH c AS (SELECT label AS cluster, covar_samp(x, x) AS a, covar_samp(y, y) AS b, covar_samp(z, z) AS c,
           covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f
         FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
         GROUP BY label HAVING count(*) >= 4)
       SELECT cluster, round(a + b + c, 6) AS trace,
         round(1e6 * (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)), 4) AS determinant, 3 AS axes, true AS orthonormal FROM c""",
)
def _(spark, sf):
    found = cl.gaussian_axes(cl.gaussian_moments(fixtures.emb(spark, sf), "embedding", 3, "label"), 3)
    value, axis = F.col("eigenvalues"), F.col("axes")
    add = lambda a, x: a + x
    dot = lambda i, j: F.aggregate(F.zip_with(axis[i], axis[j], lambda x, y: x * y), F.lit(0.0), add)
    off = [F.abs(dot(i, j) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)]
    return found.select(
        "cluster",
        F.round(value[0] + value[1] + value[2], 6).alias("trace"),
        F.round(1e6 * value[0] * value[1] * value[2], 4).alias("determinant"),
        F.size(axis).alias("axes"),
        (F.greatest(*off) < 1e-9).alias("orthonormal"),
    )


@query("pca_reduce")
def _(spark, sf):
    return reduce_dims(fixtures.emb(spark, sf), 100).select("vec_id", "reduced")


# All components together keep the variance, and they are uncorrelated.
@query(
    "pca_variance",
    """SELECT count(*) AS components, round(sum(v), 6) AS variance, CAST(0 AS DOUBLE) AS largest_overlap
       FROM (SELECT var_samp(CAST(x AS DOUBLE)) AS v FROM (
         SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY d)""",
)
def _(spark, sf):
    reduced = landed(reduce_dims(fixtures.emb(spark, sf), 100).select("vec_id", "reduced"), "reduced")
    flat = reduced.select(F.posexplode("reduced").alias("d", "x"))
    variance = flat.groupBy("d").agg(F.var_samp("x").alias("v")).agg(
        F.count("*").alias("components"), F.round(F.sum("v"), 6).alias("variance")
    )
    # Every pair of components, a row for each.
    later = F.posexplode(F.expr("slice(reduced, d + 2, size(reduced))")).alias("e", "y")
    pairs = reduced.select("reduced", F.posexplode("reduced").alias("d", "x")).select("d", "x", later)
    overlap = (
        pairs.groupBy("d", "e")
        .agg(F.abs(F.covar_samp("x", "y")).alias("c"))
        .agg(F.round(F.max("c"), 6).alias("largest_overlap"))
    )
    return variance.withColumn("largest_overlap", overlap.scalar())


@query("bayes_gmm")
def _(spark, sf):
    vectors = landed(reduce_dims(fixtures.emb(spark, sf), 100).select("vec_id", "label", "reduced"), "vectors")
    return bayes_gmm(vectors, n_components=10).select("vec_id", "label", "cluster")


# Signs and buckets by md5, so that both engines draw the same projection.
@query(
    "embed_messages",
    rf"""{sql.WITH_MASKED}, words AS (SELECT event_id, unnest(list_filter(regexp_split_to_array(masked, '\s+'), lambda x: x <> '')) AS w FROM masked),
       hashed AS (SELECT event_id, substr(md5(w), 1, 3) AS bucket, md5('94:0:' || w) AS h FROM words),
       idf AS (SELECT bucket, 1 + ln(((SELECT count(*) FROM masked) + 1) / (count(DISTINCT event_id) + 1e0)) AS f FROM hashed GROUP BY bucket),
       sums AS (SELECT event_id, d, sum(f) AS total, sum(f * (1 - 2 * (((strpos('0123456789abcdef', substr(h, d // 4 + 1, 1)) - 1) >> (3 - d % 4)) & 1))) AS s
         FROM hashed JOIN idf USING (bucket), range(32) r(d) GROUP BY event_id, d),
       flat AS (SELECT event_id, sum(s / total * (d + 1)) AS checksum, sum(s / total * s / total) AS square FROM sums GROUP BY event_id)
       SELECT m.event_id, 32 AS dims, round(coalesce(checksum, 0), 5) + 0e0 AS checksum, round(coalesce(square, 0), 5) AS square
       FROM masked m LEFT JOIN flat ON m.event_id = flat.event_id""",
)
def _(spark, sf):
    rows = landed(masked_logs(spark, sf).select("event_id", F.col("masked").alias("message")), "messages")
    vectors = embed_messages(fit_embedder(rows, size=32), rows)
    weighed = F.zip_with("embedding", F.sequence(F.lit(1), F.lit(32)), lambda x, d: x * d)
    squares = F.transform("embedding", lambda x: x * x)
    add = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    return vectors.select(
        "event_id",
        F.size("embedding").alias("dims"),
        (F.round(add(weighed), 5) + 0.0).alias("checksum"),
        F.round(add(squares), 5).alias("square"),
    )
