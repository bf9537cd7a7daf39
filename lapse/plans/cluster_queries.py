"""Registered queries: clustering and cluster analysis.

SQL-checked variants use clusters given by the nearest of fixed centres on
z-scored RFM measures (J8), which SQL can reproduce; the k-means variants
are checked by rows and by invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapse.operators import cluster as cl
from lapse.operators import rfm as rf
from lapse.operators import stats as st
from lapse.plans.memo import fingerprint, memo
from lapse.plans.registry import register
from lapse.plans.rfm_queries import rfm_frames, rfm_sql
from lapse.session import materialize

R6 = 6
ZCOLS = ["Recency_z", "Frequency_z", "MonetaryValue_z"]
# Fixed parameters: four centres in z-score space for the SQL-checked
# cluster analyses.
FIXED_CENTERS = [[-1.0, -0.5, -0.5], [0.0, 0.0, 0.0], [1.0, 0.5, 0.5], [0.5, -1.0, 1.0]]


def fixed_clusters(spark, sf_dir):
    r = rfm_frames(spark, sf_dir)[1]
    z = st.zscore(r, rf.MEASURES)
    return cl.assign_centers(z, ZCOLS, FIXED_CENTERS)


def _dist_sql(j, c):
    return "sqrt(" + " + ".join(f"pow({z} - ({v}), 2)" for z, v in zip(ZCOLS, c)) + f") AS d{j}"


def _argmin_sql(k):
    parts = []
    for j in range(k - 1):
        cond = " AND ".join(f"d{j} <= d{m}" for m in range(j + 1, k))
        parts.append(f"WHEN {cond} THEN {j}")
    return "CASE " + " ".join(parts) + f" ELSE {k - 1} END"


CLUSTER_CTES = [
    ("zz", "SELECT *, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}_z" for c in rf.MEASURES) + " FROM rfm"),
    ("dd", "SELECT *, " + ", ".join(_dist_sql(j, c) for j, c in enumerate(FIXED_CENTERS)) + " FROM zz"),
    ("cl", f"SELECT *, CAST({_argmin_sql(len(FIXED_CENTERS))} AS INTEGER) AS Cluster, "
           f"least({', '.join(f'd{j}' for j in range(len(FIXED_CENTERS)))}) AS distance FROM dd"),
]


def cl_sql(final, extra=None):
    return rfm_sql(final, "notebook", CLUSTER_CTES + (extra or []))


@register("assign_centers", cl_sql("SELECT customer_unique_id, Cluster, round(distance, 6) AS distance FROM cl"))
def q_assign_centers(spark, sf_dir):
    return fixed_clusters(spark, sf_dir).select("customer_unique_id", "Cluster", F.round("distance", R6).alias("distance"))


def _fm(c):
    """Fixed-point mean, the SQL twin of ``fixed_mean``."""
    return f"CAST(sum(CAST(round({c} * 1000000.0) AS BIGINT)) AS DOUBLE) / count({c}) / 1000000.0"


@register("cluster_profile", cl_sql("SELECT Cluster, " + ", ".join(f"round({_fm(c)}, 6) AS mean_{c}" for c in rf.MEASURES)
                                    + ", CAST(count(*) AS BIGINT) AS Count FROM cl GROUP BY Cluster"))
def q_cluster_profile(spark, sf_dir):
    p = cl.cluster_profile(fixed_clusters(spark, sf_dir))
    return p.select("Cluster", *[F.round(f"mean_{c}", R6).alias(f"mean_{c}") for c in rf.MEASURES], "Count")


@register("relative_importance", cl_sql(
    "SELECT Cluster, " + ", ".join(f"round({_fm(c)} / (SELECT {_fm(c)} FROM cl) - 1, 6) AS {c}" for c in rf.MEASURES)
    + " FROM cl GROUP BY Cluster"))
def q_relative_importance(spark, sf_dir):
    r = cl.relative_importance(fixed_clusters(spark, sf_dir))
    return r.select("Cluster", *[F.round(c, R6).alias(c) for c in rf.MEASURES])


@register("relative_importance_first5", cl_sql(
    "SELECT Cluster, " + ", ".join(f"round({_fm(c)} / (SELECT {_fm(c)} FROM (SELECT * FROM cl ORDER BY customer_unique_id LIMIT 5)) - 1, 6) AS {c}"
                                   for c in rf.MEASURES) + " FROM cl GROUP BY Cluster"))
def q_relative_importance_first5(spark, sf_dir):
    r = cl.relative_importance(fixed_clusters(spark, sf_dir), population="first5")
    return r.select("Cluster", *[F.round(c, R6).alias(c) for c in rf.MEASURES])


MELT_SQL = " UNION ALL ".join(f"SELECT customer_unique_id, Cluster, '{c}' AS Attribute, {c}_z AS Value FROM cl" for c in rf.MEASURES)


@register("melt_rfm", cl_sql(f"SELECT customer_unique_id, Cluster, Attribute, round(Value, 6) AS Value FROM ({MELT_SQL})"))
def q_melt_rfm(spark, sf_dir):
    z = fixed_clusters(spark, sf_dir).select("customer_unique_id", "Cluster", *[F.col(f"{c}_z").alias(c) for c in rf.MEASURES])
    m = cl.melt(z, ["customer_unique_id", "Cluster"], rf.MEASURES)
    return m.withColumn("Value", F.round("Value", R6))


@register("cluster_lines", cl_sql(f"SELECT Cluster, Attribute, round(avg(Value), 6) AS mean_value, CAST(count(*) AS BIGINT) AS n "
                                  f"FROM ({MELT_SQL}) GROUP BY Cluster, Attribute"))
def q_cluster_lines(spark, sf_dir):
    z = fixed_clusters(spark, sf_dir).select("customer_unique_id", "Cluster", *[F.col(f"{c}_z").alias(c) for c in rf.MEASURES])
    lines = cl.cluster_lines(cl.melt(z, ["customer_unique_id", "Cluster"], rf.MEASURES))
    return lines.withColumn("mean_value", F.round("mean_value", R6))


@register("cluster_share", cl_sql(
    f"SELECT Cluster, CAST(count(*) / 3 AS BIGINT) AS Count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent "
    f"FROM ({MELT_SQL}) GROUP BY Cluster"))
def q_cluster_share(spark, sf_dir):
    """Shares counted on the melted table, dividing out the 3 attributes."""
    z = fixed_clusters(spark, sf_dir).select("customer_unique_id", "Cluster", *[F.col(f"{c}_z").alias(c) for c in rf.MEASURES])
    s = rf.group_share(cl.melt(z, ["customer_unique_id", "Cluster"], rf.MEASURES), ["Cluster"], divide_by=3)
    return s.withColumn("percent", F.round("percent", R6))


@register("cluster_combo_share", cl_sql(
    "SELECT Cluster, Segment, Score, Count, round(percent, 6) AS percent FROM (SELECT Cluster, Segment, Score, CAST(count(*) AS BIGINT) AS Count, "
    "count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM cl GROUP BY Cluster, Segment, Score)"))
def q_cluster_combo_share(spark, sf_dir):
    s = rf.group_share(fixed_clusters(spark, sf_dir), ["Cluster", "Segment", "Score"])
    return s.withColumn("percent", F.round("percent", R6))


@register("cluster_hierarchy", cl_sql(
    "SELECT Cluster, Segment, Score, CAST(count(*) AS BIGINT) AS Count, CAST(GROUPING(Cluster, Segment, Score) AS BIGINT) AS level_id "
    "FROM cl GROUP BY ROLLUP (Cluster, Segment, Score)"))
def q_cluster_hierarchy(spark, sf_dir):
    return rf.segment_hierarchy(fixed_clusters(spark, sf_dir))


@register("elbow_k1", cl_sql("SELECT 1 AS k, round(sum(pow(Recency_z, 2) + pow(Frequency_z, 2) + pow(MonetaryValue_z, 2)), 4) AS sse, "
                             "round(avg(sqrt(pow(Recency_z, 2) + pow(Frequency_z, 2) + pow(MonetaryValue_z, 2))), 6) AS distortion FROM zz"))
def q_elbow_k1(spark, sf_dir):
    z = st.zscore(rfm_frames(spark, sf_dir)[1], rf.MEASURES)
    e = cl.elbow(z, ZCOLS, ks=[1])
    return e.select("k", F.round("sse", 4).alias("sse"), F.round("distortion", R6).alias("distortion"))


_SCALED = ["Recency_t_z", "Frequency_t_z", "MonetaryValue_t_z"]


def clustered(spark, sf_dir):
    return memo(spark, ("clustered", fingerprint(sf_dir)), lambda: materialize(cl.cluster_customers(rfm_frames(spark, sf_dir)[1]), "clustered"))


@register("elbow")
def q_elbow(spark, sf_dir):
    """k = 1..9 on the clustering features (rows-only; ``elbow_checks`` holds what must be true of them)."""
    return cl.elbow(clustered(spark, sf_dir), _SCALED).drop("drift")


@register("elbow_checks", cl_sql("SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS k, CAST(0 AS DOUBLE) AS drift, true AS falls, CAST(3 * n AS DOUBLE) AS sse_of_one FROM (SELECT count(*) AS n FROM rfm)"))
def q_elbow_checks(spark, sf_dir):
    """Each k: centres are the means of their rows; SSE does not rise with k; k = 1 gives rows x features, as features are z-scores."""
    e = cl.elbow(clustered(spark, sf_dir), _SCALED)
    before = F.lag("sse").over(Window.orderBy("k"))  # nine rows
    return e.select("k", F.round("drift", R6).alias("drift"), (F.coalesce(before, F.col("sse")) >= F.col("sse")).alias("falls"),
                    F.round(F.first("sse").over(Window.orderBy("k")), R6).alias("sse_of_one"))


@register("cluster_customers")
def q_cluster_customers(spark, sf_dir):
    """k-means (k = 4, seed 42) on the mixed-normalised RFM features."""
    return clustered(spark, sf_dir).select("customer_unique_id", "Recency", "Frequency", "MonetaryValue", "Segment", "Score", "Cluster")


@register("cluster_customers_checks", cl_sql("SELECT customer_unique_id, true AS own_is_nearest, CAST(0 AS DOUBLE) AS rank_gap FROM rfm"))
def q_cluster_customers_checks(spark, sf_dir):
    """Each customer: the mean of their own cluster is the nearest of the four, and cluster ids fall with mean monetary value."""
    c = clustered(spark, sf_dir)
    means = c.groupBy("Cluster").agg(*[F.avg(x).alias(x) for x in _SCALED], F.avg("MonetaryValue").alias("money")).orderBy("Cluster").collect()
    at, d = cl.nearest(_SCALED, [[r[x] for x in _SCALED] for r in means])
    own = F.element_at(F.array(*[F.lit(i) for i in range(len(means))]), F.col("Cluster") + 1)
    gap = max([0.0] + [b["money"] - a["money"] for a, b in zip(means, means[1:])])
    return c.select("customer_unique_id", (at == own).alias("own_is_nearest"), F.lit(float(gap)).alias("rank_gap"))


@register("cluster_profile_kmeans")
def q_cluster_profile_kmeans(spark, sf_dir):
    return cl.cluster_profile(clustered(spark, sf_dir))
