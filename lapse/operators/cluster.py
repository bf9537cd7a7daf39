"""Customer clustering and cluster analysis."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.functions.util import fixed_mean
from lapse.operators.stats import normalize_rfm, zscore
from lapse.operators.trees import dealt, gather, stored_block
from lapse.session import materialize, release, ship_by_value, with_scalars

CUSTOMER = "customer_unique_id"
MEASURES = ["Recency", "Frequency", "MonetaryValue"]


def melt(df: DataFrame, ids: list[str], values: list[str], var_name: str = "Attribute",
         value_name: str = "Value") -> DataFrame:
    """Wide → long."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        ids, values, var_name, value_name)


def assign_centers(df: DataFrame, cols: list[str], centers: list[list[float]],
                   out: str = "Cluster") -> DataFrame:
    """Nearest of the given centres by Euclidean distance (J8); ties go to
    the lower index. Adds ``out`` and ``distance``. Centres are literals
    (k x d numbers), evaluated in generated code."""
    j, d = nearest(cols, centers)
    return df.withColumns({out: j, "distance": d})


def distances(cols: list[str], centers: list[list[float]]) -> list[Column]:
    """The Euclidean distance to each centre."""
    out = []
    for c in centers:
        sq = None
        for col_name, v in zip(cols, c):
            term = F.pow(F.col(col_name) - F.lit(float(v)), 2)
            sq = term if sq is None else sq + term
        out.append(F.sqrt(sq))
    return out


def nearest(cols: list[str], centers: list[list[float]]) -> tuple[Column, Column]:
    """Number of the nearest centre (ties: the lower) and the distance to it; NULL for a row with a NULL feature."""
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(j).alias("j")) for j, d in enumerate(distances(cols, centers))]))  # by distance, then number
    return F.when(best["d"].isNotNull(), best["j"]), best["d"]


UNIT = 2 ** 32  # fixed point of scaled features: sums do not depend on the order of partial sums


def _seed_rows(df: DataFrame, cols: list[str], seed: int, rows: int) -> np.ndarray:
    """At most ``rows`` distinct points, first by a seeded hash, on the driver: all that the first centres are drawn from."""
    points = df.select(*cols).distinct().orderBy(F.xxhash64(F.lit(seed), *cols), *cols).limit(rows).collect()
    return np.array([[r[c] for c in cols] for r in points], float).reshape(-1, len(cols))


def first_centers(points: np.ndarray, k: int, seed: int) -> list[list[float]]:
    """k-means++ draws: each next centre with probability by squared distance to the nearest so far (fewer for fewer points)."""
    rng = np.random.default_rng(seed)
    out = [points[rng.integers(len(points))]]
    while len(out) < min(k, len(points)):
        d = np.min([((points - c) ** 2).sum(axis=1) for c in out], axis=0)
        out.append(points[rng.choice(len(points), p=d / d.sum())])
    return [[float(v) for v in c] for c in out]


def _fixed_rows(df: DataFrame, cols: list[str]) -> tuple[DataFrame, bool]:
    """``cols`` and their fixed-point values in a high and a low part ``x{d}h`` * 2^24 + ``x{d}l``, whose sums stay within longs;
    and whether they do (else the high part is zero and the low one a decimal)."""
    fixed = [F.round(F.col(c) * F.lit(float(UNIT))) for c in cols]
    row = df.agg(*[F.max(F.abs(x)).alias(f"m{d}") for d, x in enumerate(fixed)], F.count_if(F.greatest(F.lit(False), *[F.col(c).isNull() for c in cols])).alias("nulls")).first()
    whole = not row["nulls"] and all(v is None or v < 2.0 ** 62 for v in row[:-1])
    parts = [((F.shiftright(x.cast("long"), 24), x.cast("long").bitwiseAND(F.lit(2 ** 24 - 1))) if whole else (F.lit(0), x.cast("decimal(38,0)"))) for x in fixed]
    narrow = [F.col(c).cast("double").alias(c) for c in cols] if whole else [F.col(c) for c in cols]
    return df.select(*narrow, *[v.alias(f"x{d}{h}") for d, pair in enumerate(parts) for v, h in zip(pair, "hl")]), whole


def _blocks(data: DataFrame, cols: list[str], rows: int = 1 << 16) -> tuple[DataFrame, RDD]:
    """The stored table of :func:`_fixed_rows` in blocks, and its blocks: the columns, and the fixed-point parts."""
    names = [f"x{d}{h}" for d in range(len(cols)) for h in "hl"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gather(batches, rows):
            yield stored_block({n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate([*map(str, range(len(cols))), *names])}, b.num_rows)

    ship_by_value(__name__)
    ship_by_value(gather.__module__)
    stored = materialize(data.mapInArrow(pack, "block binary, n long"), "kmeans_blocks")
    return stored, dealt(stored)


def _partial_sums(centers: list[list[list[float]]], names: list[str]):
    """A task's function over blocks: per start of so many centres and cluster the number of rows and the sums of the parts."""
    def run(blocks: Iterator[dict]) -> Iterator[list[np.ndarray]]:
        out = [np.zeros((len(c), 1 + len(names)), np.int64) for c in centers]
        for b in blocks:
            for at in range(0, len(b["0"]), 1 << 14):
                x = [b[str(d)][at:at + (1 << 14)] for d in range(len(names) // 2)]
                parts = [b[n][at:at + (1 << 14)] for n in names]
                for sums, cs in zip(out, centers):
                    j = nearest_of(x, cs)
                    sums[:, 0] += np.bincount(j, minlength=len(cs))
                    for i, v in enumerate(parts):  # parts are below 2^38 and there are at most 2^14 rows: exact in doubles
                        sums[:, 1 + i] += np.bincount(j, v, len(cs)).astype(np.int64)
        yield out

    ship_by_value(__name__)
    return run


def nearest_of(x: list[np.ndarray], centers: list[list[float]]) -> np.ndarray:
    """Numbers of the nearest centres, as :func:`nearest` finds them (ties: the lower), of points given column by column."""
    best, j = None, np.zeros(len(x[0]), np.int64)
    for i, c in enumerate(centers):
        far = None
        for v, m in zip(x, c):
            term = v - m
            term *= term
            far = term if far is None else far + term
        far = np.sqrt(far)
        if best is None:
            best = far
            continue
        j[far < best] = i
        best = np.minimum(best, far)
    return j


def lloyd(df: DataFrame, cols: list[str], starts: dict, max_iter: int = 300) -> dict:
    """Centres of each start (``{name: centres}``) once no row moves: every centre is the mean of its rows, to 2^-32.

    All starts advance in one pass a round over blocks of rows that tasks hold:
    they find distances, pick the nearest centres and add up by numpy, and
    return a row of partial sums for every cluster. Sums are whole numbers of
    2^-32, so a rerun, or a task made again,
    gives the same centres bit for bit. A cluster that loses its last row keeps
    its centre. ``df`` is read twice (once a round where fixed-point values exceed longs): pass a stored table.
    """
    centers, moving, was = {n: [list(c) for c in cs] for n, cs in starts.items()}, list(starts), {}
    data, whole = _fixed_rows(df, cols)
    names = [f"x{d}{h}" for d in range(len(cols)) for h in "hl"]
    stored, blocks = _blocks(data, cols) if whole else (None, None)
    if whole:
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(max_iter):
        if not moving:
            break
        if whole:
            parts = blocks.mapPartitions(_partial_sums([centers[n] for n in moving], names)).collect()  # some numbers a cluster and task
            got = [{"i": i, "j": j, "n": row[0], **dict(zip(names, row[1:]))} for i in range(len(moving)) for j, row in enumerate(sum(p[i] for p in parts).tolist()) if row[0]] if parts else []
        else:
            marks = [F.struct(F.lit(i).alias("i"), nearest(cols, centers[n])[0].alias("j")) for i, n in enumerate(moving)]
            rows = data.select(F.lit(1).alias("n"), *names, F.explode(F.array(*marks)).alias("m")).select("m.*", "n", *names)
            got = rows.groupBy("i", "j").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).collect()
        sums = {n: {} for n in moving}
        for r in got:
            sums[moving[r["i"]]][r["j"]] = (r["n"], [(int(r[f"x{d}h"]) << 24) + int(r[f"x{d}l"]) for d in range(len(cols))])
        still = []
        for n in moving:
            for j, (size, s) in sums[n].items():
                centers[n][j] = [v / size / UNIT for v in s]
            if was.get(n) != sums[n]:
                still.append(n)
            was[n] = sums[n]
        moving = still
    if whole:
        blocks.unpersist()
        release(stored)
    return centers


def kmeans_labels(df: DataFrame, cols: list[str], k: int = 4, seed: int = 42,
                  rank_by: str = "MonetaryValue", out: str = "Cluster", max_iter: int = 300, sample: int = 10_000):
    """k-means on ``cols`` (J7): first centres drawn from at most ``sample`` seeded points, then :func:`lloyd`.
    Cluster ids are renumbered 0..k-1 by descending mean of ``rank_by`` so that
    they are stable across runs. Returns ``(labelled frame, centres by id)``."""
    data = materialize(df, "kmeans")
    points = _seed_rows(data, cols, seed, sample)
    if not len(points):
        return df.withColumn(out, F.lit(None).cast("int")), []
    centers = lloyd(data, cols, {k: first_centers(points, k, seed)}, max_iter)[k]
    lab = data.withColumn("_raw", nearest(cols, centers)[0])
    # k cluster means (k numbers, like the k centres) decide the new ids
    means = {r["_raw"]: r["_m"] for r in lab.groupBy("_raw").agg(fixed_mean(rank_by).alias("_m")).collect()}
    order = sorted(range(len(centers)), key=lambda j: (-(means.get(j) if means.get(j) is not None else float("-inf")), j))
    mapping = F.create_map(*[x for i, j in enumerate(order) for x in (F.lit(j), F.lit(i))])
    return lab.withColumn(out, F.element_at(mapping, F.col("_raw")).cast("int")).drop("_raw"), [centers[j] for j in order]


def elbow(df: DataFrame, cols: list[str], ks=range(1, 10), seed: int = 42, sample: int = 10_000) -> DataFrame:
    """``k``, ``sse``, ``distortion`` (mean distance to the nearest centre), ``drift`` (largest distance
    of a centre from the mean of its rows) for each k (J6); all k in one :func:`lloyd`, then one aggregation."""
    data = materialize(df.select(*cols), "elbow")
    points = _seed_rows(data, cols, seed, sample)
    schema = "k int, sse double, distortion double, drift double"
    if not len(points):
        return df.sparkSession.createDataFrame([], schema)
    centers = lloyd(data, cols, {k: first_centers(points, k, seed) for k in ks})
    marks = []
    for k in ks:
        j, d = nearest(cols, centers[k])
        marks.append(F.struct(F.lit(k).alias("k"), j.alias("j"), d.alias("d")))
    each = data.select(*cols, F.explode(F.array(*marks)).alias("m"))
    per = each.groupBy("m.k", "m.j").agg(F.count("*").alias("n"), F.sum(F.col("m.d") * F.col("m.d")).alias("sse"), F.sum("m.d").alias("dist"),
                                         *[F.avg(c).alias(f"mean{i}") for i, c in enumerate(cols)]).collect()
    rows = []
    for k in ks:
        mine = [r for r in per if r["k"] == k]
        drift = max(math.dist(centers[k][r["j"]], [r[f"mean{i}"] for i in range(len(cols))]) for r in mine)
        rows.append((int(k), math.fsum(r["sse"] for r in mine), math.fsum(r["dist"] for r in mine) / sum(r["n"] for r in mine), drift))
    release(data)
    return df.sparkSession.createDataFrame(rows, schema)


def cluster_customers(rfm: DataFrame, k: int = 4, seed: int = 42, lambdas: dict | None = None,
                      materialize_mode: str | None = "table") -> DataFrame:
    """RFM customers with transformed, z-scored features and a cluster id
    (G6 = J4 + J5 + J7).

    The λ searches and the k-means iterations each read the RFM table many
    times, so it is materialised first (customer grain), and the scaled
    features again before fitting."""
    if materialize_mode:
        rfm = materialize(rfm, "rfm", materialize_mode)
    t = normalize_rfm(rfm, lambdas=lambdas)
    tcols = ["Recency_t", "Frequency_t", "MonetaryValue_t"]
    z = zscore(t, tcols)
    if materialize_mode:
        z = materialize(z, "rfm_scaled", materialize_mode)
    zcols = [f"{c}_z" for c in tcols]
    lab, _ = kmeans_labels(z, zcols, k, seed)
    return lab


def _mean(c, exact_digits):
    return fixed_mean(c, exact_digits) if exact_digits is not None else F.avg(c)


def cluster_profile(df: DataFrame, cluster: str = "Cluster", cols=MEASURES,
                    exact_digits: int | None = 6) -> DataFrame:
    """Mean of each measure and customer count per cluster (E12). RFM
    measures are exact at 6 decimals (days, counts, money), so means are
    taken in fixed point (``exact_digits=None`` for a plain float mean)."""
    return df.groupBy(cluster).agg(*[_mean(c, exact_digits).alias(f"mean_{c}") for c in cols],
                                   F.count("*").alias("Count"))


def relative_importance(df: DataFrame, cluster: str = "Cluster", cols=MEASURES,
                        population: str = "all", key: str = CUSTOMER,
                        exact_digits: int | None = 6) -> DataFrame:
    """Cluster mean ÷ population mean − 1 per measure.

    ``population='all'`` uses every row; ``'first5'`` the five rows with
    the smallest key, as the reference's ``head()`` did (T14)."""
    pop_src = df if population == "all" else df.orderBy(key).limit(5)
    pop = pop_src.agg(*[_mean(c, exact_digits).alias(f"_p_{c}") for c in cols])
    cl = df.groupBy(cluster).agg(*[_mean(c, exact_digits).alias(f"_c_{c}") for c in cols])
    return with_scalars(cl, pop).select(
        cluster, *[(F.col(f"_c_{c}") / F.col(f"_p_{c}") - 1).alias(c) for c in cols])


def cluster_lines(melted: DataFrame, cluster: str = "Cluster", var: str = "Attribute",
                  value: str = "Value") -> DataFrame:
    """Mean value per cluster and attribute of a melted table."""
    return melted.groupBy(cluster, var).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
