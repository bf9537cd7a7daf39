"""Statistics: skewness, Box-Cox λ search, z-scores, correlation, label
codes and chi-square scores (J1-J5, J9-J14, B16, B17).

λ searches are iterative: each round is ONE aggregation over the distinct
values of the column that evaluates a grid of λ candidates as a fixed set of
sum expressions; only the per-λ sums (a few dozen numbers) reach the driver,
which narrows the grid around the best candidate for the next round.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, DoubleType

from lapse.functions.transforms import boxcox, boxcox1p, log_shift, sqrt
from lapse.operators.ordered import value_counts_cumulative
from lapse.session import materialize, ship_by_value, with_scalars

ship_by_value(__name__)

# --- transforms and skewness ---------------------------------------------------


def skew_transforms(df: DataFrame, cols: list[str], shift: float = 0.1) -> DataFrame:
    """Add ``{c}_log`` = ln(x + shift) and ``{c}_sqrt`` columns."""
    out = {}
    for c in cols:
        out[f"{c}_log"] = log_shift(c, shift)
        out[f"{c}_sqrt"] = sqrt(c)
    return df.withColumns(out)


def _moments(c: str, name: str):
    x = F.col(c).cast("double")
    return [F.count(x).alias(f"{name}__n"), F.skewness(x).alias(f"{name}__g1")]


def skewness_report(df: DataFrame, cols: list[str], lambdas: dict[str, float] | None = None,
                    shift: float = 0.1) -> DataFrame:
    """Skewness of each column raw, after ln(x+0.1), sqrt and Box-Cox (J3),
    long form ``(column_name, transform, n, skewness, skewness_adj)``;
    ``skewness`` is the population moment ratio g1, ``skewness_adj`` the
    sample-adjusted G1 (pandas' ``skew``). Box-Cox only where all values
    are positive, at the given or the maximum-likelihood λ. One pass for all
    rows of the report; columns whose λ is searched are stored before, as the
    search reads them several times."""
    lambdas = dict(lambdas or {})
    exprs, names = [], []
    searched = [c for c in dict.fromkeys(cols) if c not in lambdas]
    if searched:
        df = materialize(df.select(*dict.fromkeys(cols)), "skewness_input")
        lambdas |= {c: boxcox_lambda(df, c) if positive else None for c, positive in _all_positive(df, searched).items()}
    for c in cols:
        variants = {"raw": F.col(c), "log": log_shift(c, shift), "sqrt": sqrt(c)}
        if lambdas[c] is not None:
            variants["boxcox"] = boxcox(c, lambdas[c])
        for t, e in variants.items():
            tmp = f"{c}__{t}"
            exprs.append(e.alias(tmp))
            names.append((c, t, tmp))
    wide_src = df.select(*exprs)
    aggs = []
    for _, _, tmp in names:
        aggs += _moments(tmp, tmp)
    wide = wide_src.agg(*aggs)
    rows = []
    for c, t, tmp in names:
        n, g1 = F.col(f"{tmp}__n"), F.col(f"{tmp}__g1")
        adj = g1 * F.sqrt(n * (n - 1)) / (n - 2)
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("transform"),
                             n.alias("n"), g1.alias("skewness"), adj.alias("skewness_adj")))
    return wide.select(F.inline(F.array(*rows)))


def _all_positive(df: DataFrame, cols: list[str]) -> dict[str, bool]:
    """Whether every value of each column is positive; one pass."""
    row = df.agg(*[F.min(c) for c in cols]).first()
    return {c: bool(v > 0) for c, v in zip(cols, row)}


# --- Box-Cox λ by maximum likelihood (J1) ---------------------------------------


def _distinct_counts(df: DataFrame, c: str, offset: float = 0.0, persist: bool = False) -> DataFrame:
    x = (F.col(c).cast("double") + F.lit(offset)).alias("_x")
    vals = df.select(x).where(F.col("_x").isNotNull()).groupBy("_x").agg(F.count("*").alias("_w"))
    return vals.persist(StorageLevel.MEMORY_AND_DISK) if persist else vals


def _llf_sum_exprs(lambdas: list[float]):
    aggs = []
    for i, lam in enumerate(lambdas):
        u = F.col("_d") if lam == 0 else F.expm1(F.lit(float(lam)) * F.col("_d"))
        aggs += [F.sum(F.col("_w") * u).alias(f"a{i}"), F.sum(F.col("_w") * u * u).alias(f"b{i}")]
    return aggs


def _centered(vals: DataFrame, n: float | None = None, s_ln: float | None = None) -> DataFrame:
    """Distinct values with ``_d`` = ln x − ln(geometric mean)."""
    if n is None:
        base = vals.agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.ln("_x")).alias("_sln"))
        j = with_scalars(vals, base)
    else:
        j = vals.withColumns({"_n": F.lit(float(n)), "_sln": F.lit(float(s_ln))})
    return j.withColumn("_d", F.ln("_x") - F.col("_sln") / F.col("_n"))


def _llf(lam: float, n: float, s_ln: float, a: float, b: float) -> float:
    var_u = b / n - (a / n) ** 2
    if not var_u > 0:
        return float("nan")
    ln_var = math.log(var_u) if lam == 0 else 2 * lam * s_ln / n + math.log(var_u) - 2 * math.log(abs(lam))
    return (lam - 1.0) * s_ln - n / 2 * ln_var


def boxcox_llf_grid(df: DataFrame, c: str, lambdas: list[float], offset: float = 0.0) -> DataFrame:
    """Box-Cox log-likelihood for each λ, long form ``(lambda, llf)`` (J1):
    (λ-1)·Σ ln x − n/2 · ln var(y_λ), population variance. One aggregation
    over the distinct values, which are stored, as their mean is taken first.

    Values are scaled by their geometric mean g and y is written through
    ``expm1(λ·(ln x − ln g))``, so the variance is taken of numbers near 0.
    """
    j = _centered(materialize(_distinct_counts(df, c, offset), "distinct_values"))
    row = j.agg(F.first("_n").alias("n"), F.first("_sln").alias("s_ln"), *_llf_sum_exprs(lambdas))
    n, s_ln = F.col("n"), F.col("s_ln")
    items = []
    for i, lam in enumerate(lambdas):
        var_u = F.col(f"b{i}") / n - F.pow(F.col(f"a{i}") / n, 2)
        ln_var = F.ln(var_u) if lam == 0 else \
            F.lit(2 * lam) * s_ln / n + F.ln(var_u) - F.lit(2 * math.log(abs(lam)))
        items.append(F.struct(F.lit(float(lam)).alias("lambda"),
                              (F.lit(lam - 1.0) * s_ln - n / 2 * ln_var).alias("llf")))
    return row.select(F.explode(F.array(*items)).alias("_r")).select("_r.lambda", "_r.llf")


def _grid_search(evaluate, lo=-2.0, hi=2.0, points=41, rounds=4, expand=3):
    """Maximise ``evaluate(grid) -> values`` by grid refinement; the bracket
    grows while the best point sits on its edge (as an unbounded bracketed
    search would walk out of it)."""
    for _ in range(expand + 1):
        grid = list(np.linspace(lo, hi, points))
        vals = evaluate(grid)
        k = int(np.nanargmax(vals))
        if 0 < k < points - 1:
            break
        span = hi - lo
        lo, hi = (lo - span, lo + span / points) if k == 0 else (hi - span / points, hi + span)
    step = (hi - lo) / (points - 1)
    best = grid[k]
    for _ in range(rounds - 1):
        lo, hi = best - step, best + step
        grid = list(np.linspace(lo, hi, points))
        vals = evaluate(grid)
        best = grid[int(np.nanargmax(vals))]
        step = (hi - lo) / (points - 1)
    return float(best)


def boxcox_lambda(df: DataFrame, c: str, offset: float = 0.0, rounds: int = 4) -> float:
    """λ maximising the Box-Cox log-likelihood (J1). Each grid round is one
    aggregation job over the (cached) distinct values."""
    vals = _distinct_counts(df, c, offset, persist=True)
    try:
        b = vals.agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.ln("_x")).alias("s_ln")).first()
        n, s_ln = float(b["n"]), float(b["s_ln"])
        j = _centered(vals, n, s_ln)

        def ev(grid):
            r = j.agg(*_llf_sum_exprs(grid)).first()
            return np.array([_llf(g, n, s_ln, r[f"a{i}"], r[f"b{i}"]) for i, g in enumerate(grid)])
        return _grid_search(ev, rounds=rounds)
    finally:
        vals.unpersist()


# --- Box-Cox λ by probability-plot correlation (J2) -----------------------------

# Coefficients of algorithm AS 241 (Wichura, Applied Statistics 37, 1988), numerators and denominators by ascending power.
_CENTRE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
            4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
           [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
            2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
_SIDE = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
          1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
         [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
_TAIL = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
          2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
         [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile to full double precision (AS 241), vectorised."""
    ratio = lambda ab, r: np.polyval(ab[0][::-1], r) / np.polyval(ab[1][::-1], r)
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    r = np.sqrt(-np.log(np.clip(np.minimum(p, 1 - p), 1e-300, None)))
    far = np.where(r <= 5, ratio(_SIDE, r - 1.6), ratio(_TAIL, r - 5))
    return np.where(np.abs(q) <= 0.425, q * ratio(_CENTRE, 0.180625 - q * q), np.sign(q) * far)


_ENDS = 64  # ranks at either end that are added one by one


def osm_prefix(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the first ``r`` of ``n`` normal order-statistic medians, and of their squares.

    The median of rank i is z(u) at u = (i - 0.3175) / (n + 0.365), other
    values at the two ends. Up to ``_ENDS`` ranks from an end are added one by
    one; the inner ones follow from the integrals of z and z^2 over u, which are
    -phi(z) and Phi(z) - z phi(z), with Euler-Maclaurin corrections, so that the
    sum over any range of ranks is the difference of two prefixes.
    """
    r = np.asarray(r, dtype=np.int64)
    m, ends = n + 0.365, min(_ENDS, n)

    def medians(i):
        u = (i - 0.3175) / m
        u = np.where(i == n, 0.5 ** (1.0 / n), u)
        return norm_ppf(np.where(i == 1, 1 - 0.5 ** (1.0 / n), u))
    head = medians(np.arange(1, ends + 1, dtype=float))
    first, first2 = np.concatenate([[0.0], np.cumsum(head)]), np.concatenate([[0.0], np.cumsum(head * head)])
    if n <= 2 * _ENDS:
        z = medians(np.arange(1, n + 1, dtype=float))
        return np.concatenate([[0.0], np.cumsum(z)])[r], np.concatenate([[0.0], np.cumsum(z * z)])[r]

    def parts(x):
        """Integrals up to rank x, less the first and third derivative terms, of z and of z^2."""
        u = (x - 0.3175) / m
        z = norm_ppf(u)
        phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        d1 = 1 / (phi * m)                                   # dz/di
        d3 = (1 + 2 * z * z) / (phi * m) ** 3                # d3z/di3
        s1 = 2 * z * d1
        s3 = 2 * (z * d3 + 3 * d1 * (z / (phi * m) ** 2))
        return -phi * m - d1 / 24 + 7 * d3 / 5760, m * (u - z * phi) - s1 / 24 + 7 * s3 / 5760
    inner = np.clip(r, ends, n - ends).astype(float)
    lo, lo2 = parts(np.array([ends + 0.5]))
    hi, hi2 = parts(inner + 0.5)
    low = np.minimum(r, ends)
    s, s2 = first[low] + hi - lo, first2[low] + hi2 - lo2
    # ranks beyond n - ends mirror the first ones
    past = np.maximum(r - (n - ends), 0)
    return s - (first[ends] - first[ends - past]), s2 + (first2[ends] - first2[ends - past])


_OSM_SCHEMA = StructType([StructField("s", DoubleType()), StructField("s2", DoubleType())])


@F.pandas_udf(_OSM_SCHEMA)
def _osm_range_sums(before: pd.Series, cnt: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sums of medians and of their squares over ranks before + 1 .. before + cnt."""
    if not len(n):
        return pd.DataFrame({"s": [], "s2": []})
    a, size = before.to_numpy(np.int64), int(n.iloc[0])
    lo, hi = osm_prefix(a, size), osm_prefix(a + cnt.to_numpy(np.int64), size)
    return pd.DataFrame({"s": hi[0] - lo[0], "s2": hi[1] - lo[1]})


def osm_sums(df: DataFrame, c: str, offset: float = 0.0) -> DataFrame:
    """Per distinct value: count ``_w`` and the sum of normal order-statistic
    medians over its ranks ``_s``; plus global n, Σ osm, Σ osm² columns. Each
    value costs two look-ups (:func:`osm_prefix`), however many rows hold it.
    """
    x = (F.col(c).cast("double") + F.lit(offset)).alias("_x")
    cum = value_counts_cumulative(df.select(x), "_x")
    n = cum.agg(F.sum("cnt").alias("_n"))
    sums = with_scalars(cum, n).withColumn("_o", _osm_range_sums("cum_before", "cnt", "_n"))
    sums = sums.select("_x", "cnt", "_n", F.col("_o.s").alias("_s"), F.col("_o.s2").alias("_s2"))
    tot = sums.agg(F.sum("_s").alias("_tot_s"), F.sum("_s2").alias("_tot_s2"))
    return with_scalars(sums, tot).select("_x", F.col("cnt").alias("_w"), "_s", "_n", "_tot_s", "_tot_s2")


def boxcox_ppcc_grid(osm: DataFrame, lambdas: list[float]) -> list[float]:
    """Probability-plot correlation of Box-Cox(x, λ) for each λ (one job)."""
    base = osm.agg(F.sum(F.col("_w") * F.ln("_x")).alias("_sln"))
    j = with_scalars(osm, base).withColumn("_d", F.ln("_x") - F.col("_sln") / F.col("_n"))
    aggs = [F.first("_n").alias("n"), F.first("_tot_s").alias("S"), F.first("_tot_s2").alias("S2")]
    for i, lam in enumerate(lambdas):
        u = F.col("_d") if lam == 0 else F.expm1(F.lit(float(lam)) * F.col("_d"))
        aggs += [F.sum(F.col("_w") * u).alias(f"a{i}"), F.sum(F.col("_w") * u * u).alias(f"b{i}"),
                 F.sum(F.col("_s") * u).alias(f"c{i}")]
    r = j.agg(*aggs).first()
    n, S, S2 = r["n"], r["S"], r["S2"]
    out = []
    for i, lam in enumerate(lambdas):
        a, b, cc = r[f"a{i}"], r[f"b{i}"], r[f"c{i}"]
        num = cc - S * a / n
        den = math.sqrt(max(S2 - S * S / n, 0.0) * max(b - a * a / n, 0.0))
        rho = num / den if den > 0 else float("nan")
        out.append(rho if lam >= 0 else -rho)
    return out


def boxcox_normmax(df: DataFrame, c: str, offset: float = 0.0, rounds: int = 4) -> float:
    """λ maximising the probability-plot correlation (J2), the default of
    the reference's λ estimate used for Recency."""
    osm = osm_sums(df, c, offset).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _grid_search(lambda g: np.array(boxcox_ppcc_grid(osm, list(g))), rounds=rounds)
    finally:
        osm.unpersist()


# --- normalisation ---------------------------------------------------------------


def normalize_rfm(rfm: DataFrame, preset: str = "mixed", lambdas: dict | None = None) -> DataFrame:
    """Transformed R, F, M columns (J4). ``mixed`` reproduces the reference:
    Recency → Box-Cox(1 + x) with λ from the probability-plot search on
    MonetaryValue + 1; Frequency raw; MonetaryValue → Box-Cox at its
    maximum-likelihood λ. ``lambdas`` may pin both λ (keys ``recency``,
    ``monetary``)."""
    if preset != "mixed":
        raise ValueError(preset)
    lam = dict(lambdas or {})
    if "recency" not in lam:
        lam["recency"] = boxcox_normmax(rfm, "MonetaryValue", offset=1.0)
    if "monetary" not in lam:
        lam["monetary"] = boxcox_lambda(rfm, "MonetaryValue")
    return rfm.withColumns({
        "Recency_t": boxcox1p("Recency", lam["recency"]),
        "Frequency_t": F.col("Frequency").cast("double"),
        "MonetaryValue_t": boxcox("MonetaryValue", lam["monetary"]),
    })


def zscore(df: DataFrame, cols: list[str], suffix: str = "_z", ddof: int = 0) -> DataFrame:
    """(x − mean) / σ with population σ (``ddof=0``), as the reference's
    scaler (J5, T15). Means and σ are scalar subqueries."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    st = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[sd(c).alias(f"_s_{c}") for c in cols])
    out = with_scalars(df, st).withColumns({
        f"{c}{suffix}": (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in cols})
    return out.drop(*st.columns)


# --- correlation ------------------------------------------------------------------


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, pairwise complete, long
    form ``(col_a, col_b, corr)`` (J9); one aggregation."""
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
                    if a != b else F.lit(1.0).alias(f"{a}__{b}") for a, b in pairs])
    long = wide.unpivot([], [f"{a}__{b}" for a, b in pairs], "_k", "corr")
    parts = F.split("_k", "__")
    return long.select(parts[0].alias("col_a"), parts[1].alias("col_b"), "corr")


def corr_with(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Correlation of each column with ``target``, ascending."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c)
                    for c in cols + [target]])
    return wide.unpivot([], cols + [target], "column_name", "corr").orderBy("corr")


# --- categorical codes and chi-square ------------------------------------------------


def label_encode(df: DataFrame, cols: list[str], suffix: str = "_code", buckets: int | None = None) -> DataFrame:
    """Replace each column by the 0-based position of its text form among
    the column's sorted distinct texts; NULL becomes the text 'nan' (J12,
    T18). The code tables (one row per distinct value, built for all columns
    in one pass and stored) are joined back; AQE broadcasts them when small."""
    def txt(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    # distinct texts of all columns in one pass over df, stored
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), txt(c).alias("txt")) for c in cols])).alias("x")
    texts = materialize(df.select(pairs).select("x.*").distinct(), "labels")
    codes = value_counts_cumulative(texts, "txt", by=["column_name"], buckets=buckets).select("column_name", "txt", "dense_rank")
    codes = materialize(codes, "label_codes")
    out = df.withColumns({f"_{c}_txt": txt(c) for c in cols})
    for c in cols:
        mine = codes.where(F.col("column_name") == c).select(F.col("txt").alias(f"_{c}_txt"), F.col("dense_rank").alias(f"{c}{suffix}"))
        out = out.join(mine, f"_{c}_txt", "left")
    return out.drop(*[f"_{c}_txt" for c in cols])


@F.pandas_udf(DoubleType())
def _chi2_sf_2(s: pd.Series) -> pd.Series:
    """Upper tail of chi-square with 1 degree of freedom: erfc(sqrt(s/2))."""
    return s.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else float("nan"))


def chi2_scores(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """Chi-square statistic of non-negative features against a class label
    (J14), ``(feature, chi2, p_value)`` sorted by chi2 descending.

    Observed = per-class sums of the feature; expected = class share x total
    sum; chi2 = Σ (O−E)²/E over classes. p-value for two classes (one degree
    of freedom) via erfc on the tiny result.
    """
    src = df.where(F.col(y).isNotNull())
    per = src.groupBy(y).agg(F.count("*").alias("_nc"), *[F.sum(F.col(c).cast("double")).alias(c) for c in cols])
    long = per.unpivot([y, "_nc"], cols, "feature", "_obs")
    tot = long.groupBy("feature").agg(F.sum("_obs").alias("_tot"), F.sum("_nc").alias("_n"))
    j = long.join(tot, "feature").withColumn("_exp", F.col("_nc") / F.col("_n") * F.col("_tot"))
    stat = j.groupBy("feature").agg(
        F.sum(F.pow(F.col("_obs") - F.col("_exp"), 2) / F.col("_exp")).alias("chi2"),
        F.count("*").alias("_k"))
    return (stat.withColumn("p_value", F.when(F.col("_k") == 2, _chi2_sf_2("chi2")))
            .drop("_k").orderBy(F.desc("chi2")))
