"""Probability functions as Column expressions; no Python at run time."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rational erf approximation (Abramowitz and Stegun 7.1.26), error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
# Smallest probabilities used under a logarithm.
PROB_FLOOR = 1e-14
DENSITY_FLOOR = 1e-300
# Half width of a 95% interval, the sd below which a point density is used.
Z95 = 1.96
POINT_SD = 0.5
# Five-point Gauss-Hermite rule in standard-normal form.
GH_NODES = [-2.8569700138728056, -1.355626179974266, 0.0, 1.355626179974266, 2.8569700138728056]
GH_WEIGHTS = [0.011257411327720691, 0.2220759220056126, 0.5333333333333333, 0.2220759220056126, 0.011257411327720691]


def erf(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def _erf_series(x: pd.Series) -> pd.Series:
    return x.map(math.erf, na_action="ignore")


def erf_exact(x: Column) -> Column:
    """Full-precision erf in an Arrow batch, for tails the approximation cannot resolve."""
    return F.pandas_udf(_erf_series, "double")(x)


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.lit(math.sqrt(2.0))))


def lognormal_cdf(x: Column, median: Column, sigma: Column) -> Column:
    z = (F.ln(F.nullif(F.greatest(x, F.lit(0.0)), F.lit(0.0))) - F.ln(median)) / sigma
    return F.when(x > 0, normal_cdf(z)).otherwise(F.lit(0.0))


def lognormal_log_pdf(x: Column, median: Column, sigma: Column) -> Column:
    """Log density, null (impossible) for x <= 0."""
    z = (F.ln(x) - F.ln(median)) / sigma
    return F.when(x > 0, -F.ln(x * sigma * math.sqrt(2.0 * math.pi)) - 0.5 * z * z)


def log_interval_prob(lower: Column, upper: Column, median: Column, sigma: Column) -> Column:
    """log(F(upper)-F(lower)) floored at 1e-14; null when the interval is empty."""
    fl = F.when(lower > 0, lognormal_cdf(lower, median, sigma)).otherwise(F.lit(0.0))
    p = F.greatest(F.lit(PROB_FLOOR), lognormal_cdf(upper, median, sigma) - fl)
    return F.when(upper > F.greatest(F.lit(0.0), lower), F.ln(p))


def log_interval_density(center: Column, sd: Column, median: Column, sigma: Column) -> Column:
    """Log of the mean density over a 95% interval, point density when the sd is tiny; null = impossible."""
    lo = F.greatest(F.lit(1e-6), center - Z95 * sd)
    hi = center + Z95 * sd
    p = F.greatest(F.lit(0.0), lognormal_cdf(hi, median, sigma) - lognormal_cdf(lo, median, sigma))
    wide = F.when((hi > 0) & (p > DENSITY_FLOOR), F.ln(p / F.greatest(F.lit(1.0), hi - lo)))
    return F.when(sd < POINT_SD, lognormal_log_pdf(center, median, sigma)).otherwise(wide)


def with_log_interval_density(df: DataFrame, center: str, sd: str, median: Column, sigma: Column, out: str) -> DataFrame:
    """``log_interval_density`` as a column, built in steps.

    Each step is a column of its own, so every logarithm and exponential is computed once
    and the generated code stays small; the one-expression form repeats them in each branch.
    """
    c, s = F.col(center), F.col(sd)
    x = df.withColumns({"__hi": c + Z95 * s, "__lo": F.greatest(F.lit(1e-6), c - Z95 * s), "__mu": F.ln(median), "__sg": sigma})
    tiny = F.lit(1e-300)
    x = x.withColumns({f"__z{k}": (F.ln(F.greatest(F.col(f"__{k}"), tiny)) - F.col("__mu")) / F.col("__sg") / F.lit(math.sqrt(2.0)) for k in ("hi", "lo")})
    x = x.withColumns({f"__t{k}": F.lit(1.0) / (F.lit(1.0) + ERF_P * F.abs(f"__z{k}")) for k in ("hi", "lo")})
    def cdf(k: str) -> Column:
        t, z, poly = F.col(f"__t{k}"), F.col(f"__z{k}"), F.lit(0.0)
        for a in reversed(ERF_A):
            poly = (poly + F.lit(a)) * t
        return F.lit(0.5) * (F.lit(1.0) + F.signum(z) * (F.lit(1.0) - poly * F.exp(-z * z)))
    x = x.withColumns({f"__f{k}": cdf(k) for k in ("hi", "lo")})
    x = x.withColumn("__p", F.greatest(F.lit(0.0), F.when(F.col("__hi") > 0, F.col("__fhi")).otherwise(F.lit(0.0)) - F.col("__flo")))
    wide = F.when((F.col("__hi") > 0) & (F.col("__p") > DENSITY_FLOOR), F.ln(F.col("__p") / F.greatest(F.lit(1.0), F.col("__hi") - F.col("__lo"))))
    x = x.withColumn(out, F.when(s < POINT_SD, lognormal_log_pdf(c, median, sigma)).otherwise(wide))
    return x.drop("__mu", "__sg", "__p", *[f"__{p}{k}" for p in ("", "z", "t", "f") for k in ("hi", "lo")])


def normal_cdf_values(z: np.ndarray) -> np.ndarray:
    """``normal_cdf`` of whole arrays inside a task."""
    z = z / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * np.abs(z))
    poly = np.zeros_like(t)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return 0.5 * (1.0 + np.sign(z) * (1.0 - poly * np.exp(-z * z)))


def log_interval_density_values(center: np.ndarray, sd: np.ndarray, median: float, sigma: float) -> np.ndarray:
    """``log_interval_density`` of whole arrays inside a task; NaN = impossible."""
    hi, lo = center + Z95 * sd, np.maximum(1e-6, center - Z95 * sd)
    cdf = lambda x: normal_cdf_values((np.log(np.maximum(x, 1e-300)) - math.log(median)) / sigma)
    p = np.maximum(0.0, np.where(hi > 0, cdf(hi), 0.0) - cdf(lo))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where((hi > 0) & (p > DENSITY_FLOOR), np.log(p / np.maximum(1.0, hi - lo)), np.nan)
        point = sd < POINT_SD
        if point.any():
            z = (np.log(center) - math.log(median)) / sigma
            out = np.where(point, np.where(center > 0, -np.log(center * sigma * math.sqrt(2.0 * math.pi)) - 0.5 * z * z, np.nan), out)
    return out


def expected_lognormal_cdf(mean: Column, sd: Column, median: Column, sigma: Column) -> Column:
    """E[F(U)] for a Gaussian bound U, by quadrature; exact F when the sd is nil."""
    total = F.lit(0.0)
    for z, w in zip(GH_NODES, GH_WEIGHTS):
        total = total + w * lognormal_cdf(mean + z * sd, median, sigma)
    return F.when(sd <= 1e-9, lognormal_cdf(mean, median, sigma)).otherwise(total)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` with the value computed once for the row."""
    return F.transform(F.array(value), use)[0]


def _components(components: Sequence[tuple[float, float, float]], nodes: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(w * v).alias("w"), F.lit(z).alias("z"), F.lit(math.log(m)).alias("mu"), F.lit(s).alias("sigma")) for w, m, s in components for z, v in nodes])


def _mixture(mean: Column, sd: Column, parts: Column) -> Column:
    """Sum over the parts of w F(mean + z sd), folded in the row so that the generated code stays small."""
    def term(total: Column, c: Column) -> Column:
        x = mean + c["z"] * sd
        z = (F.ln(F.greatest(x, F.lit(1e-300))) - c["mu"]) / c["sigma"]
        return total + F.when(x > 0, c["w"] * _let(z, normal_cdf)).otherwise(0.0)
    return F.aggregate(parts, F.lit(0.0), term)


def mixture_cdf(x: Column, components: Sequence[tuple[float, float, float]]) -> Column:
    """CDF of a mixture of lognormals given as (weight, median, sigma)."""
    return _mixture(x, F.lit(0.0), _components(components, [(0.0, 1.0)]))


def expected_mixture_cdf(mean: Column, sd: Column, components: Sequence[tuple[float, float, float]]) -> Column:
    """E[F(U)] of a mixture for a Gaussian bound U."""
    return F.when(sd <= 1e-9, mixture_cdf(mean, components)).otherwise(_mixture(mean, sd, _components(components, list(zip(GH_NODES, GH_WEIGHTS, strict=True)))))


def expected_mixture_values(mean: np.ndarray, sd: np.ndarray, components: Sequence[tuple[float, float, float]]) -> np.ndarray:
    """``expected_mixture_cdf`` of whole arrays inside a task."""
    total, point = np.zeros(len(mean)), sd <= 1e-9
    for z, v in zip(GH_NODES, GH_WEIGHTS, strict=True):
        x = mean + z * sd
        log, some = np.log(np.maximum(x, 1e-300)), x > 0
        for w, m, s in components:
            total += w * v * np.where(some, normal_cdf_values((log - math.log(m)) / s), 0.0)
    if point.any():
        log = np.log(np.maximum(mean, 1e-300))
        total = np.where(point, sum(w * np.where(mean > 0, normal_cdf_values((log - math.log(m)) / s), 0.0) for w, m, s in components), total)
    return total


def mixture_quantile(components: Sequence[tuple[float, float, float]], q: float, upper: float, steps: int = 70) -> Column:
    """Quantile of a mixture in [0, upper] by bisection, as one expression without columns."""
    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) * 0.5
        below = mixture_cdf(mid, components) < q
        return F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float(upper)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) * 0.5)


def softplus_loss(margin: Column, tau: float) -> Column:
    """log(1+exp(-margin/tau)) without overflow."""
    x = -margin / F.lit(tau)
    return F.when(x > 50, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(50.0)))))


def log_sum_exp(df, keys: list[str], score: str, out: str):
    """Group log-sum-exp as two map-side combined aggregates; null scores count as impossible."""
    top = df.groupBy(*keys).agg(F.max(score).alias("__top"))
    shifted = df.join(top, keys)
    return (shifted.groupBy(*keys)
            .agg((F.max("__top") + F.ln(F.sum(F.exp(F.col(score) - F.col("__top"))))).alias(out)))
