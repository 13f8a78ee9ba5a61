"""Forecast metrics and paired significance tests."""

from __future__ import annotations

from math import exp, inf, isnan, lgamma, log, log1p, nan, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rmse(y: str = "actual", p: str = "predicted") -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), F.lit(2.0))))


def mae(y: str = "actual", p: str = "predicted") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)).cast("double"))


def mape(y: str = "actual", p: str = "predicted") -> Column:
    """Percent over the rows whose actual isn't 0; 0 if there are none."""
    a = F.col(y)
    return F.coalesce(F.lit(100.0) * F.avg(F.when(a != 0, F.abs((a - F.col(p)) / a))), F.lit(0.0))


def evaluate(df: DataFrame, by: list[str], y: str = "actual", p: str = "predicted") -> DataFrame:
    """All three metrics of each group, in one aggregate."""
    return df.groupBy(*by).agg(rmse(y, p).alias("rmse"), mae(y, p).alias("mae"), mape(y, p).alias("mape"))


def long_form(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.unpivot(by, ["rmse", "mae", "mape"], "metric", "value")


def across_folds(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each metric over folds."""
    by = by or []
    out = long_form(scores, [*by, "fold"]).groupBy(*by, "metric")
    return out.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def compare(scores: DataFrame) -> DataFrame:
    """Mean of each metric by model."""
    return scores.groupBy("model").agg(*[F.avg(m).alias(m) for m in ("rmse", "mae", "mape")])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    if isnan(t):
        return nan
    if t in (inf, -inf):
        return float(t > 0)
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return tail if t < 0 else 1 - tail


def t_quantile(q: float, df: float) -> float:
    if not 0 < q < 1:
        return inf if q >= 1 else -inf
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > q:
        lo *= 2
    while t_cdf(hi, df) < q:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < q else (lo, mid)
    return (lo + hi) / 2


def paired_ttest(df: DataFrame, baseline: str, other: str, alpha: float = 0.05, alternative: str = "less") -> dict:
    """Test of other - baseline over the rows where both are there. One row comes to the driver.

    Deviations of the two are population ones; the interval has level 1 - alpha and is one-sided for
    'less' and 'greater'. Equal columns give p = nan and no rejection; a constant non-zero difference an infinite t.
    """
    if alternative not in ("less", "greater", "two-sided"):
        raise ValueError(alternative)
    d = F.col(other) - F.col(baseline)
    r = df.dropna(subset=[baseline, other]).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.avg(baseline).alias("bm"), F.stddev_pop(baseline).alias("bs"), F.avg(other).alias("om"), F.stddev_pop(other).alias("os")).first()
    n, m, s = r["n"], r["m"], r["s"]
    if n < 2:
        raise ValueError("two pairs are needed at least")
    se, k = s / sqrt(n), n - 1
    t = m / se if se > 0 else (nan if m == 0 else inf if m > 0 else -inf)
    below = t_cdf(t, k)
    p = {"less": below, "greater": 1 - below, "two-sided": 2 * min(below, 1 - below) if not isnan(below) else nan}[alternative]
    if alternative == "two-sided":
        q = t_quantile(1 - alpha / 2, k)
        ci = (m - q * se, m + q * se)
    else:
        q = t_quantile(1 - alpha, k)
        ci = (-inf, m + q * se) if alternative == "less" else (m - q * se, inf)
    return {"t_statistic": t, "p_value": p, "reject_null": bool(p < alpha), "baseline_mean": r["bm"], "baseline_std": r["bs"], "alternative_mean": r["om"], "alternative_std": r["os"], "ci_lower": ci[0], "ci_upper": ci[1]}


def report(test: dict, baseline: str, other: str, metric: str = "RMSE", alpha: float = 0.05) -> str:
    said = f"{other} is better than {baseline}" if test["reject_null"] else f"no evidence that {other} is better than {baseline}"
    return "\n".join([
        f"Paired t-test on {metric}: {other} against {baseline}",
        f"  {baseline}: {test['baseline_mean']:.4f} (std {test['baseline_std']:.4f})",
        f"  {other}: {test['alternative_mean']:.4f} (std {test['alternative_std']:.4f})",
        f"  t = {test['t_statistic']:.4f}, p = {test['p_value']:.4f}, {100 * (1 - alpha):g}% CI [{test['ci_lower']:.4f}, {test['ci_upper']:.4f}]",
        f"  Conclusion at alpha = {alpha:g}: {'reject' if test['reject_null'] else 'do not reject'} the null hypothesis; {said}.",
    ])
