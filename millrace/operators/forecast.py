"""Forecasters: seasonal naive, ridge, boosted trees, seasonal ARIMA, and a tuner."""

from __future__ import annotations

import random
from dataclasses import dataclass, replace
from math import exp, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import Panel


def seasonal_naive(folded: DataFrame, season: int = 12, max_horizon: int | None = None, p: Panel = Panel()) -> DataFrame:
    """Validation rows of all folds with ``actual`` and ``predicted``: the last season before the fold, tiled.

    Step k of a fold repeats the value of season * ceil(k / season) rows before, so up to ``max_horizon``
    steps (a season by default) it is a lag or two. A shorter history, and steps beyond, give
    null. All folds and series go in one plan.
    """
    by = Window.partitionBy("fold", *p.key)
    order = by.orderBy(p.date)
    turns = -(-(max_horizon or season) // season)
    step = F.row_number().over(order) - F.count_if(F.col("role") == "train").over(by)
    turn = F.ceil(step / season)
    predicted = F.coalesce(*[F.when(turn == m, F.lag(p.target, m * season).over(order)) for m in range(1, turns + 1)])
    rows = folded.withColumn("predicted", predicted.cast("double"))
    return rows.where("role = 'validation'").select("fold", *p.key, p.date, F.col(p.target).alias("actual"), "predicted")


def assemble(df: DataFrame, features: list[str], target: str, keep: list[str]) -> DataFrame:
    """``features`` as one vector, rows with a null in one of them left out, and ``label``."""
    from pyspark.ml.feature import VectorAssembler

    df = df.dropna(subset=features).select(*keep, F.col(target).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features if c not in keep])
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit_ridge(train: DataFrame, alpha: float = 1.0):
    """Closed-form ridge with a free intercept on unscaled features.

    Spark's penalty is on the mean loss and the scaled label, so alpha goes in as alpha / n * stddev(label).
    """
    from pyspark.ml.regression import LinearRegression

    n, sd = train.agg(F.count("*"), F.stddev_pop("label")).first()
    return LinearRegression(regParam=alpha / n * (sd or 1.0), elasticNetParam=0.0, standardization=False, solver="normal").fit(train)


@dataclass(frozen=True)
class Boosting:
    """Settings of boosted trees; fields are named for what they do in Spark's GBTRegressor."""

    trees: int = 100
    depth: int = 5
    rate: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    min_rows: int = 1
    min_gain: float = 0.0
    seed: int = 42

    def estimator(self, validation: str | None = None):
        from pyspark.ml.regression import GBTRegressor

        out = GBTRegressor(maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, subsamplingRate=self.rows, featureSubsetStrategy=str(self.columns) if self.columns < 1 else "all", minInstancesPerNode=self.min_rows, minInfoGain=self.min_gain, seed=self.seed)
        return out.setValidationIndicatorCol(validation) if validation else out


#: Level-wise trees, and deeper ones with larger leaves in place of leaf-wise growth, which Spark lacks.
LEVEL_WISE = Boosting()
LEAF_WISE = Boosting(depth=7, min_rows=20)


def fit_boosted(train: DataFrame, how: Boosting = LEVEL_WISE, validation: DataFrame | None = None):
    """With ``validation``, trees stop when its error no longer falls."""
    if validation is None:
        return how.estimator().fit(train)
    both = train.withColumn("_val", F.lit(False)).unionByName(validation.withColumn("_val", F.lit(True)))
    return how.estimator("_val").fit(both)


def importance(model, features: list[str] | None = None) -> DataFrame:
    """``feature``, ``importance``, the largest first; f0, f1, ... without names."""
    from pyspark.sql import SparkSession

    values = model.featureImportances.toArray()
    rows = [(features[i] if features else f"f{i}", float(v)) for i, v in enumerate(values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


#: Search ranges as (kind, low, high, step).
LEVEL_WISE_SPACE = {"trees": ("int", 100, 1000, 100), "depth": ("int", 3, 10, 1), "rate": ("log", 0.01, 0.3, 0), "rows": ("float", 0.6, 1.0, 0), "columns": ("float", 0.6, 1.0, 0)}
LEAF_WISE_SPACE = {"trees": ("int", 100, 1000, 100), "depth": ("int", 3, 10, 1), "rate": ("log", 0.01, 0.3, 0), "rows": ("float", 0.6, 1.0, 0), "min_rows": ("int", 20, 150, 1)}


def _sample(space: dict, rng: random.Random, good: list[dict]) -> dict:
    """A setting: near one of the good trials so far, or anywhere."""
    out = {}
    for name, (kind, lo, hi, step) in space.items():
        a, b = (log(lo), log(hi)) if kind == "log" else (lo, hi)
        x = rng.uniform(a, b)
        if good and rng.random() < 0.75:
            centre = rng.choice(good)[name]
            x = min(b, max(a, rng.gauss(log(centre) if kind == "log" else centre, (b - a) / 5)))
        out[name] = min(hi, lo + round((x - lo) / step) * step) if kind == "int" else exp(x) if kind == "log" else x
    return out


def tune(train: DataFrame, validation: DataFrame, start: Boosting = LEVEL_WISE, space: dict | None = None, trials: int = 50, seed: int = 42) -> tuple[Boosting, DataFrame]:
    """The setting with the least MAPE on ``validation``, and all trials.

    Trials are drawn around the best quarter of those before, with a share drawn anywhere (in the manner of
    tree-structured estimators); the driver holds one row for each trial.
    """
    from pyspark.sql import SparkSession

    from .metrics import mape

    rng, done = random.Random(seed), []
    train, validation = train.cache(), validation.cache()
    for k in range(trials):
        ranked = sorted(done, key=lambda x: x[1])
        good = [s for s, _ in ranked[: max(1, len(ranked) // 4)]] if k >= min(10, trials // 3) else []
        setting = _sample(space or LEVEL_WISE_SPACE, rng, good)
        scored = replace(start, **setting).estimator().fit(train).transform(validation)
        done.append((setting, scored.agg(mape("label", "prediction")).first()[0]))
    best = min(done, key=lambda x: x[1])[0]
    rows = [(k, float(v), str(sorted(s.items()))) for k, (s, v) in enumerate(done)]
    train.unpersist(), validation.unpersist()
    return replace(start, **best), SparkSession.active().createDataFrame(rows, "trial int, mape double, setting string")


def _polynomial(a: np.ndarray, b: np.ndarray, season: int) -> np.ndarray:
    """Coefficients of (1 - a B - ...)(1 - b B^s - ...), without the leading 1, as a recursion's weights."""
    x = np.concatenate([[1.0], -a])
    y = np.zeros(len(b) * season + 1)
    y[0] = 1
    y[season::season] = -b
    return -np.convolve(x, y)[1:]


def _residuals(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Conditional residuals of an ARMA recursion, starting from zeros."""
    u = w - np.convolve(w, np.concatenate([[0.0], ar]))[: len(w)]
    # Seasonal weights are mostly zero, and plain floats are quicker than arrays of one.
    lags = [(j + 1, float(c)) for j, c in enumerate(ma) if c]
    e: list[float] = []
    for t, x in enumerate(u.tolist()):
        for lag, c in lags:
            if lag > t:
                break
            x -= c * e[t - lag]
        e.append(x)
    return np.array(e)


def sarima_forecast(y: np.ndarray, horizon: int, order: tuple[int, int, int] = (1, 1, 1), seasonal: tuple[int, int, int, int] = (1, 1, 1, 12), sweeps: int = 6) -> np.ndarray:
    """Forecasts by the least conditional sum of squares, found by coordinate search.

    ValueError if the history is too short for the differences, or the fit isn't finite.
    """
    (p, d, q), (sp, sd, sq, s) = order, seasonal
    levels = [np.asarray(y, float)]
    for lag in [1] * d + [s] * sd:
        if len(levels[-1]) <= lag:
            raise ValueError("history too short")
        levels.append(levels[-1][lag:] - levels[-1][:-lag])
    w = levels[-1]
    if len(w) < max(p + sp * s, q + sq * s, 2):
        raise ValueError("history too short")

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, e = np.split(x, np.cumsum([p, sp, q]))
        return _polynomial(a, b, s), -_polynomial(c, e, s)

    def loss(x: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            v = float((_residuals(w, *parts(x)) ** 2).sum())
        return v if np.isfinite(v) else float("inf")

    x = np.zeros(p + sp + q + sq)
    best, step = loss(x), 0.4
    for _ in range(sweeps):
        for i in range(len(x)):
            for move in (step, -step):
                z = x.copy()
                z[i] = np.clip(z[i] + move, -0.95, 0.95)
                if (v := loss(z)) < best:
                    x, best = z, v
                    break
        step /= 1.6
    ar, ma = parts(x)
    e = np.concatenate([_residuals(w, ar, ma), np.zeros(horizon)])
    w = w.copy()
    for _ in range(horizon):
        t = len(w)
        k, m = min(t, len(ar)), min(t, len(ma))
        w = np.append(w, (ar[:k] @ w[t - k : t][::-1] if k else 0) + (ma[:m] @ e[t - m : t][::-1] if m else 0))
    out = w[-horizon:]
    for level, lag in reversed(list(zip(levels[:-1], [1] * d + [s] * sd, strict=True))):
        full = list(level)
        for v in out:
            full.append(v + full[-lag])
        out = np.array(full[len(level) :])
    if not np.isfinite(out).all():
        raise ValueError("not finite")
    return out


def sarima(folded: DataFrame, p: Panel = Panel(), order: tuple[int, int, int] = (1, 1, 1), seasonal: tuple[int, int, int, int] = (1, 1, 1, 12)) -> DataFrame:
    """Validation rows of each fold and series with ``predicted`` and ``failed``.

    A series that can't be fitted gets the mean of its training rows, 0 without any. A group is one
    series of one fold, a row for each month.
    """
    import pandas as pd

    key = ["fold", *p.key]
    fields = {f.name: f for f in folded.schema.fields}
    schema = T.StructType([*(fields[k] for k in key), fields[p.date], T.StructField("actual", T.DoubleType()), T.StructField("predicted", T.DoubleType()), T.StructField("failed", T.BooleanType())])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(p.date)
        train, val = g[g["role"] == "train"], g[g["role"] == "validation"]
        y = train[p.target].to_numpy(float)
        try:
            predicted, failed = sarima_forecast(y, len(val), order, seasonal), False
        except (ValueError, np.linalg.LinAlgError):
            predicted, failed = np.full(len(val), y.mean() if len(y) else 0.0), True
        return val[[*key, p.date]].assign(actual=val[p.target].astype(float), predicted=predicted, failed=failed)

    # Fits take long and rows are few, so parts by size would put all fits in one task.
    parts = 2 * folded.sparkSession.sparkContext.defaultParallelism
    return folded.select(*key, p.date, p.target, "role").repartition(parts, *key).groupBy(*key).applyInPandas(run, schema)
