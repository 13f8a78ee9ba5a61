"""Features of a panel: calendar, seasons, lags, rolling windows, encodings, shares."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..config import DEFAULTS, Panel
from ..operators.panel import ratio


def flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def calendar(df: DataFrame, date: str = "date", c: dict = DEFAULTS) -> DataFrame:
    """Month, quarter, year, the month on a circle, regime flags, and months to the anchor month."""
    m = F.month(date)
    lo, hi = (F.lit(x).cast("date") for x in c["regime"])
    return df.withColumns({
        "month": m,
        "quarter": F.quarter(date),
        "year": F.year(date),
        "month_sin": F.sin(F.lit(2 * pi) * m / 12),
        "month_cos": F.cos(F.lit(2 * pi) * m / 12),
        "covid_period": flag(F.col(date).between(lo, hi)),
        "post_covid": flag(F.col(date) >= F.lit(c["after_regime"]).cast("date")),
        "is_march": flag(m == c["peak_month"]),
        "off_season": flag(m.isin(*c["off_season"])),
        "months_to_hunting": F.pmod(F.lit(c["anchor_month"]) - m, F.lit(12)).cast("int"),
    })


def in_season(month: Column, start: int, end: int) -> Column:
    """Whether a month lies in a season that may go over the year's end."""
    return (month >= start) & (month <= end) if start <= end else (month >= start) | (month <= end)


def seasons(df: DataFrame, spans: dict[str, tuple[int, int]] | None = None, date: str = "date") -> DataFrame:
    """A flag for each season, and ``hunting_intensity``, their sum (0 without seasons)."""
    spans = DEFAULTS["seasons"] if spans is None else spans
    month = F.col("month") if "month" in df.columns else F.month(date)
    flags = {f"is_{n}_season": flag(in_season(month, *s)) for n, s in spans.items()}
    return df.withColumns(flags | {"hunting_intensity": reduce(Column.__add__, flags.values(), F.lit(0))})


def series(p: Panel) -> WindowSpec:
    return Window.partitionBy(*p.key).orderBy(p.date)


def lags(df: DataFrame, steps: tuple[int, ...] = DEFAULTS["lags"], p: Panel = Panel(), price: str = "avg_price") -> DataFrame:
    """``target_lag_n`` for each n, the price a month ago, and the change against 12 months and 1 month
    ago. Changes need no lag of their own to be asked for."""
    w, t = series(p), F.col(p.target)
    new = {f"{p.target}_lag_{n}": F.lag(p.target, n).over(w) for n in steps}
    new |= {f"{price}_lag_1": F.lag(price, 1).over(w)} if price in df.columns else {}
    return df.withColumns(new | {f"{p.target}_yoy_change": t - F.lag(p.target, 12).over(w), f"{p.target}_mom_change": t - F.lag(p.target, 1).over(w)})


def rolling(df: DataFrame, widths: tuple[int, ...] = DEFAULTS["windows"], p: Panel = Panel(), exclude_current: bool = False) -> DataFrame:
    """Mean and sample deviation of the last rows, the current one included unless it is excluded;
    the deviation of fewer than two is 0."""
    new: dict[str, Column] = {}
    for n in widths:
        w = series(p).rowsBetween(-n, -1) if exclude_current else series(p).rowsBetween(1 - n, 0)
        new[f"{p.target}_ma_{n}"] = F.avg(p.target).over(w)
        new[f"{p.target}_std_{n}"] = F.when(F.count(p.target).over(w) >= 2, F.stddev_samp(p.target).over(w)).otherwise(F.lit(0.0))
    return df.withColumns(new)


def share(df: DataFrame, by: str = "subcategory", p: Panel = Panel()) -> DataFrame:
    """Total of the target by level and month, and the row's share of it."""
    total = F.sum(p.target).over(Window.partitionBy(by, p.date))
    return df.withColumn("subcat_total_qty", total).withColumn("subcat_share", ratio(F.col(p.target), F.col("subcat_total_qty")))


def time_index(df: DataFrame, p: Panel = Panel()) -> DataFrame:
    return df.withColumn("time_index", F.row_number().over(series(p)) - 1)


def rare_group(df: DataFrame, column: str = "sizing", kept: tuple[str, ...] = DEFAULTS["kept_levels"], other: str = DEFAULTS["other_level"]) -> DataFrame:
    return df.withColumn(f"{column}_grouped", F.when(F.col(column).isin(*kept), F.col(column)).otherwise(F.lit(other)))


def dummy_name(level: str) -> str:
    return "is_" + level.lower().replace(" ", "_").replace("/", "_")


def levels_by_total(df: DataFrame, column: str = "subcategory", target: str = "quantity") -> list[str]:
    """Levels by falling total of the target, then by name; null is no level. A small collect: one row a level."""
    totals = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum(target).alias("total"))
    return [r[0] for r in totals.orderBy(F.desc("total"), column).collect()]


def one_hot(df: DataFrame, column: str = "subcategory", levels: list[str] | None = None, target: str = "quantity") -> DataFrame:
    """A flag for each level but the first, the reference level. Given ``levels``, nothing runs."""
    levels = levels_by_total(df, column, target) if levels is None else levels
    return df.withColumns({dummy_name(x): flag(F.col(column) == x) for x in levels[1:]})


def encodings(df: DataFrame, levels: list[str] | None = None, kept: tuple[str, ...] = DEFAULTS["kept_levels"], convenience: str = "12 GA") -> DataFrame:
    """Rare levels grouped, flags for two values of ``tactical``, one-hot subcategories, one size flag."""
    df = rare_group(df, kept=kept).withColumns({"is_tactical": flag(F.col("tactical") == "Y"), "is_tactical_na": flag(F.col("tactical") == "NA")})
    return one_hot(df, levels=levels).withColumn("is_12ga", flag(F.col("sizing") == convenience))


def feature_set(df: DataFrame, levels: list[str] | None = None, c: dict = DEFAULTS, p: Panel = Panel(), kept: tuple[str, ...] | None = None) -> DataFrame:
    """All features of a panel. No write: ``sources.files.save_panel`` is a step of its own."""
    out = seasons(calendar(df, p.date, c), c["seasons"], p.date)
    out = rolling(lags(out, tuple(c["lags"]), p), tuple(c["windows"]), p)
    out = encodings(out, levels, kept or tuple(c["kept_levels"]))
    return time_index(share(out, p=p), p)


#: Columns that are no model inputs, and those that hold the current target.
NOT_FEATURES = frozenset({"date", "subcategory", "sizing", "tactical", "sizing_grouped", "quantity", "amount", "transaction_count", "subcat_total_qty", "subcat_share"})
LEAKING = frozenset({"quantity_yoy_change", "quantity_mom_change", "quantity_ma_3", "quantity_std_3", "quantity_ma_6", "quantity_std_6", "quantity_ma_12", "quantity_std_12"})


def model_features(df: DataFrame, leave: frozenset[str] = NOT_FEATURES | LEAKING) -> list[str]:
    """Numeric columns that a model may use."""
    return [n for n, t in df.dtypes if t in ("int", "bigint", "float", "double") and n not in leave]
