"""Data profiles: frequencies, nulls, duplicates, coverage, histograms, totals, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Feature pairs that are correlated by construction.
EXPECTED_PAIRS = (
    ("avg_price", "avg_price_lag_1"),
    ("is_deer_season", "is_turkey_fall_season"),
    ("is_dove_season", "is_turkey_fall_season"),
    ("is_dove_season", "is_upland_season"),
    ("is_waterfowl_season", "is_deer_season"),
    ("is_waterfowl_season", "is_turkey_fall_season"),
    ("quantity_lag_1", "quantity_lag_3"),
    ("quantity_lag_1", "quantity_ma_12"),
    ("quantity_lag_1", "quantity_ma_3"),
    ("quantity_lag_1", "quantity_ma_6"),
    ("quantity_lag_1", "quantity_mom_change"),
    ("quantity_lag_3", "quantity_lag_6"),
    ("quantity_ma_3", "quantity_ma_12"),
    ("quantity_ma_3", "quantity_ma_6"),
    ("quantity_ma_6", "quantity_ma_12"),
    ("quantity_std_3", "quantity_std_12"),
    ("quantity_std_3", "quantity_std_6"),
    ("quantity_std_6", "quantity_std_12"),
)


def _rows(parts: list[Column]) -> Column:
    return F.explode(F.array(*parts)).alias("r")


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column``, ``nulls``, ``pct`` of each column, in one pass."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    pct = [F.when(F.col("n") > 0, F.round(F.col(f"_{i}") * 100.0 / F.col("n"), 4)).otherwise(F.lit(0.0)) for i in range(len(columns))]
    return one.select(_rows([F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("nulls"), pct[i].alias("pct")) for i, c in enumerate(columns)])).select("r.*")


def excess_duplicates(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups that occur more than once, and the rows beyond the first of each."""
    groups = df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def coverage(df: DataFrame, key: list[str], date: str, full: int, bands: tuple[int, int]) -> DataFrame:
    """Keys by the number of months they have: all, many, some, few."""
    months = df.select(*key, date).distinct().groupBy(*key).agg(F.count("*").alias("months"))
    lo, hi = bands
    bucket = F.when(F.col("months") >= full, "all").when(F.col("months") >= hi, "many").when(F.col("months") >= lo, "some").otherwise("few")
    return months.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("products"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin`` from 1, ``n``: equal widths between minimum and maximum, the maximum in the last bin. Nulls are left out."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1).otherwise(F.lit(1))
    return rows.groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def totals(df: DataFrame, by: list[Column | str], sums: dict[str, str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(a) for a, c in sums.items()])


def seasonal_means(df: DataFrame, date: str, target: str) -> DataFrame:
    """Mean of the monthly totals of each calendar month."""
    per = df.groupBy(date).agg(F.sum(target).alias("t"))
    return per.groupBy(F.month(date).alias("month")).agg(F.avg("t").alias("mean_total"))


def year_over_year(df: DataFrame, date: str, target: str) -> DataFrame:
    """Annual totals and their change in percent; null for the first year and after a total of 0."""
    per = df.groupBy(F.year(date).alias("year")).agg(F.sum(target).alias("total"))
    before = F.lag("total").over(Window.orderBy("year"))  # a row for each year
    return per.withColumn("yoy_pct", F.when(before != 0, (F.col("total") - before) * 100.0 / before))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, maximum of each column, in one pass."""
    f = {"n": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[(g(c) if n == "n" else g(F.col(c).cast("double"))).alias(f"{c}__{n}") for c in columns for n, g in f.items()])
    return one.select(_rows([F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").alias(n) for n in f]) for c in columns])).select("r.*")


def _corr(a: str, b: str) -> Column:
    """Pearson's r over the rows where both are there; null where one is constant (corr() would raise)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a``, ``b``, ``r`` for each unordered pair, over the rows where both are there; null where one is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[_corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(_rows([F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).select("r.*")


def high_correlations(corr: DataFrame, threshold: float = 0.9, expected: tuple[tuple[str, str], ...] = EXPECTED_PAIRS) -> DataFrame:
    """Pairs over the threshold, with whether they are known to belong together."""
    known = F.struct(F.least("a", "b"), F.greatest("a", "b")).isin(*[F.struct(F.lit(min(p)), F.lit(max(p))) for p in expected])
    return corr.where(F.abs("r") > threshold).select("a", "b", F.round("r", 4).alias("r"), F.when(known, "Expected").otherwise("Review").alias("class"))


def target_correlations(df: DataFrame, target: str, columns: list[str], n: int | None = 20) -> DataFrame:
    """Correlation of each column with the target, the ``n`` of the largest size."""
    cols = [c for c in columns if c != target]
    one = df.agg(*[_corr(c, target).alias(f"_{i}") for i, c in enumerate(cols)])
    out = one.select(_rows([F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("r")) for i, c in enumerate(cols)])).select("r.*")
    return out.orderBy(F.desc_nulls_last(F.abs("r")), "feature").limit(n) if n else out


def inventory(df: DataFrame) -> DataFrame:
    """Type, values, nulls and distinct values of each column."""
    one = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, f in (("n", F.count), ("d", F.count_distinct))], F.count("*").alias("rows"))
    return one.select(_rows([F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n{i}").alias("non_null"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, (c, t) in enumerate(df.dtypes)])).select("r.*")


def top(df: DataFrame, column: str, n: int, *ties: str, by_size: bool = False) -> DataFrame:
    """The ``n`` rows of the largest values (or sizes), ties by name; sorted ascending is the caller's choice."""
    return df.orderBy(F.desc_nulls_last(F.abs(column) if by_size else F.col(column)), *ties).limit(n)


def mark_best(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """``best`` is true on the row of the least value. For small tables: one task ranks all rows."""
    return df.withColumn("best", F.row_number().over(Window.orderBy(F.col(column).asc_nulls_last(), *ties)) == 1)
