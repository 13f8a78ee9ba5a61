"""One query for each operator, over the driver's tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as ft
from ..operators import forecast as fc
from ..operators import metrics as mt
from ..operators import panel as pn
from ..operators import profile as pf
from ..operators import splits as sp
from ..sources import files
from ..sources.scratch import scratch_path
from .base import AGG, CALENDAR, DIFFS, FOLDS, KEY, LAGS, PANEL, ROLLS, SEASONS, SETTINGS, TX, built, cleaned, round_sql, rounded, transactions, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_P = "subcategory, sizing, tactical, date"
_MIN = SETTINGS["min_nonzero_months"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d).panel


# Sources


@query()
def csv_union_date(spark, d):
    """Line items written as CSV by year in one pass, read back with the fixed schema and a date."""
    tx = transactions(spark, d).select(F.lit("firearm").alias("type"), F.lit("x").alias("category"), "subcategory", "sizing", F.date_format("date", "MMMM").alias("month_name"), F.month("date").alias("month_number"), F.year("date").alias("year_"), "tactical", F.col("barrel_length").cast("float").alias("barrel_length"), F.lit("t").alias("trigger_action"), F.col("quantity").cast("int").alias("quantity"), F.col("amount").cast("float").alias("amount"))
    folder = scratch_path(spark, "csv")
    tx.withColumn("y", F.col("year_")).write.partitionBy("y").csv(folder, header=True)
    years = [r[0] for r in tx.select("year_").distinct().orderBy("year_").collect()]  # one number a year
    return files.load_raw(spark, folder, years, "y={year}").groupBy("date").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


# Cleaning and the panel


@query(with_(TX, "SELECT tactical, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity, count(barrel_length) AS with_length FROM clean GROUP BY tactical"))
def clean_nullfill(spark, d):
    return cleaned(spark, d).groupBy("tactical").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.count("barrel_length").alias("with_length"))


@query(with_(AGG, round_sql("SELECT * FROM agg", ["amount", "barrel_length", "avg_price"], 9)))
def monthly_agg(spark, d):
    return rounded(pn.monthly(cleaned(spark, d)), 9)


@query(with_(PANEL, "SELECT date FROM spine"))
def date_spine(spark, d):
    return pn.spine(transactions(spark, d).select("date")).select(F.explode("months").alias("date"))


@query(with_(PANEL, f"SELECT {_P}, quantity, round(amount, 6) AS amount, transaction_count FROM panel"))
def panel_zero_fill(spark, d):
    return rounded(_panel(spark, d).select(*KEY, "date", "quantity", "amount", "transaction_count"))


@query(with_(PANEL, f"SELECT {_P}, round(barrel_length, 6) AS barrel_length FROM panel"))
def barrel_cascade(spark, d):
    return rounded(_panel(spark, d).select(*KEY, "date", "barrel_length"))


@query(with_(PANEL, f"SELECT {_P}, round(avg_price, 9) AS avg_price FROM panel"))
def avg_price(spark, d):
    return rounded(_panel(spark, d).select(*KEY, "date", "avg_price"), 9)


@query(
    with_(
        PANEL,
        """SELECT 'raw_rows' AS "check", count(*) AS expected, count(*) AS actual, true AS ok FROM tx
UNION ALL SELECT 'target_conserved', (SELECT CAST(sum(quantity) AS BIGINT) FROM tx), CAST(sum(quantity) AS BIGINT), (SELECT sum(quantity) FROM tx) = sum(quantity) FROM agg
UNION ALL SELECT 'no_negatives', 0, count(*) FILTER (quantity < 0), count(*) FILTER (quantity < 0) = 0 FROM tx
UNION ALL SELECT 'panel_size', (SELECT count(*) FROM grid), count(*), (SELECT count(*) FROM grid) = count(*) FROM panel
UNION ALL SELECT 'no_null_keys', 0, count(*) FILTER (date IS NULL OR subcategory IS NULL OR sizing IS NULL OR tactical IS NULL), true FROM panel""",
    )
)
def validate_invariants(spark, d):
    return pn.validate(transactions(spark, d), built(spark, d))


# Features


@query(with_(PANEL, f"SELECT DISTINCT date, month, quarter, year, months_to_hunting FROM (SELECT date, {CALENDAR} FROM panel)"))
def calendar(spark, d):
    return ft.calendar(_panel(spark, d).select("date").distinct(), c=SETTINGS).select("date", "month", "quarter", "year", "months_to_hunting")


@query(with_(PANEL, f"SELECT DISTINCT date, round(month_sin, 6) + 0.0 AS month_sin, round(month_cos, 6) + 0.0 AS month_cos FROM (SELECT date, {CALENDAR} FROM panel)"))
def cyclic(spark, d):
    out = rounded(ft.calendar(_panel(spark, d).select("date").distinct(), c=SETTINGS).select("date", "month_sin", "month_cos"))
    return out.select("date", (F.col("month_sin") + 0.0).alias("month_sin"), (F.col("month_cos") + 0.0).alias("month_cos"))


@query(with_(PANEL, f"SELECT DISTINCT date, covid_period, post_covid, is_march, off_season FROM (SELECT date, {CALENDAR} FROM panel)"))
def regime_flags(spark, d):
    return ft.calendar(_panel(spark, d).select("date").distinct(), c=SETTINGS).select("date", "covid_period", "post_covid", "is_march", "off_season")


@query(with_(PANEL, f"SELECT DISTINCT date, {SEASONS} FROM panel"))
def season_flags(spark, d):
    return ft.seasons(_panel(spark, d).select("date").distinct())


@query(with_(PANEL, round_sql(f"SELECT {_P}, {LAGS} FROM panel", ["avg_price_lag_1"], 9)))
def lags(spark, d):
    return rounded(ft.lags(_panel(spark, d)).select(*KEY, "date", *[f"quantity_lag_{n}" for n in (1, 3, 6, 12)], "avg_price_lag_1"), 9)


@query(with_(PANEL, f"SELECT {_P}, {DIFFS} FROM panel"))
def diffs(spark, d):
    return ft.lags(_panel(spark, d)).select(*KEY, "date", "quantity_yoy_change", "quantity_mom_change")


@query(with_(PANEL, f"SELECT {_P}, round(quantity_ma_3, 6) AS quantity_ma_3, round(quantity_ma_6, 6) AS quantity_ma_6, round(quantity_ma_12, 6) AS quantity_ma_12 FROM (SELECT {_P}, {ROLLS} FROM panel)"))
def rolling_mean(spark, d):
    return rounded(ft.rolling(_panel(spark, d)).select(*KEY, "date", "quantity_ma_3", "quantity_ma_6", "quantity_ma_12"))


@query(with_(PANEL, f"SELECT {_P}, round(quantity_std_3, 6) AS quantity_std_3, round(quantity_std_6, 6) AS quantity_std_6, round(quantity_std_12, 6) AS quantity_std_12 FROM (SELECT {_P}, {ROLLS} FROM panel)"))
def rolling_std(spark, d):
    return rounded(ft.rolling(_panel(spark, d)).select(*KEY, "date", "quantity_std_3", "quantity_std_6", "quantity_std_12"))


_SHARE = "CAST(sum(quantity) OVER (PARTITION BY subcategory, date) AS BIGINT) AS subcat_total_qty, CASE WHEN sum(quantity) OVER (PARTITION BY subcategory, date) > 0 THEN quantity / sum(quantity) OVER (PARTITION BY subcategory, date) ELSE 0.0 END AS subcat_share"
_INDEX = "CAST(row_number() OVER (PARTITION BY subcategory, sizing, tactical ORDER BY date) - 1 AS INTEGER) AS time_index"


@query(with_(PANEL, round_sql(f"SELECT {_P}, {_SHARE} FROM panel", ["subcat_share"], 9)))
def subcat_share(spark, d):
    return rounded(ft.share(_panel(spark, d)).select(*KEY, "date", "subcat_total_qty", "subcat_share"), 9)


@query(with_(PANEL, f"SELECT {_P}, {_INDEX} FROM panel"))
def time_index(spark, d):
    return ft.time_index(_panel(spark, d)).select(*KEY, "date", "time_index")


_KEPT = ", ".join(f"'{x}'" for x in SETTINGS["kept_levels"])
_RARE = f"CASE WHEN sizing IN ({_KEPT}) THEN sizing ELSE 'OTHER_GAUGE' END AS sizing_grouped"


@query(with_(PANEL, f"SELECT sizing_grouped, count(*) AS n FROM (SELECT {_RARE} FROM panel) GROUP BY 1"))
def rare_group(spark, d):
    return ft.rare_group(_panel(spark, d), kept=SETTINGS["kept_levels"]).groupBy("sizing_grouped").agg(F.count("*").alias("n"))


@query(
    with_(
        PANEL,
        "SELECT level, rank = 1 AS is_reference, n FROM (SELECT subcategory AS level, row_number() OVER (ORDER BY sum(quantity) DESC, subcategory) AS rank, count(*) AS n FROM panel GROUP BY 1)",
    )
)
def one_hot(spark, d):
    """How many rows each level's flag marks; the reference level's are those that no flag marks."""
    df = _panel(spark, d)
    levels = ft.levels_by_total(df)
    flags = [ft.dummy_name(x) for x in levels[1:]]
    one = ft.one_hot(df, levels=levels).agg(*[F.sum(f"`{f}`").alias(f"_{i}") for i, f in enumerate(flags)], F.count("*").alias("all"))
    rest = F.col("all") - sum((F.col(f"_{i}") for i in range(len(flags))), F.lit(0))
    rows = [F.struct(F.lit(levels[0]).alias("level"), F.lit(True).alias("is_reference"), rest.cast("long").alias("n")), *[F.struct(F.lit(x).alias("level"), F.lit(False).alias("is_reference"), F.col(f"_{i}").cast("long").alias("n")) for i, x in enumerate(levels[1:])]]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_FEATURES = f"""features AS (SELECT *, {CALENDAR}, {SEASONS}, {LAGS}, {DIFFS}, {ROLLS}, {_RARE}, CAST(tactical = 'Y' AS INTEGER) AS is_tactical,
  CAST(tactical = 'NA' AS INTEGER) AS is_tactical_na, CAST(sizing = '12 GA' AS INTEGER) AS is_12ga, {_SHARE}, {_INDEX} FROM panel)"""
_DOUBLES = ["barrel_length", "avg_price", "month_sin", "month_cos", "avg_price_lag_1", *[f"quantity_{k}_{n}" for n in (3, 6, 12) for k in ("ma", "std")], "subcat_share"]


def _features(spark: SparkSession, d: str, levels: list[str] | None = None) -> DataFrame:
    return ft.feature_set(_panel(spark, d), levels, SETTINGS)


@query(with_(PANEL + ",\n" + _FEATURES, f"SELECT * REPLACE ({', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in _DOUBLES)}) FROM features"))
def feature_set(spark, d):
    """All features, but for the one-hot flags, whose names come from the data."""
    df = _features(spark, d, levels=[])
    return df.select(*[(F.round(c, 9) + 0.0).alias(c) if c in _DOUBLES else F.col(c) for c in df.columns])


# Profiles


@query(with_(TX, "SELECT subcategory, count(*) AS n FROM clean GROUP BY 1"))
def freq_table(spark, d):
    return pf.frequency(cleaned(spark, d), "subcategory")


@query(with_(TX, "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM clean WHERE tactical = 'NA' GROUP BY 1"))
def na_by_year(spark, d):
    return cleaned(spark, d).where("tactical = 'NA'").groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query(with_(TX, "SELECT DISTINCT subcategory, sizing FROM clean WHERE tactical = 'NA' INTERSECT SELECT subcategory, sizing FROM clean WHERE tactical = 'N'"))
def overlap(spark, d):
    rows = cleaned(spark, d).select("subcategory", "sizing", "tactical").distinct()
    return rows.where("tactical = 'NA'").select("subcategory", "sizing").join(rows.where("tactical = 'N'").select("subcategory", "sizing"), ["subcategory", "sizing"])


_TX_COLUMNS = ["date", "subcategory", "sizing", "tactical", "quantity", "amount", "barrel_length"]


@query(with_(TX, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, round(CAST(count(*) FILTER ({c} IS NULL) * 100.0 / count(*) AS DOUBLE), 4) AS pct FROM tx" for c in _TX_COLUMNS)))
def null_profile(spark, d):
    out = pf.null_profile(transactions(spark, d), _TX_COLUMNS)
    return out.select("column", "nulls", F.col("pct").cast("double").alias("pct"))


@query(with_(TX, "SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess FROM (SELECT count(*) AS n FROM tx GROUP BY date, subcategory, sizing, tactical, barrel_length HAVING count(*) > 1)"))
def duplicates(spark, d):
    return pf.excess_duplicates(transactions(spark, d), [*KEY, "date", "barrel_length"])


@query(with_(AGG, "SELECT bucket, count(*) AS products FROM (SELECT CASE WHEN count(*) >= 83 THEN 'all' WHEN count(*) >= 60 THEN 'many' WHEN count(*) >= 24 THEN 'some' ELSE 'few' END AS bucket FROM agg GROUP BY subcategory, sizing, tactical) GROUP BY 1"))
def coverage_buckets(spark, d):
    return pf.coverage(cleaned(spark, d), KEY, "date", 83, (24, 60))


@query(with_(PANEL, "SELECT CAST(least(CASE WHEN hi > lo THEN floor((quantity - lo) / CAST(hi - lo AS DOUBLE) * 50) + 1 ELSE 1 END, 50) AS INTEGER) AS bin, count(*) AS n FROM panel, (SELECT min(quantity) AS lo, max(quantity) AS hi FROM panel) GROUP BY 1"))
def histogram(spark, d):
    return pf.histogram(_panel(spark, d), "quantity", 50)


@query(with_(PANEL, "SELECT subcategory, CAST(median(quantity) AS DOUBLE) AS median, CAST(quantile_cont(quantity, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(quantity, 0.75) AS DOUBLE) AS q3 FROM panel GROUP BY 1"))
def median_profile(spark, d):
    return _panel(spark, d).groupBy("subcategory").agg(F.median("quantity").alias("median"), F.percentile("quantity", F.lit(0.25)).alias("q1"), F.percentile("quantity", F.lit(0.75)).alias("q3"))


@query(with_(PANEL, "SELECT date, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(amount), 2) AS amount FROM panel GROUP BY 1"))
def monthly_totals(spark, d):
    return rounded(pf.totals(_panel(spark, d), ["date"], {"quantity": "quantity", "amount": "amount"}), 2)


@query(with_(PANEL, "SELECT CAST(month(date) AS INTEGER) AS month, round(avg(t), 6) AS mean_total FROM (SELECT date, sum(quantity) AS t FROM panel GROUP BY 1) GROUP BY 1"))
def seasonality(spark, d):
    return rounded(pf.seasonal_means(_panel(spark, d), "date", "quantity"))


@query(with_(PANEL, "SELECT CAST(y AS INTEGER) AS year, CAST(t AS BIGINT) AS total, round(CAST((t - lag(t) OVER (ORDER BY y)) * 100.0 / lag(t) OVER (ORDER BY y) AS DOUBLE), 4) AS yoy_pct FROM (SELECT year(date) AS y, sum(quantity)::BIGINT AS t FROM panel GROUP BY 1)"))
def annual_yoy(spark, d):
    out = pf.year_over_year(_panel(spark, d), "date", "quantity")
    return out.select("year", "total", F.round(F.col("yoy_pct").cast("double"), 4).alias("yoy_pct"))


@query(with_(PANEL, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS stddev, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM panel" for c in ("quantity", "amount", "barrel_length"))))
def describe(spark, d):
    return rounded(pf.describe(_panel(spark, d), ["quantity", "amount", "barrel_length"]), 4)


_CORR = ["quantity", "avg_price", "transaction_count", "month_sin", "month_cos", "hunting_intensity", "quantity_lag_1", "quantity_lag_12", "quantity_ma_3", "quantity_ma_6", "quantity_std_3"]
_CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM features" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :])


@query(with_(PANEL + ",\n" + _FEATURES, f"SELECT a, b, round(r, 6) + 0.0 AS r FROM ({_CORR_SQL})"))
def corr_matrix(spark, d):
    return pf.correlations(_features(spark, d, levels=[]), _CORR).select("a", "b", (F.round("r", 6) + 0.0).alias("r"))


_EXPECTED_SQL = ", ".join(f"'{min(p)}|{max(p)}'" for p in pf.EXPECTED_PAIRS)


@query(with_(PANEL + ",\n" + _FEATURES, f"SELECT a, b, round(r, 4) AS r, CASE WHEN least(a, b) || '|' || greatest(a, b) IN ({_EXPECTED_SQL}) THEN 'Expected' ELSE 'Review' END AS class FROM ({_CORR_SQL}) WHERE abs(r) > 0.8"))
def high_corr(spark, d):
    return pf.high_correlations(pf.correlations(_features(spark, d, levels=[]), _CORR), 0.8)


@query(with_(PANEL + ",\n" + _FEATURES, "SELECT feature, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(quantity AS DOUBLE)) AS r FROM features" for c in _CORR[1:]) + ") ORDER BY abs(r) DESC, feature LIMIT 20"))
def target_corr(spark, d):
    return rounded(pf.target_correlations(_features(spark, d, levels=[]), "quantity", _CORR))


_INVENTORY = [("date", "date"), *[(c, "string") for c in KEY], ("quantity", "bigint"), ("transaction_count", "bigint")]


@query(with_(PANEL, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM panel" for c, t in _INVENTORY)))
def feature_inventory(spark, d):
    return pf.inventory(_panel(spark, d).select(*[c for c, _ in _INVENTORY]))


@query(with_(PANEL, "SELECT count(*) AS n, count(*) FILTER (quantity = 0) AS zero, round(CAST(count(*) FILTER (quantity = 0) * 100.0 / count(*) AS DOUBLE), 4) AS zero_pct FROM panel"))
def zero_ratio(spark, d):
    return _panel(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("quantity") == 0).alias("zero"), F.round(F.lit(100.0) * F.avg(F.when(F.col("quantity") == 0, 1.0).otherwise(0.0)), 4).alias("zero_pct"))


@query(with_(AGG, "SELECT concat_ws(' | ', subcategory, sizing, tactical) AS product, count(*) AS months FROM agg GROUP BY subcategory, sizing, tactical ORDER BY months, product LIMIT 1"))
def sparsest(spark, d):
    per = pn.monthly(cleaned(spark, d)).groupBy(*KEY).agg(F.count("*").alias("months"))
    return per.select(F.concat_ws(" | ", *KEY).alias("product"), "months").orderBy("months", "product").limit(1)


# Splits

_ACTIVITY = f"SELECT subcategory, sizing, tactical, CAST(sum(quantity) AS BIGINT) AS total_qty, count(*) FILTER (quantity > 0) AS nonzero_months, count(*) AS total_months, count(*) FILTER (quantity > 0) >= {_MIN} AS is_active FROM panel GROUP BY 1, 2, 3"


@query(with_(PANEL, _ACTIVITY))
def product_activity(spark, d):
    return sp.activity(_panel(spark, d), _MIN)


@query(with_(PANEL, f"SELECT {_P}, quantity FROM panel SEMI JOIN (SELECT * FROM ({_ACTIVITY}) WHERE is_active) USING (subcategory, sizing, tactical)"))
def active_rows(spark, d):
    return sp.active_rows(_panel(spark, d), _MIN)[0].select(*KEY, "date", "quantity")


def _folded(spark: SparkSession, d: str) -> DataFrame:
    df = _panel(spark, d).select(*KEY, "date", "quantity")
    return sp.assign(df, sp.folds(df))


@query(with_(PANEL + "," + FOLDS, "SELECT fold, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end, CAST(val_start AS VARCHAR) AS val_start, CAST(val_end AS VARCHAR) AS val_end, count(*) FILTER (date <= train_end) AS train_size, count(*) FILTER (date > train_end) AS val_size FROM panel JOIN folds ON date BETWEEN train_start AND val_end GROUP BY ALL"))
def fold_info(spark, d):
    df = _panel(spark, d).select(*KEY, "date")
    return sp.fold_info(df, sp.folds(df))


@query(with_(PANEL + "," + FOLDS, "SELECT fold, CASE WHEN date <= train_end THEN 'train' ELSE 'validation' END AS role, date, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM panel JOIN folds ON date BETWEEN train_start AND val_end GROUP BY ALL"))
def fold_rows(spark, d):
    return _folded(spark, d).groupBy("fold", "role", "date").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query(with_(PANEL, "SELECT CASE WHEN date <= DATE '1999-12-31' THEN 'train' WHEN date <= DATE '2000-12-31' THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(date) AS first, max(date) AS last FROM panel GROUP BY 1"))
def fixed_split(spark, d):
    return sp.fixed_split(_panel(spark, d), *SETTINGS["split"]).groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


# Forecasts and scores

_NAIVE = """,
naive AS (
  SELECT fold, subcategory, sizing, tactical, date, quantity AS actual, CAST(before AS DOUBLE) AS predicted
  FROM (SELECT *, lag(quantity, 12) OVER (PARTITION BY subcategory, sizing, tactical ORDER BY date) AS before FROM panel) JOIN folds ON date BETWEEN val_start AND val_end),
scores AS (
  SELECT fold, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae,
    coalesce(100 * avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END), 0.0) AS mape
  FROM naive GROUP BY fold)"""
_NAIVE = PANEL + "," + FOLDS + _NAIVE


@query(with_(_NAIVE, "SELECT * FROM naive"))
def seasonal_naive(spark, d):
    return fc.seasonal_naive(_folded(spark, d))


def _naive_scores(spark: SparkSession, d: str) -> DataFrame:
    return mt.evaluate(fc.seasonal_naive(_folded(spark, d)), ["fold"])


@query(with_(_NAIVE, round_sql("SELECT * FROM scores", ["rmse", "mae", "mape"], 4)))
def fold_metrics(spark, d):
    return rounded(_naive_scores(spark, d), 4)


@query(with_(_NAIVE, "SELECT metric, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max FROM (UNPIVOT scores ON rmse, mae, mape INTO NAME metric VALUE v) GROUP BY metric"))
def metric_summary(spark, d):
    return rounded(mt.across_folds(_naive_scores(spark, d)), 4)


_MODELS = """,
last3 AS (
  SELECT fold, 'mean of 3' AS model, quantity AS actual, m AS predicted FROM (
    SELECT *, avg(quantity) OVER (PARTITION BY subcategory, sizing, tactical ORDER BY date ROWS BETWEEN 15 PRECEDING AND 13 PRECEDING) AS m FROM panel)
  JOIN folds ON date BETWEEN val_start AND val_end),
models AS (SELECT fold, 'seasonal naive' AS model, actual, predicted FROM naive UNION ALL SELECT * FROM last3),
by_model AS (
  SELECT model, fold, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae,
    coalesce(100 * avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END), 0.0) AS mape
  FROM models GROUP BY ALL)"""


def _two_models(spark: SparkSession, d: str) -> DataFrame:
    """Two forecasts of all folds: the season before, and the mean of three months around a year before."""
    from pyspark.sql.window import Window

    folded = _folded(spark, d)
    by = Window.partitionBy("fold", *KEY).orderBy("date").rowsBetween(-15, -13)
    mean = folded.withColumn("predicted", F.avg("quantity").over(by)).where("role = 'validation'").select("fold", F.col("quantity").alias("actual"), "predicted")
    both = files.union_all([fc.seasonal_naive(folded).select("fold", "actual", "predicted").withColumn("model", F.lit("seasonal naive")), mean.withColumn("model", F.lit("mean of 3"))])
    return mt.evaluate(both, ["model", "fold"])


@query(with_(_NAIVE + _MODELS, "SELECT model, round(avg(rmse), 4) AS rmse, round(avg(mae), 4) AS mae, round(avg(mape), 4) AS mape FROM by_model GROUP BY model"))
def model_compare(spark, d):
    return rounded(mt.compare(_two_models(spark, d)), 4)


@query()
def paired_ttest(spark, d):
    scores = _two_models(spark, d).groupBy("fold").pivot("model", ["seasonal naive", "mean of 3"]).agg(F.first("rmse"))
    r = mt.paired_ttest(scores, "seasonal naive", "mean of 3")
    return spark.createDataFrame([tuple(r.values())], "t_statistic double, p_value double, reject_null boolean, baseline_mean double, baseline_std double, alternative_mean double, alternative_std double, ci_lower double, ci_upper double")


#: Rows for one task of a fit. Trees start thousands of short tasks; for fewer rows, starting a task takes longer than its work.
ROWS_A_TASK = 20_000


def _stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back: what follows doesn't carry the plan that made them."""
    folder = scratch_path(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _matrix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Training and validation rows of the fixed split as vectors, stored: fits read them often, and each task of a fit
    carries the plan of its rows. The panel is stored too, as levels and features both read it."""
    df = ft.feature_set(_stored(_panel(spark, d), "panel"), None, SETTINGS)
    names = ft.model_features(df)
    rows = _stored(fc.assemble(sp.fixed_split(df, *SETTINGS["split"]), names, "quantity", [*KEY, "date", "split"]), "matrix")
    rows = rows.coalesce(max(1, -(-rows.count() // ROWS_A_TASK)))
    return rows.where("split = 'train'"), rows.where("split = 'validation'"), names


@query()
def ridge(spark, d):
    train, val, _ = _matrix(spark, d)
    out = fc.fit_ridge(train).transform(val).select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    return mt.evaluate(out.withColumn("model", F.lit("ridge")), ["model"])


@query()
def gbt(spark, d):
    train, val, _ = _matrix(spark, d)
    out = fc.fit_boosted(train, fc.Boosting()).transform(val).select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    return mt.evaluate(out.withColumn("model", F.lit("boosted")), ["model"])


@query()
def importance(spark, d):
    train, _, names = _matrix(spark, d)
    return fc.importance(fc.fit_boosted(train, fc.Boosting()), names)


@query()
def tune(spark, d):
    train, val, _ = _matrix(spark, d)
    space = {"trees": ("int", 2, 6, 2), "depth": ("int", 2, 4, 1), "rate": ("log", 0.05, 0.3, 0)}
    return fc.tune(train, val, space=space, trials=3)[1]


@query()
def sarima(spark, d):
    """Means of the metrics over all folds, of all series."""
    df = _panel(spark, d).select(*KEY, "date", "quantity")
    found = fc.sarima(sp.assign(df, sp.folds(df))).withColumn("model", F.lit("sarima"))
    return mt.compare(mt.evaluate(found, ["model", "fold"]))


@query(with_(_NAIVE, "SELECT date, CAST(sum(actual) AS BIGINT) AS actual, sum(predicted) AS predicted FROM naive GROUP BY date"))
def plot_tables(spark, d):
    """Actual and predicted totals by date, the data of a forecast plot."""
    return fc.seasonal_naive(_folded(spark, d)).groupBy("date").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))


@query(with_(_NAIVE + _MODELS, "SELECT model, round(avg(rmse), 4) AS mean, round(stddev_samp(rmse), 4) AS std, row_number() OVER (ORDER BY avg(rmse), model) = 1 AS best FROM by_model GROUP BY model"))
def plot_models(spark, d):
    """Mean and deviation of a metric by model with the best marked, the data of a comparison plot."""
    per = _two_models(spark, d).groupBy("model").agg(F.avg("rmse").alias("mean"), F.stddev_samp("rmse").alias("std"))
    return rounded(pf.mark_best(per, "mean", "model"), 4)


@query(with_(_NAIVE, "SELECT subcategory, round(quantile_cont(actual - predicted, 0.25), 6) AS q1, round(median(actual - predicted), 6) AS median, round(quantile_cont(actual - predicted, 0.75), 6) AS q3, min(actual - predicted) AS low, max(actual - predicted) AS high FROM naive GROUP BY 1"))
def plot_errors(spark, d):
    """Quartiles of the errors, the data of a box plot."""
    e = F.col("actual") - F.col("predicted")
    rows = fc.seasonal_naive(_folded(spark, d)).withColumn("e", e).groupBy("subcategory")
    return rounded(rows.agg(F.percentile("e", F.lit(0.25)).alias("q1"), F.median("e").alias("median"), F.percentile("e", F.lit(0.75)).alias("q3"), F.min("e").alias("low"), F.max("e").alias("high")))


@query(with_(PANEL, "SELECT * FROM (SELECT date, CAST(sum(quantity) AS BIGINT) AS quantity FROM panel GROUP BY date ORDER BY date DESC LIMIT 12)"))
def last_year(spark, d):
    """The last 12 months' totals, in order."""
    per = pf.totals(_panel(spark, d), ["date"], {"quantity": "quantity"})
    return per.orderBy(F.desc("date")).limit(12).orderBy("date")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Lags and rolling statistics of the zero-filled panel."""
    return rounded(ft.rolling(ft.lags(_panel(spark, d), steps=(12,)), widths=(3,)))
