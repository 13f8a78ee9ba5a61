"""The driver's tables as the raw rows of the domain, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import panel as op

#: The domain's settings for these tables' months and levels.
SETTINGS = DEFAULTS | {"regime": ("1998-03-01", "1999-12-01"), "after_regime": "2000-01-01", "kept_levels": ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#31"), "min_nonzero_months": 60, "split": ("1999-12-31", "2000-12-31"), "convenience": "Brand#12"}
KEY = ["subcategory", "sizing", "tactical"]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part, as raw transactions. Spark broadcasts the parts if they are small."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_brand", "p_size")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.trunc("l_shipdate", "month").alias("date"),
        F.col("p_type").alias("subcategory"),
        F.col("p_brand").alias("sizing"),
        F.when(F.col("l_returnflag") == "A", "Y").when(F.col("l_returnflag") == "R", "NA").alias("tactical"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double")).alias("barrel_length"),
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.clean(transactions(spark, sf_dir))


def built(spark: SparkSession, sf_dir: str) -> op.Built:
    return op.build(cleaned(spark, sf_dir))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


TX = """
tx AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_type AS subcategory, p_brand AS sizing,
    CASE l_returnflag WHEN 'A' THEN 'Y' WHEN 'R' THEN 'NA' END AS tactical,
    CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS barrel_length
  FROM lineitem JOIN part ON l_partkey = p_partkey),
clean AS (SELECT date, subcategory, sizing, coalesce(tactical, 'N') AS tactical, quantity, amount, barrel_length FROM tx)"""
AGG = (
    TX
    + """,
agg AS (
  SELECT *, CASE WHEN quantity > 0 THEN amount / quantity ELSE 0.0 END AS avg_price FROM (
    SELECT date, subcategory, sizing, tactical, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(amount) AS DOUBLE) AS amount,
      avg(barrel_length) AS barrel_length, count(*) AS transaction_count
    FROM clean GROUP BY ALL))"""
)
PANEL = (
    AGG
    + """,
spine AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date FROM agg),
grid AS (SELECT * FROM (SELECT DISTINCT subcategory, sizing, tactical FROM agg), spine),
zeroed AS (
  SELECT g.subcategory, g.sizing, g.tactical, g.date, coalesce(quantity, 0) AS quantity, coalesce(amount, 0.0) AS amount,
    barrel_length AS actual_length, coalesce(transaction_count, 0) AS transaction_count, coalesce(avg_price, 0.0) AS avg_price
  FROM grid g LEFT JOIN agg USING (date, subcategory, sizing, tactical)),
panel AS (
  SELECT subcategory, sizing, tactical, date, quantity, amount,
    coalesce(actual_length, avg(actual_length) OVER (PARTITION BY subcategory, sizing, tactical), avg(actual_length) OVER ()) AS barrel_length,
    transaction_count, avg_price FROM zeroed)"""
)
_W = "(PARTITION BY subcategory, sizing, tactical ORDER BY date"
LAGS = ", ".join(f"lag(quantity, {n}) OVER {_W}) AS quantity_lag_{n}" for n in (1, 3, 6, 12)) + f", lag(avg_price, 1) OVER {_W}) AS avg_price_lag_1"
DIFFS = f"quantity - lag(quantity, 12) OVER {_W}) AS quantity_yoy_change, quantity - lag(quantity, 1) OVER {_W}) AS quantity_mom_change"
ROLLS = ", ".join(f"avg(quantity) OVER {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS quantity_ma_{n}, coalesce(stddev_samp(quantity) OVER {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0.0) AS quantity_std_{n}" for n in (3, 6, 12))
CALENDAR = """CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
  sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos,
  CAST(date BETWEEN DATE '1998-03-01' AND DATE '1999-12-01' AS INTEGER) AS covid_period, CAST(date >= DATE '2000-01-01' AS INTEGER) AS post_covid,
  CAST(month(date) = 3 AS INTEGER) AS is_march, CAST(month(date) IN (6, 7, 8) AS INTEGER) AS off_season, CAST((22 - month(date)) % 12 AS INTEGER) AS months_to_hunting"""
_SPANS = {n: (f"month(date) BETWEEN {a} AND {b}" if a <= b else f"(month(date) >= {a} OR month(date) <= {b})") for n, (a, b) in DEFAULTS["seasons"].items()}
SEASONS = ", ".join(f"CAST({c} AS INTEGER) AS is_{n}_season" for n, c in _SPANS.items()) + ", " + " + ".join(f"CAST({c} AS INTEGER)" for c in _SPANS.values()) + " AS hunting_intensity"
FOLDS = """
d AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM panel)),
folds AS (
  SELECT CAST((t.k - 24) / 3 + 1 AS INTEGER) AS fold, (SELECT min(date) FROM d) AS train_start, t.date AS train_end, s.date AS val_start, e.date AS val_end
  FROM d t JOIN d s ON s.k = t.k + 1 JOIN d e ON e.k = t.k + 3 WHERE t.k >= 24 AND (t.k - 24) % 3 = 0)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def round_sql(body: str, columns: list[str], places: int = 6) -> str:
    """A SELECT body's rows with these columns rounded."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {places}) AS {c}' for c in columns)}) FROM ({body})"
