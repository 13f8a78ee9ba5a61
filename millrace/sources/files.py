"""Files in and out: raw CSV by year, Parquet panels, and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: the raw files' columns, in order.
RAW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("type", T.StringType()), ("category", T.StringType()), ("subcategory", T.StringType()), ("sizing", T.StringType()),
    ("month_name", T.StringType()), ("month_number", T.IntegerType()), ("year_", T.IntegerType()), ("tactical", T.StringType()),
    ("barrel_length", T.FloatType()), ("trigger_action", T.StringType()), ("quantity", T.IntegerType()), ("amount", T.FloatType()),
)])


def month_start(year: str = "year_", month: str = "month_number"):
    """First day of a month; null for a month out of 1-12 or a null part."""
    ok = F.col(month).between(1, 12) & F.col(year).between(1, 9999)
    return F.when(ok, F.make_date(F.col(year), F.when(ok, F.col(month)), F.lit(1)))


def load_raw(spark: SparkSession, folder: str, years: list[int] | None = None, pattern: str = "{year}.csv") -> DataFrame:
    """All years' CSV files as one scan, with ``date``. The schema is given, so nothing is read twice."""
    from ..config import DEFAULTS

    paths = [f"{folder.rstrip('/')}/{pattern.format(year=y)}" for y in (years or DEFAULTS["years"])]
    return spark.read.csv(paths, schema=RAW_SCHEMA, header=True).withColumn("date", month_start())


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by name of any number of frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def load_parquet(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn(date, F.col(date).cast("date"))


def save_panel(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """Overwrite ``path``, rows in order. ``files`` = 1 gives a single file, for small results alone."""
    df = df.orderBy(*order)
    (df.coalesce(files) if files else df).write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result (metrics, tests, chosen settings) as Parquet or JSON."""
    df.write.mode("overwrite").format(kind).save(path)


def to_pandas(df: DataFrame, drop_na: bool = True):
    """To the driver, for small tables: rows with a null lag go in Spark first."""
    lags = [c for c in df.columns if "_lag_" in c]
    return (df.dropna(subset=lags) if drop_na and lags else df).toPandas()


def extra_columns(df: DataFrame, base: DataFrame) -> list[str]:
    """Columns of ``df`` that ``base`` lacks, in order."""
    return [c for c in df.columns if c not in set(base.columns)]
