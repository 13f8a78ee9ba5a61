"""Temporal splits without leakage, and the activity filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Panel


def folds(df: DataFrame, min_train: int = 24, horizon: int = 3, step: int = 3, date: str = "date") -> DataFrame:
    """``fold`` from 1, ``train_start``, ``train_end``, ``val_start``, ``val_end``: a rolling origin over the
    distinct dates there are. None if they are too few. A row for each fold; one task counts the dates."""
    if min(min_train, horizon, step) < 1:
        raise ValueError("min_train, horizon and step must be 1 or more")
    d = df.select(F.col(date).alias("d")).where("d is not null").distinct()
    d = d.withColumn("k", F.row_number().over(Window.orderBy("d")))
    ends = d.where((F.col("k") >= min_train) & ((F.col("k") - min_train) % step == 0))
    first = d.agg(F.min("d").alias("train_start"))
    vs = d.select(F.col("d").alias("val_start"), F.col("k").alias("ks"))
    ve = d.select(F.col("d").alias("val_end"), F.col("k").alias("ke"))
    out = ends.join(vs, F.col("ks") == F.col("k") + 1).join(ve, F.col("ke") == F.col("k") + horizon).crossJoin(first)
    fold = ((F.col("k") - min_train) / step + 1).cast("int")
    return out.select(fold.alias("fold"), "train_start", F.col("d").alias("train_end"), "val_start", "val_end")


def assign(df: DataFrame, plan: DataFrame, date: str = "date") -> DataFrame:
    """Each row once for each fold it is in, with ``fold`` and ``role``: a range join with the few folds."""
    on = (F.col(date) >= F.col("train_start")) & (F.col(date) <= F.col("val_end"))
    # At most a fold for each month.
    rows = df.join(F.broadcast(plan), on)
    return rows.withColumn("role", F.when(F.col(date) <= F.col("train_end"), "train").otherwise("validation")).drop("train_start", "train_end", "val_start", "val_end")


def fold_info(df: DataFrame, plan: DataFrame, date: str = "date") -> DataFrame:
    """Bounds as ISO dates, and rows in training and validation. Dates are counted first, so rows don't fan out."""
    per = df.groupBy(F.col(date).alias("_d")).agg(F.count("*").alias("_n"))
    on = (F.col("_d") >= F.col("train_start")) & (F.col("_d") <= F.col("val_end"))
    bounds = ["train_start", "train_end", "val_start", "val_end"]
    joined = per.join(F.broadcast(plan), on)
    train = F.col("_d") <= F.col("train_end")
    out = joined.groupBy("fold", *bounds).agg(F.sum(F.when(train, F.col("_n")).otherwise(0)).alias("train_size"), F.sum(F.when(train, 0).otherwise(F.col("_n"))).alias("val_size"))
    return out.select("fold", *[F.col(b).cast("string").alias(b) for b in bounds], "train_size", "val_size")


def fixed_split(df: DataFrame, train_end: str = "2022-12-31", val_end: str = "2023-06-30", date: str = "date") -> DataFrame:
    """``split``: train up to the first date, validation up to the second, test after; null dates have none."""
    return df.withColumn("split", F.when(F.col(date) <= F.lit(train_end).cast("date"), "train").when(F.col(date) <= F.lit(val_end).cast("date"), "validation").when(F.col(date).isNotNull(), "test"))


def activity(df: DataFrame, min_nonzero: int = 12, p: Panel = Panel()) -> DataFrame:
    """Total, months over zero, months, and whether those over zero are enough, for each key."""
    out = df.groupBy(*p.key).agg(F.sum(p.target).alias("total_qty"), F.count_if(F.col(p.target) > 0).alias("nonzero_months"), F.count("*").alias("total_months"))
    return out.withColumn("is_active", F.col("nonzero_months") >= min_nonzero)


def active_rows(df: DataFrame, min_nonzero: int = 12, p: Panel = Panel()) -> tuple[DataFrame, DataFrame]:
    """Rows of the active keys, by a semi join, and the summary."""
    summary = activity(df, min_nonzero, p)
    keys = summary.where("is_active").select(*[F.col(k).alias(f"_{k}") for k in p.key])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in p.key]
    return df.join(keys, on, "left_semi"), summary
