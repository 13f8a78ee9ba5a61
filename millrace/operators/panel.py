"""Raw rows to a gapless monthly panel: cleaning, roll-up, spine, zero fill, attribute cascade, checks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Panel

DROPPED = ("type", "category", "month_name", "trigger_action", "month_number", "year_")


class Built(NamedTuple):
    panel: DataFrame
    monthly: DataFrame


def clean(df: DataFrame, column: str = "tactical", missing: str = "N", drop: tuple[str, ...] = DROPPED) -> DataFrame:
    """Null ``column`` becomes ``missing`` ('NA' is a value like others); ``drop`` goes; no row does."""
    return df.withColumn(column, F.coalesce(column, F.lit(missing))).drop(*drop)


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def monthly(df: DataFrame, p: Panel = Panel()) -> DataFrame:
    """One row for each month and key that has transactions."""
    out = df.groupBy(p.date, *p.key).agg(
        F.sum(p.target).cast("long").alias(p.target),
        F.sum(p.amount).cast("double").alias(p.amount),
        F.avg(p.attribute).alias(p.attribute),
        F.count("*").alias("transaction_count"),
    )
    return out.withColumn("avg_price", ratio(F.col(p.amount), F.col(p.target)))


def spine(df: DataFrame, p: Panel = Panel(), start: str | None = None, end: str | None = None) -> DataFrame:
    """One row with the array ``months``, from the first to the last month of ``df`` or the bounds given."""
    lo = F.lit(start).cast("date") if start else F.min(p.date)
    hi = F.lit(end).cast("date") if end else F.max(p.date)
    return df.agg(lo.alias("lo"), hi.alias("hi")).where("lo is not null").select(F.expr("sequence(lo, hi, interval 1 month)").alias("months"))


def build(df: DataFrame, p: Panel = Panel(), start: str | None = None, end: str | None = None) -> Built:
    """The zero-filled panel of cleaned rows, and the roll-up it was made from.

    Products times months is an explode of one broadcast row, so the grid is made where the
    products are; the join with the actuals is null-safe, so a null key part keeps its actuals.
    """
    agg = monthly(df, p)
    months = spine(df.select(p.date), p, start, end)
    # One row is all that is broadcast.
    grid = agg.select(*p.key).distinct().crossJoin(F.broadcast(months)).select(*p.key, F.explode("months").alias(p.date))
    right = agg.select(*[F.col(k).alias(f"_r_{k}") for k in (*p.key, p.date)], p.target, p.amount, p.attribute, "transaction_count", "avg_price")
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in (*p.key, p.date)]
    full = grid.join(right, on, "left").drop(*[f"_r_{k}" for k in (*p.key, p.date)])
    full = full.fillna({p.target: 0, p.amount: 0.0, "transaction_count": 0, "avg_price": 0.0})
    return Built(cascade(full, p).select(*p.key, p.date, p.target, p.amount, p.attribute, "transaction_count", "avg_price"), agg)


def cascade(df: DataFrame, p: Panel = Panel()) -> DataFrame:
    """The attribute, else the mean of the product's monthly means, else the mean of all monthly means."""
    total = df.agg(F.avg(p.attribute).alias("_all"))
    own = F.avg(p.attribute).over(Window.partitionBy(*p.key))
    return df.withColumn("_own", own).crossJoin(F.broadcast(total)).withColumn(p.attribute, F.coalesce(p.attribute, "_own", "_all")).drop("_own", "_all")


def validate(raw: DataFrame, built: Built, p: Panel = Panel(), expected_rows: int | None = None) -> DataFrame:
    """Checks as rows ``check``, ``expected``, ``actual``, ``ok``: an aggregate a table, no other pass."""
    r = raw.agg(F.count("*").alias("rows"), F.coalesce(F.sum(p.target), F.lit(0)).cast("long").alias("qty"), F.count_if(F.col(p.target) < 0).alias("neg"))
    a = built.monthly.agg(F.coalesce(F.sum(p.target), F.lit(0)).cast("long").alias("agg_qty"))
    nulls = sum((F.col(c).isNull().cast("int") for c in (p.date, *p.key, p.target, p.amount)), F.lit(0))
    f = built.panel.agg(F.count("*").alias("panel_rows"), (F.count_distinct(F.struct(*p.key)) * F.count_distinct(p.date)).alias("cells"), F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("nulls"))
    one = r.crossJoin(a).crossJoin(f)
    tests = [("raw_rows", F.lit(expected_rows).cast("long") if expected_rows else F.col("rows"), F.col("rows")), ("target_conserved", F.col("qty"), F.col("agg_qty")), ("no_negatives", F.lit(0).cast("long"), F.col("neg")), ("panel_size", F.col("cells"), F.col("panel_rows")), ("no_null_keys", F.lit(0).cast("long"), F.col("nulls"))]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), e.alias("expected"), x.alias("actual"), (e == x).alias("ok")) for n, e, x in tests])
    return one.select(F.explode(rows).alias("t")).select("t.*")
