"""The monthly roll-up over a stream of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Panel


def monthly_stream(df: DataFrame, p: Panel = Panel(), event_time: str = "ts", late: str = "31 days") -> DataFrame:
    """Running sums by month and key of a streaming frame; for output modes update and complete.

    Rows later than the watermark are dropped, and a month's state goes once it is past.
    """
    month = F.trunc(event_time, "month").cast("timestamp")
    rows = df.withColumn("_month", month).withWatermark("_month", late)
    return rows.groupBy("_month", *p.key).agg(F.sum(p.target).alias(p.target), F.sum(p.amount).alias(p.amount), F.count("*").alias("transaction_count")).withColumn(p.date, F.col("_month").cast("date"))
