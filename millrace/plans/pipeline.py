"""The whole batch job: load, clean, build the panel, check it, save it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Panel, load_config
from ..operators import panel as pn
from ..sources import files


class ValidationError(Exception):
    """Some check of the panel failed; the message lists them."""


def run_pipeline(spark: SparkSession, raw_dir: str, out: str, config_path: str | None = None, p: Panel = Panel(), pattern: str = "{year}.csv") -> DataFrame:
    """Returns the saved panel. The panel is written once and checked as written; ValidationError if a check fails.

    The caller owns the session.
    """
    c = load_config(config_path)
    raw = files.load_raw(spark, raw_dir, c["years"], pattern).cache()
    try:
        built = pn.build(pn.clean(raw), p, c.get("date_start"), c.get("date_end"))
        files.save_panel(built.panel, out, [p.date, *p.key])
        saved = files.load_parquet(spark, out, p.date)
        checks = pn.validate(raw, pn.Built(saved, built.monthly), p, c["expected_raw_rows"]).collect()
    finally:
        raw.unpersist()
    if wrong := [r for r in checks if not r["ok"]]:
        raise ValidationError("; ".join(f"{r['check']}: expected {r['expected']}, got {r['actual']}" for r in wrong))
    return saved
