"""Panel, features, splits, metrics and forecasters on small rows."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.config import DEFAULTS, load_config
from millrace.functions import features as ft
from millrace.operators import forecast as fc
from millrace.operators import metrics as mt
from millrace.operators import panel as pn
from millrace.operators import profile as pf
from millrace.operators import splits as sp
from millrace.plans.pipeline import ValidationError, run_pipeline
from millrace.sources import files

KEY = ["subcategory", "sizing", "tactical"]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [("f", "c", s, z, "m", m, 2019, t, b, "x", q, 1.5 * q) for s, z, t, m, q, b in [("PUMP", "12 GA", "Y", 1, 10, 18.0), ("PUMP", "12 GA", None, 2, 5, None), ("PUMP", "20 GA", "N", 3, 7, 20.0), ("AUTO/X Y", "12 GA", "NA", 4, 3, None), ("AUTO/X Y", "10 GA", "N", 1, 2, 22.0), ("AUTO/X Y", "10 GA", None, 1, 4, 24.0), ("PUMP", "12 GA", "Y", 4, 1, 26.0), ("PUMP", "20 GA", "N", 1, 2, None)]]
    return spark.createDataFrame(rows, files.RAW_SCHEMA).withColumn("date", files.month_start()).cache()


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(s, "12 GA" if k else "45/410 GA", "N", dt.date(2019 + m // 12, m % 12 + 1, 1), q, q * 2.0, 20.0, 1, 2.0) for k, (s, f) in enumerate([("A", lambda i: 100 + 10 * i), ("B", lambda i: 1 + i), ("C", lambda i: 500 + 5 * i)]) for m in range(24) for q in [f(m)]]
    return spark.createDataFrame(rows, "subcategory string, sizing string, tactical string, date date, quantity int, amount double, barrel_length double, transaction_count int, avg_price double").cache()


def test_cleaning(raw):
    out = pn.clean(raw)
    assert not set(out.columns) & set(pn.DROPPED) and out.count() == 8
    assert out.where("tactical = 'NA'").count() == 1 and out.where("tactical = 'N'").count() == 5 and out.where("tactical is null").count() == 0


def test_month_start_of_bad_parts(spark):
    rows = spark.createDataFrame([(2020, 13), (2020, 2), (None, 1), (2020, None), (0, 1)], "year_ int, month_number int")
    assert [r[0] for r in rows.select(files.month_start()).collect()] == [None, dt.date(2020, 2, 1), None, None, None]


def test_panel_is_gapless_and_conserves(raw):
    b = pn.build(pn.clean(raw), start="2019-01-01", end="2023-12-01")
    assert b.panel.count() == b.panel.select(KEY).distinct().count() * 60
    assert b.panel.agg(F.sum("quantity")).first()[0] == 34
    zero = b.panel.where("transaction_count = 0").agg(F.max("quantity"), F.max("amount"), F.max("avg_price")).first()
    assert tuple(zero) == (0, 0.0, 0.0)
    assert all(r["ok"] for r in pn.validate(raw, b).collect())
    assert not all(r["ok"] for r in pn.validate(raw, b, expected_rows=9).collect())


def test_attribute_is_a_mean_of_monthly_means(raw):
    got = {tuple(r[k] for k in KEY) + (r["date"].month,): r["barrel_length"] for r in pn.build(pn.clean(raw)).panel.collect()}
    assert got["PUMP", "12 GA", "Y", 1] == 18.0 and got["PUMP", "12 GA", "Y", 2] == 22.0
    # Monthly means are 18, 26, 20, 23; two products have none of their own.
    assert got["AUTO/X Y", "12 GA", "NA", 1] == got["PUMP", "12 GA", "N", 4] == pytest.approx(21.75)


def test_null_keys_keep_their_actuals(spark, raw):
    out = pn.build(raw).panel.where("tactical is null")
    assert out.agg(F.sum("quantity")).first()[0] == 9


def test_empty_panel(raw):
    b = pn.build(pn.clean(raw).limit(0))
    assert b.panel.count() == 0 and all(r["ok"] for r in pn.validate(raw.limit(0), b).collect())
    assert sp.folds(b.panel).count() == 0


def test_pipeline_round_trip(spark, raw, tmp_path):
    plain = raw.drop("date")
    for y in (2019, 2020):
        plain.where(F.col("year_") == y).coalesce(1).write.csv(f"{tmp_path}/raw/{y}.csv", header=True)
    config = tmp_path / "c.yaml"
    config.write_text("years: [2019, 2020]\nexpected_raw_rows: 8\n")
    out = run_pipeline(spark, f"{tmp_path}/raw", f"{tmp_path}/out", str(config))
    assert out.count() == 5 * 4 or out.count() == out.select(KEY).distinct().count() * 4
    assert out.where("tactical = 'NA'").count() == 4
    config.write_text("years: [2019, 2020]\nexpected_raw_rows: 9\n")
    with pytest.raises(ValidationError, match="raw_rows"):
        run_pipeline(spark, f"{tmp_path}/raw", f"{tmp_path}/out2", str(config))
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.yaml"))


def test_calendar_and_seasons(spark):
    df = spark.createDataFrame([(dt.date(2020, m, 1),) for m in range(1, 13)] + [(dt.date(2022, 1, 1),), (dt.date(2021, 12, 1),)], "date date")
    rows = ft.seasons(ft.calendar(df)).collect()
    for r in rows:
        m = r["date"].month
        assert r["is_waterfowl_season"] == (m in (10, 11, 12, 1)) and r["is_dove_season"] == (m in (9, 10, 11))
        assert r["hunting_intensity"] == sum(r[f"is_{s}_season"] for s in DEFAULTS["seasons"])
        assert r["months_to_hunting"] == (22 - m) % 12 and -1 <= r["month_sin"] <= 1
        assert r["covid_period"] == (dt.date(2020, 3, 1) <= r["date"] <= dt.date(2021, 12, 1)) and r["post_covid"] == (r["date"].year == 2022)
    assert ft.seasons(df, {}).first()["hunting_intensity"] == 0


def test_features_stay_in_their_series(panel):
    out = ft.feature_set(panel, c=DEFAULTS)
    assert len(out.columns) == 48
    by = {(r["subcategory"], r["time_index"]): r for r in out.collect()}
    for s, f in (("A", lambda i: 100 + 10 * i), ("B", lambda i: 1 + i), ("C", lambda i: 500 + 5 * i)):
        for i in range(24):
            r = by[s, i]
            for n in (1, 3, 6, 12):
                assert r[f"quantity_lag_{n}"] == (f(i - n) if i >= n else None)
            assert r["quantity_ma_3"] == pytest.approx(np.mean([f(j) for j in range(max(0, i - 2), i + 1)]))
            assert r["quantity_std_3"] == pytest.approx(np.std([f(j) for j in range(max(0, i - 2), i + 1)], ddof=1) if i else 0.0)
            assert r["subcat_share"] == pytest.approx(1.0)
    assert {r["sizing_grouped"] for r in by.values()} == {"12 GA", "45/410 GA"}
    assert "is_a" in out.columns and "is_c" not in out.columns  # C sells most
    assert len(files.to_pandas(out)) == 36
    assert not set(ft.model_features(out)) & (ft.NOT_FEATURES | ft.LEAKING)
    assert ft.rolling(panel, (3,), exclude_current=True).where("quantity_ma_3 is null").count() == 3


def test_folds(spark):
    rows = [(s, dt.date(2020 + m // 12, m % 12 + 1, 1), q) for s, q in (("a", 1), ("b", 2)) for m in range(48)]
    df = spark.createDataFrame(rows, "subcategory string, date date, quantity long")
    plan = sp.folds(df).cache()
    assert plan.count() == 8
    info = sp.fold_info(df, plan).orderBy("fold").collect()
    assert [r["train_size"] for r in info] == [2 * (24 + 3 * k) for k in range(8)] and {r["val_size"] for r in info} == {6}
    assert all(r["train_end"] < r["val_start"] for r in info)
    got = sp.assign(df, plan).groupBy("fold", "role").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n")).collect()
    by = {(r["fold"], r["role"]): r for r in got}
    for r in info:
        assert by[r["fold"], "train"]["n"] == r["train_size"] and by[r["fold"], "validation"]["a"].isoformat() == r["val_start"]
    split = sp.fixed_split(df, "2022-12-31", "2023-06-30").groupBy("split").count().collect()
    assert {r[0]: r[1] for r in split} == {"train": 72, "validation": 12, "test": 12}
    assert sp.folds(df, min_train=46, horizon=3).count() == 0
    with pytest.raises(ValueError, match="1 or more"):
        sp.folds(df, step=0)


def test_activity(spark):
    rows = [(s, "z", "N", dt.date(2020 + m // 12, m % 12 + 1, 1), q(m)) for s, q in (("on", lambda m: 5), ("some", lambda m: int(m < 11)), ("off", lambda m: 0)) for m in range(48)]
    df = spark.createDataFrame(rows, "subcategory string, sizing string, tactical string, date date, quantity long")
    for least, n in ((12, 1), (11, 2)):
        kept, summary = sp.active_rows(df, least)
        assert kept.count() == 48 * n and summary.count() == 3 and summary.where("is_active").count() == n


def _scored(spark, y, p):
    return mt.evaluate(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(y, p, strict=True)], "g int, actual double, predicted double"), ["g"]).first()


def test_metrics(spark):
    assert _scored(spark, [1, 2, 3], [1, 2, 3])["rmse"] == 0
    assert _scored(spark, [1, 2, 3], [1, 3, 5])["rmse"] == pytest.approx(math.sqrt(5 / 3))
    assert _scored(spark, [1, 2, 3], [2, 2, 5])["mae"] == 1
    assert _scored(spark, [0, 10, 20], [5, 12, 18])["mape"] == pytest.approx(15)
    assert _scored(spark, [0, 0], [5, 1])["mape"] == 0
    folds = spark.createDataFrame([(k, float(k), 2.0 * k, 3.0) for k in (1, 2, 3)], "fold int, rmse double, mae double, mape double")
    got = {r["metric"]: r for r in mt.across_folds(folds).collect()}
    assert set(got) == {"rmse", "mae", "mape"} and got["rmse"]["mean"] == 2 and got["rmse"]["std"] == 1 and got["mae"]["max"] == 6


def test_t_distribution():
    assert mt.t_cdf(0, 7) == 0.5 and mt.t_cdf(-2.02, 7) == pytest.approx(0.0415, abs=5e-4) and mt.t_cdf(0.71, 7) == pytest.approx(0.75, abs=2e-3)
    for q in (0.025, 0.5, 0.9, 0.999):
        assert mt.t_cdf(mt.t_quantile(q, 5), 5) == pytest.approx(q)
    assert mt.t_quantile(0.95, 7) == pytest.approx(1.8946, abs=1e-4)


def test_paired_test(spark):
    def test(a, b, **k):
        return mt.paired_ttest(spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double"), "a", "b", **k)

    up = [3, 5, 4, 6, 7, 5, 4, 6]
    r = test(up, [x - 1 for x in up])
    assert len(r) == 9 and r["reject_null"] and r["t_statistic"] == -math.inf and r["p_value"] == 0 and r["ci_lower"] == -math.inf
    same = test(up, up)
    assert math.isnan(same["p_value"]) and not same["reject_null"]
    assert test([100] * 8, [10] * 8)["reject_null"]
    rng = random.Random(1)
    noisy = test(up, [x + rng.gauss(0, 1) for x in up], alternative="two-sided")
    assert noisy["ci_lower"] < noisy["ci_upper"] and 0 <= noisy["p_value"] <= 1
    text = mt.report(r, "Ridge", "Boosted", alpha=0.1)
    assert "Ridge" in text and "Boosted" in text and "90% CI" in text and "reject" in text
    with pytest.raises(ValueError, match="two pairs"):
        test([1], [2])


def _series(spark, n, h, f):
    rows = [(1, "A", "z", "N", dt.date(2019 + m // 12, m % 12 + 1, 1), f(m), "train" if m < n - h else "validation") for m in range(n)]
    return spark.createDataFrame(rows, "fold int, subcategory string, sizing string, tactical string, date date, quantity long, role string")


def test_seasonal_naive(spark):
    got = fc.seasonal_naive(_series(spark, 27, 3, lambda m: m)).orderBy("date").collect()
    assert [r["predicted"] for r in got] == [12, 13, 14]
    long = fc.seasonal_naive(_series(spark, 50, 26, lambda m: m), max_horizon=26).orderBy("date").collect()
    assert [r["predicted"] for r in long] == [12 + k % 12 for k in range(26)]
    assert all(r["predicted"] is None for r in fc.seasonal_naive(_series(spark, 8, 3, lambda m: m)).collect())


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(30, 5))
    y = x @ np.arange(5) + rng.normal(size=30)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], [*"abcde", "y"])
    model = fc.fit_ridge(fc.assemble(df, list("abcde"), "y", []), 2.5)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2.5 * np.eye(5), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-8) and model.intercept == pytest.approx(y.mean() - x.mean(0) @ want)


def test_boosting_importance_and_tuning(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b), float(3 * a + 10)) for a, b in rng.normal(size=(60, 2))], "a double, b double, y double")
    rows = fc.assemble(df, ["a", "b"], "y", []).withColumn("k", F.monotonically_increasing_id() % 3)
    train, val = rows.where("k < 2").drop("k"), rows.where("k = 2").drop("k")
    model = fc.fit_boosted(train, fc.Boosting(trees=3, depth=3), val)
    top = fc.importance(model, ["a", "b"]).collect()
    assert top[0]["feature"] == "a" and sum(r["importance"] for r in top) == pytest.approx(1)
    assert fc.importance(model).first()["feature"] == "f0"
    best, trials = fc.tune(train, val, space={"trees": ("int", 1, 3, 1), "rate": ("log", 0.1, 0.5, 0)}, trials=3)
    assert trials.count() == 3 and 1 <= best.trees <= 3 and 0.1 <= best.rate <= 0.5


def test_queries_fit_the_whole_job(spark, monkeypatch):
    """All folds for sarima, and the default trees for gbt and importance."""
    from millrace.plans import queries as q

    folds, trees = [], []

    def fake_sarima(df):
        folds.append(df.select("fold").distinct().count())
        rows = df.where("role = 'validation'")
        return rows.select("fold", F.col("quantity").alias("actual"), F.lit(0.0).alias("predicted"))

    def fake_fit(train, how):
        trees.append(how.trees)
        raise StopIteration

    monkeypatch.setattr(q.fc, "sarima", fake_sarima)
    monkeypatch.setattr(q.fc, "fit_boosted", fake_fit)
    monkeypatch.setattr(q, "_matrix", lambda *_: (None, None, []))
    panel = _series(spark, 36, 3, lambda m: m).drop("role", "fold")
    monkeypatch.setattr(q, "_panel", lambda *_: panel)
    n = q.sp.folds(panel).count()
    got = q.sarima(spark, "").collect()
    assert folds == [n] and n > 1 and len(got) == 1
    for name in ("gbt", "importance"):
        with pytest.raises(StopIteration):
            getattr(q, name)(spark, "")
    assert trees == [100, 100]


def test_fits_read_a_stored_matrix(spark, monkeypatch):
    """Tasks of a fit carry neither windows nor a cached plan, few rows are few tasks, and all rows are there."""
    from millrace.plans import queries as q

    keys = spark.createDataFrame([("a", "Brand#11", "N"), ("b", "Brand#12", "Y")], "subcategory string, sizing string, tactical string")
    months = spark.sql("select explode(sequence(date'1995-01-01', date'2001-12-01', interval 1 month)) as date")
    n = F.month("date") + F.length("sizing") * F.year("date")
    panel = keys.crossJoin(months).select(*q.KEY, "date", n.cast("long").alias("quantity"), (n * 2.0).alias("amount"), F.lit(3.0).alias("barrel_length"), F.lit(1).cast("long").alias("transaction_count"), (n / 7).alias("avg_price"))
    monkeypatch.setattr(q, "_panel", lambda *_: panel)
    train, val, names = q._matrix(spark, "")
    for df, rows in ((train, 2 * 48), (val, 2 * 12)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "Window" not in plan and "InMemoryTableScan" not in plan and df.rdd.getNumPartitions() == 1
        assert df.count() == rows
    direct = q.ft.feature_set(panel, None, q.SETTINGS)
    assert names == q.ft.model_features(direct)
    want = fc.assemble(q.sp.fixed_split(direct, *q.SETTINGS["split"]), names, "quantity", [*q.KEY, "date", "split"])
    order = [*q.KEY, "date"]
    assert train.unionByName(val).orderBy(*order).collect() == want.where("split <> 'test'").orderBy(*order).collect()


def test_sarima(spark):
    y = np.array([10 + 5 * math.sin(m * math.pi / 6) + 0.2 * m for m in range(60)])
    assert np.abs(fc.sarima_forecast(y[:57], 3) - y[57:]).max() < 1
    with pytest.raises(ValueError, match="too short"):
        fc.sarima_forecast(y[:10], 3)
    assert np.isfinite(fc.sarima_forecast(np.arange(1.0, 37), 3, (1, 0, 0), (0, 0, 0, 12))).all()
    got = fc.sarima(_series(spark, 8, 3, lambda m: m)).collect()
    assert all(r["failed"] and r["predicted"] == 2 for r in got) and len(got) == 3


def test_profiles(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "a"), (3, 3.0, "a"), (3, 3.0, "a")], "x int, y double, z string")
    assert {r["column"]: (r["nulls"], r["pct"]) for r in pf.null_profile(df).collect()}["z"] == (1, 25)
    assert tuple(pf.excess_duplicates(df, ["x", "z"]).first()) == (1, 1)
    assert {r["bin"]: r["n"] for r in pf.histogram(df, "x", 2).collect()} == {1: 1, 2: 3}
    assert pf.histogram(df.where("x = 3"), "x", 5).first()["bin"] == 1
    corr = pf.correlations(df.withColumn("c", F.lit(1)), ["x", "y", "c"])
    got = {(r["a"], r["b"]): r["r"] for r in corr.collect()}
    assert got["x", "y"] == pytest.approx(1) and got["x", "c"] is None
    assert pf.high_correlations(corr, 0.9, (("y", "x"),)).first()["class"] == "Expected"
    assert pf.target_correlations(df, "x", ["y"]).first()["feature"] == "y"
    assert {r["column"]: r["distinct"] for r in pf.inventory(df).collect()} == {"x": 3, "y": 3, "z": 1}
    assert pf.top(df, "x", 1, "y").first()["x"] == 3 and pf.mark_best(df, "y", "x").where("best").first()["x"] == 1
    assert files.extra_columns(df, df.drop("z")) == ["z"] and files.union_all([df, df, df]).count() == 12


def test_stream_rollup(spark, tmp_path):
    from millrace.streaming.rollup import monthly_stream

    rows = spark.createDataFrame([("a", "b", "N", dt.datetime(2020, m, d), 2, 1.0) for m in (1, 2) for d in (1, 9)], "subcategory string, sizing string, tactical string, ts timestamp, quantity long, amount double")
    rows.write.parquet(f"{tmp_path}/in")
    q = monthly_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("rollup").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        assert sorted((r["date"].month, r["quantity"]) for r in spark.table("rollup").collect()) == [(1, 4), (2, 4)]
    finally:
        q.stop()
