import numpy as np
import pytest
from pyspark.sql import functions as F

from stagecast.operators import models as M
from stagecast.operators import robust as RB


def test_trimmed_median_equals_median():
    for xs in ([1, 2, 3, 4], [5, 1, 9, 3, 7], [2.0, 2.0, 8.0, 100.0, -4.0, 3.5]):
        x = sorted(xs)
        t = x[1:-1] if len(x) >= 4 else x
        assert np.median(t) == np.median(x)


def test_seasonality_small_n_empty_months_and_clips(spark):
    rows = [("c", 1, 100.0)] * 6 + [("c", 7, 140.0)] * 5 + [("c", 6, 95.0)] + \
           [("d", 1, 100.0)] * 6 + [("d", 2, 60.0)] * 5
    df = spark.createDataFrame(rows, "category string, month int, ticket_median double")
    t = {(r.category, r.month): r for r in RB.seasonality_table(df).collect()}
    assert len(t) == 24                                            # 12 months per category
    assert t[("c", 3)].n == 0 and t[("c", 3)].factor == 1.0        # empty month -> 1.0
    assert t[("c", 12)].n == 0 and t[("c", 12)].factor == 1.0      # winter pool with n = 0 -> w = 0
    assert t[("c", 7)].factor == pytest.approx(1.15)               # 1 + 5/8 * 0.4 = 1.25 -> upper clip
    assert t[("c", 6)].factor == pytest.approx(1 + 0.25 * (0.95 - 1))   # n = 1 shrinks hard
    assert t[("d", 2)].factor == pytest.approx(0.90)               # 1 + 5/8 * (-0.4) = 0.75 -> lower clip
    for r in t.values():
        assert 0.9 <= r.factor <= 1.15


def test_iqr_filter_drops_outlier(spark):
    df = spark.createDataFrame([("c", float(v)) for v in [10, 11, 12, 13, 14, 1000]], "category string, v double")
    kept = [r.v for r in RB.iqr_filter(df, "category", "v").collect()]
    assert 1000.0 not in kept and len(kept) == 5


def _sk_ridge(x, y, alpha):
    xm, ym = x.mean(), y.mean()
    b = ((x - xm) * (y - ym)).sum() / (((x - xm) ** 2).sum() + alpha)
    return b, ym - b * xm


def test_anchored_ridge_matches_explicit_rows(spark):
    rng = np.random.default_rng(42)
    x = rng.uniform(40, 160, 11)
    y = 0.8 * x + rng.normal(0, 5, 11)
    a = max(3, len(x) // 2)
    X = np.concatenate([x, np.zeros(a), np.full(a, 100.0)])
    Y = np.concatenate([y, np.full(a, 25.0), np.full(a, 100.0)])
    b, c = _sk_ridge(X, Y, 5.0)
    df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(x, y)], "SignalOnly double, TicketIndex_DeSeason double")
    r = M.anchored_ridge(df).first()
    assert r.slope == pytest.approx(b, rel=1e-10) and r.intercept == pytest.approx(c, rel=1e-10)
    assert r.anchor_0 == pytest.approx(c)


def test_overall_needs_five_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 4, "SignalOnly double, TicketIndex_DeSeason double")
    assert M.anchored_ridge(df).count() == 0


def test_group_fit_ols_ridge_and_flat_x(spark):
    rows = [("a", float(i), 2.0 * i + 1) for i in range(3)] + [("b", 5.0, float(v)) for v in (1, 2, 3, 4)] + \
           [("c", float(i), float(i)) for i in range(6)] + [("d", 1.0, 1.0)] * 2
    df = spark.createDataFrame(rows, "category string, SignalOnly double, TicketIndex_DeSeason double")
    g = {r.category: r for r in M.group_fit(df).collect()}
    assert "d" not in g                                   # fewer than 3 rows -> no model
    assert g["a"].slope == pytest.approx(2.0) and g["a"].intercept == pytest.approx(1.0)   # OLS
    assert g["b"].slope == 0.0 and g["b"].intercept == pytest.approx(2.5)                  # flat x guard
    b, c = _sk_ridge(np.arange(6.0), np.arange(6.0), 1.0)                                  # ridge alpha 1
    assert g["c"].slope == pytest.approx(b) and g["c"].intercept == pytest.approx(c)


def test_fit_metrics_zero_variance(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(5)], "SignalOnly double, TicketIndex_DeSeason double")
    perfect = spark.createDataFrame([(0.0, 5.0)], "slope double, intercept double")
    off = spark.createDataFrame([(0.0, 6.0)], "slope double, intercept double")
    assert M.fit_metrics(df, perfect).first().R2 == 1.0
    r = M.fit_metrics(df, off).first()
    assert r.R2 == 0.0 and r.MAE == pytest.approx(1.0)


def test_tiered_impute_sources_and_clip(spark):
    rows = [("h", "a", 50.0, 77.0), ("p", "a", 500.0, None), ("o", "z", 10.0, None)]
    df = spark.createDataFrame(rows, "title string, category string, SignalOnly double, TicketIndex_DeSeason double")
    g = spark.createDataFrame([("a", 1.0, 0.0)], "category string, slope double, intercept double")
    o = spark.createDataFrame([(1.0, 1.0)], "slope double, intercept double")
    r = {x.title: x for x in M.tiered_impute(df, o, g).collect()}
    assert r["h"].TicketIndexSource == "History" and r["h"].TicketIndex_DeSeason_Used == 77.0
    assert r["p"].TicketIndexSource == "ML Category" and r["p"].TicketIndex_DeSeason_Used == 180.0
    assert r["o"].TicketIndexSource == "ML Overall" and r["o"].TicketIndex_DeSeason_Used == 20.0
    none = spark.createDataFrame([], "slope double, intercept double")
    r2 = M.tiered_impute(df.where(F.col("title") == "o"), none, g).first()
    assert r2.TicketIndexSource == "Not enough data" and r2.TicketIndex_DeSeason_Used is None


def test_expanding_backtest_uses_only_past(spark):
    rows = [("c", i, float(i), 2.0 * i) for i in range(6)]
    df = spark.createDataFrame(rows, "category string, t int, x double, y double")
    out = {r.t: r for r in M.expanding_backtest(df, "category", ["t"], "x", "y", F.floor(F.col("t") / 2)).collect()}
    assert out[0].prediction is None and out[1].prediction is None
    assert out[5].prediction == pytest.approx(10.0) and out[5].train_rows == 5
