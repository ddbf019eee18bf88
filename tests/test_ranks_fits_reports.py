import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from stagecast.operators import explain as EX
from stagecast.operators import joins as J
from stagecast.operators import models as M
from stagecast.operators import runs as R
from stagecast.plans import season as SE
from stagecast.sources import io as IO


def test_global_rank_equals_sql_rank(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, round(rng.uniform(-50, 150), 1), 100.0]), rng.choice([None, float(rng.randrange(4))])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    df.createOrReplaceTempView("ranked_rows")
    want = {r.id: r.r for r in spark.sql("SELECT id, rank() OVER (ORDER BY a DESC NULLS LAST, b DESC NULLS LAST) AS r FROM ranked_rows").collect()}
    out = SE.global_rank(df, "a", "b")
    assert {r["id"]: r["rank"] for r in out.collect()} == want and len(want) == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_b" in plan and "windowspecdefinition(_x" not in plan      # no window over all rows
    assert SE.global_rank(df.where("id < 0"), "a", "b").count() == 0


def centred_ridge(x, y, alpha, anchors):
    n, k = x.shape
    if anchors:
        c = max(3, n // 2)
        x = np.vstack([x, np.zeros((c, k)), np.tile(x.mean(axis=0), (c, 1))])
        y = np.concatenate([y, np.full(c, 25.0), np.full(c, 100.0)])
    xm, ym = x.mean(axis=0), y.mean()
    beta = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(k), (x - xm).T @ (y - ym))
    return beta, ym - beta @ xm


@pytest.mark.parametrize("centre,anchors", [(0.0, True), (50.0, True), (1e8, False)])
def test_ridge_agrees_with_centred_numpy(spark, centre, anchors):
    rng = np.random.default_rng(3)
    x = centre + rng.normal(0, 10, (400, 4))
    y = centre + (x - centre) @ np.array([0.3, -0.2, 0.25, 1.0]) + rng.normal(0, 3, 400)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double").repartition(7)
    fit = EX.fit_multi_ridge(df, list("abcd"), "y", alpha=5.0, anchors=anchors).first()
    beta, icpt = centred_ridge(x, y, 5.0, anchors)
    assert np.allclose([fit[f"beta_{f}"] for f in "abcd"], beta, rtol=1e-9, atol=1e-9)
    at = x.mean(axis=0)
    assert abs(fit["intercept"] + beta @ at - (icpt + beta @ at)) <= 1e-9 * max(1.0, abs(icpt))
    assert np.allclose([fit[f"mean_{f}"] for f in "abcd"], at, rtol=1e-12) and fit["n"] == 400


def test_ridge_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(50.0, 40.0, 100.0)], "a double, b double, y double")
    fit = EX.fit_multi_ridge(df, ["a", "b"], "y").first()
    beta, icpt = centred_ridge(np.array([[50.0, 40.0]]), np.array([100.0]), 5.0, True)
    assert np.allclose([fit["beta_a"], fit["beta_b"], fit["intercept"]], [*beta, icpt])
    none = EX.fit_multi_ridge(df.where("a < 0"), ["a", "b"], "y").first()
    assert none["n"] == 0 and none["beta_a"] is None and none["mean_a"] == 0.0


def test_backtest_with_large_means(spark):
    rng = np.random.default_rng(5)
    x, order = 1e8 + rng.normal(0, 1, 300), np.arange(300)
    y = 1e8 + 2.0 * (x - 1e8) + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([("g", int(o), float(a), float(b)) for o, a, b in zip(order, x, y)], "g string, o int, x double, y double")
    got = {r.o: r.prediction for r in M.expanding_backtest(df, "g", ["o"], "x", "y", F.floor(F.col("o") / 25)).collect()}
    for i in (1, 10, 26, 150, 299):
        if i < 2:
            assert got[i] is None
            continue
        a, b = x[:i], y[:i]
        slope = ((a - a.mean()) * (b - b.mean())).sum() / ((a - a.mean()) ** 2).sum()
        assert abs(got[i] - (b.mean() + slope * (x[i] - a.mean()))) < 1e-9 * 1e8


def test_running_medians(spark):
    rng = random.Random(2)
    day0 = dt.date(1900, 1, 1)
    rows = [(k, n, day0 + dt.timedelta(days=61 * n), day0, rng.choice([None, float(rng.randrange(50))])) for k in "abc" for n in range(rng.randrange(1, 80))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "title string, run_no int, run_start date, run_end date, tickets double")
    got = {(r.title, r.run_no): r for r in R.modelling_dataset(df).collect()}
    for k, n, start, _, v in rows:
        earlier = [x for kk, m, _, _, x in rows if kk == k and m < n and x is not None]
        r = got[k, n]
        assert r.prior_median == (float(np.median(earlier)) if earlier else None) and r.prior_run_count == len(earlier) and r.target == v
        assert r.years_since_last == (61 / 365.25 if n else None)


def test_median_of_one_long_title(spark):
    """100,000 runs of one title: linear times logarithm."""
    n = 100_000
    df = spark.range(n).selectExpr("1 AS title", "int(id) AS run_no", "date_add(date'1800-01-01', int(id)) AS run_start",
                                   "date'1800-01-01' AS run_end", "double(pmod(xxhash64(id), 1000)) AS tickets")
    began = time.time()
    last = R.modelling_dataset(df).where(f"run_no = {n - 1}").first()
    assert time.time() - began < 60
    assert last.prior_median == np.median([r[0] for r in df.where(f"run_no < {n - 1}").select("tickets").collect()])


def test_asof_within_one_hot_day(spark):
    """All rows on one key and day, and some at one time: the day is cut, the result is the same."""
    left = spark.range(3000).selectExpr("'k' AS k", "id AS l", "timestamp_micros(1700000000000000 + pmod(xxhash64(id), 40000) * 1000000) AS ts")
    right = spark.range(2000).selectExpr("'k' AS k", "id AS r", "timestamp_micros(1700000000000000 + pmod(xxhash64(id, 1), 40000) * 1000000) AS ts")
    right = right.unionByName(spark.range(900).selectExpr("'k' AS k", "id + 5000 AS r", "timestamp_micros(1700000000000000 + 777000000) AS ts"))
    plain = J.asof_last(left, right, "k", "ts", ["r"], tie="r", bucket_seconds=None)
    cut = J.asof_last(left, right, "k", "ts", ["r"], tie="r", bucket_rows=100)
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect())) and cut.where("r is null").count() < 50
    rows = left.select(F.col("k").alias("_key"), F.struct(F.lit(1).alias("day"), F.lit(0).alias("part")).alias("_b"), F.col("ts").alias("_ts"))
    parts = J._in_parts(rows, J._day_cuts(rows, 100)).groupBy("_b").count().collect()
    assert len(parts) > 40 and max(r["count"] for r in parts) < 200


def test_row_check_of_chained_joins_runs_with_the_one_job(spark):
    h = spark.createDataFrame([("t1", "x", dt.date(2020, 1, 1)), ("t2", "x", dt.date(2020, 1, 2))], "title string, city string, start_date date")
    spend = spark.createDataFrame([("t1", 5.0), ("t1", 6.0)], "title string, marketing_spend double")
    before, after = Observation(), Observation()
    assert len(J.chained_enrich(h, None, spend, checks=(before, after)).collect()) == 3
    assert before.get == {"rows": 2} and after.get == {"rows": 3}


def test_markdown_report_round_trip(spark, tmp_path):
    rows = [(i, f"name {i} | {'x' if i % 2 else 'y'}", None if i % 3 else i / 4) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, name string, `a b` double").repartition(6)
    path = str(tmp_path / "report")
    IO.write_markdown(df, path, ["id"])
    files = sorted((tmp_path / "report").glob("part-*"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    assert lines[:2] == ["| id | name | a b |", "|---|---|---|"] and lines[2].startswith("| 0 | name 0 \\| y | 0.0 |")
    assert [int(x.split(" ")[1]) for x in lines[2:]] == list(range(500))
    assert sorted(map(tuple, IO.read_markdown(spark, path, df.schema).collect())) == sorted(rows)
    IO.write_markdown(df.where("id < 0"), str(tmp_path / "none"))
    assert IO.read_markdown(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_remount_bins(spark):
    df = spark.createDataFrame([(0, None), (None, 1.0), (2, 1.0), (1, 3.0), (4, 9.0), (2, None)], "n int, years double")
    assert [r[0] for r in df.select(M.remount_bin(F.col("n"), F.col("years"))).collect()] == ["new", "new", "recent", "returning", "old", "recent"]
