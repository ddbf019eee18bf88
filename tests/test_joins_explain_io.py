import datetime as dt
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagecast.operators import explain as EX
from stagecast.operators import joins as J
from stagecast.sources import io as IO


def test_asof_matches_brute_force_with_hot_key_and_ties(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    right = [(u, base + dt.timedelta(hours=rnd.randint(0, 24 * 20)), float(i), i)
             for i, u in enumerate([1] * 300 + [rnd.randint(2, 6) for _ in range(100)])]
    right.append((1, right[0][1], 999.0, 10_000))                       # equal-ts tie -> larger id wins
    left = [(i, u, base + dt.timedelta(hours=rnd.randint(0, 24 * 20))) for i, u in
            enumerate([1] * 200 + [rnd.randint(1, 8) for _ in range(60)])]
    left.append((9999, 1, right[0][1]))                                 # equal ts: right counts as earlier
    L = spark.createDataFrame(left, "event_id int, user_id int, ts timestamp")
    R = spark.createDataFrame(right, "user_id int, ts timestamp, v double, rid int")
    got = {r.event_id: (r.v, r.rid) for r in J.asof_last(L, R, "user_id", "ts", ["v", "rid"], tie="rid",
                                                          bucket_seconds=3600 * 24).collect()}
    for eid, u, t in left:
        cands = [(rt, rid, v) for uu, rt, v, rid in right if uu == u and rt <= t]
        exp = (None, None) if not cands else (max(cands)[2], max(cands)[1])
        assert got[eid] == exp, eid
    assert len(got) == len(left)


def test_left_enrich_keeps_rows_and_drops_duplicate_columns(spark):
    left = spark.createDataFrame([(2020, "A", 1.0), (2021, "B", 2.0), (2022, "C", 3.0)], "year int, city string, x double")
    right = spark.createDataFrame([(2020, "A", 9.0, 5.0), (2021, "B", 9.0, 6.0)], "year int, city string, x double, f double")
    out = J.left_enrich(left, right)
    assert out.count() == 3 and out.columns == ["year", "city", "x", "f"]
    assert J.left_enrich(left, spark.createDataFrame([(1,)], "k int")).columns == left.columns
    dup = J.duplicate_keys(spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "a int, b int"), ["a", "b"])
    assert [tuple(r) for r in dup.collect()] == [(1, 1, 2)]


def test_hierarchical_lookups(spark):
    pri = spark.createDataFrame([("Calgary", "c1", "S1", 1.2), ("Province", "c1", "S1", 0.9), ("Province", "c1", "S2", 1.1)],
                                "region string, category string, segment string, weight double")
    keys = spark.createDataFrame([("calgary ", "C1", "s1"), ("Edmonton", "c1", "S1"), ("Edmonton", "c9", "S1")],
                                 "region string, category string, segment string")
    w = [(r.weight, r.weight_source) for r in J.hierarchical_lookup(keys, pri).collect()]
    assert w == [(1.2, "region"), (0.9, "fallback"), (1.0, "default")]
    s = J.hierarchical_lookup_set(spark.createDataFrame([("Calgary", "c1"), ("Edmonton", "c1")], "region string, category string"), pri)
    got = sorted((r.region, r.segment, r.weight_source) for r in s.collect())
    assert got == [("Calgary", "S1", "region"), ("Edmonton", "S1", "fallback"), ("Edmonton", "S2", "fallback")]


def test_exact_else_latest(spark):
    left = spark.createDataFrame([("A", dt.date(2024, 1, 2)), ("A", dt.date(2024, 3, 1)), ("Q", dt.date(2024, 1, 1))],
                                 "city string, d date")
    right = spark.createDataFrame([("A", dt.date(2024, 1, 2), -25.0), ("A", dt.date(2024, 1, 5), 1.0)],
                                  "city string, date date, t double")
    r = [(x.t, x.match) for x in J.exact_else_latest(left, right, "city", "d", "date", ["t"]).orderBy("d").collect()]
    assert sorted(r, key=str) == sorted([(-25.0, "exact"), (1.0, "latest"), (None, "none")], key=str)


def test_interval_overlap_agg_matches_brute_force(spark):
    rnd = random.Random(11)
    d0 = dt.date(2020, 1, 1)
    runs = []
    for k in ("a", "b"):
        for i in range(15):
            s = d0 + dt.timedelta(days=rnd.randint(0, 700))
            runs.append((k, i, s, s + dt.timedelta(days=rnd.randint(0, 60))))
    evs = []
    for j in range(400):
        s = d0 + dt.timedelta(days=rnd.randint(-100, 800))
        evs.append(("a" if j % 3 else "b", j, s, s + dt.timedelta(days=rnd.randint(-5, 400)), float(rnd.randint(1, 9))))
    R = spark.createDataFrame(runs, "k string, run_no int, s date, e date")
    E = spark.createDataFrame(evs, "k string, eid int, es date, ee date, q double")
    got = {(r.k, r.run_no): (r.n_events, r.sum_q) for r in
           J.interval_overlap_agg(R, E, "k", ["k", "run_no"], "s", "e", "es", "ee", ["q"]).collect()}
    for k, i, s, e in runs:
        ov = [q for kk, _, es, ee, q in evs if kk == k and es <= ee and es <= e and ee >= s]
        assert got[(k, i)] == (len(ov), float(sum(ov))), (k, i)


def _attr(spark, train_rows, test_rows, feats=("wiki", "trends", "youtube", "chartmetric")):
    cols = ", ".join(f"{f} double" for f in feats)
    tr = spark.createDataFrame(train_rows, cols + ", TicketIndex_DeSeason double")
    te = spark.createDataFrame(test_rows, cols)
    coefs = EX.fit_multi_ridge(tr, list(feats), "TicketIndex_DeSeason")
    a = EX.attribute(te, coefs, list(feats))
    return a.withColumn("c", EX.contributions(list(feats))), coefs


def test_attribution_additivity_order_and_nan(spark):
    rng = np.random.default_rng(42)
    X = np.column_stack([rng.uniform(10, 100, 30), rng.uniform(5, 80, 30), rng.uniform(0, 60, 30), rng.uniform(0, 50, 30)])
    y = 0.3 * X[:, 0] + 0.2 * X[:, 1] + 0.25 * X[:, 2] + 0.25 * X[:, 3] + rng.normal(0, 5, 30)
    train = [tuple(map(float, r)) + (float(v),) for r, v in zip(X, y)]
    test = [(75.0, 50.0, 40.0, 30.0), (float("nan"), 50.0, 40.0, 30.0), (float("inf"), 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0)]
    a, coefs = _attr(spark, train, test)
    for r in a.collect():
        s = r.shap_wiki + r.shap_trends + r.shap_youtube + r.shap_chartmetric
        assert r.base_value + s == pytest.approx(r.prediction, abs=0.1)
        imp = [c.abs_impact for c in r.c]
        assert imp == sorted(imp, reverse=True)
        assert all(c.direction == ("up" if c.shap > 0 else "down") for c in r.c)
    # coefficients equal an explicit solve on the data + anchor rows
    n = len(X)
    c = max(3, n // 2)
    XA = np.vstack([X, np.zeros((c, 4)), np.tile(X.mean(axis=0), (c, 1))])
    YA = np.concatenate([y, np.full(c, 25.0), np.full(c, 100.0)])
    xm, ym = XA.mean(axis=0), YA.mean()
    beta = np.linalg.solve((XA - xm).T @ (XA - xm) + 5.0 * np.eye(4), (XA - xm).T @ (YA - ym))
    row = coefs.first()
    assert [row.beta_wiki, row.beta_trends, row.beta_youtube, row.beta_chartmetric] == pytest.approx(list(beta), rel=1e-8)


def test_attribution_single_and_two_row_training(spark):
    a, _ = _attr(spark, [(50.0, 40.0, 30.0, 25.0, 100.0)], [(50.0, 40.0, 30.0, 25.0)])
    assert a.count() == 1
    a2, _ = _attr(spark, [(10.0, 20.0, 30.0, 40.0, 100.0), (50.0, 60.0, 70.0, 80.0, 120.0)], [(0.0, 0.0, 0.0, 0.0)])
    r = a2.first()
    assert np.isfinite(r.prediction)


def test_attribution_text_and_drivers(spark):
    a, _ = _attr(spark, [(float(i), float(2 * i), float(i % 7), float(i % 5), float(3 * i)) for i in range(1, 40)],
                 [(80.0, 10.0, 3.0, 1.0)])
    r = a.select(EX.attribution_text(F.col("prediction"), F.col("base_value"), F.col("c")).alias("t"),
                 EX.top_drivers(F.col("c"), 2, 0.0).alias("d"), EX.driver_sentence(F.col("c")).alias("s"),
                 EX.push_pull(F.col("c")).alias("p")).first()
    assert "tickets (" in r.t and len(r.d) <= 2
    assert r.s.startswith("Key upward drivers") or r.s.startswith("Offsetting") or r.s.startswith("Feature")
    assert all(x.contribution > 0 for x in r.p.positive)


def test_csv_reader_thousands_bom_quotes_and_fallback(spark):
    d = tempfile.mkdtemp(prefix="stagecast-io-", dir="/tmp")
    p = os.path.join(d, "sales.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿City,Show Title,Start Date,End Date,Single Tickets\n")
        f.write('calgary,"Swan Lake, Act II",2020-01-05,2020-01-09,"7,734"\n')
        f.write("edmonton,Giselle,2020-02-01,2020-02-03,-4\n")
        f.write("edmonton,Giselle,2020-03-01,2020-03-03,\n")
    df = IO.read_sales_history(spark, p).collect()
    assert len(df) == 1 and df[0].single_tickets == 7734.0 and df[0].show_title == "Swan Lake, Act II"
    assert df[0].start_date == dt.date(2020, 1, 5)
    assert IO.read_sales_history(spark, os.path.join(d, "missing.csv")).count() == 0
    with pytest.raises(IO.DataLoadError):
        IO.read_csv(spark, os.path.join(d, "missing.csv"))
    bad = os.path.join(d, "bad.csv")
    with open(bad, "w") as f:
        f.write("city,show_title,start_date,end_date,single_tickets\nx,y,2020-13-40,2020-01-01,5\n")
    lazily = IO.read_sales_history(spark, bad)          # no job reads the file ahead
    with pytest.raises(Exception, match="sales row without a valid start_date"):
        lazily.count()


def test_clean_frame_and_normalize(spark):
    df = spark.createDataFrame([(1, None, "x", "3.5"), (2, None, None, "3,5")],
                               "id int, `Unnamed: 0` string, `Unnamed: 1` string, `Val - A` string")
    out = IO.clean_frame(IO.normalize_columns(df), drop_empty_unnamed_only=True, numeric_columns=["val_a"])
    assert out.columns == ["id", "unnamed:_1", "val_a"]
    assert [r.val_a for r in out.collect()] == [3.5, None]      # a comma is no part of a number here
    assert IO.clean_frame(df).columns == ["id", "Val - A"]


def test_union_cities_and_tidy_slice(spark):
    a = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "date date, snow double")
    b = spark.createDataFrame([(dt.date(2024, 1, 1), -30.0)], "date date, min_temperature double")
    u = IO.union_cities({"Calgary": a, "Edmonton": b})
    assert u.count() == 2 and set(u.columns) == {"date", "snow", "min_temperature", "city"}
    s = spark.createDataFrame([("arts", "2019", "1,200"), ("arts", "n/a", "5"), ("other", "2019", "1")],
                              "section string, year_or_period string, value string")
    assert [tuple(r) for r in IO.tidy_slice(s, {"section": "arts"}).collect()] == [(2019, 1200.0)]


def test_sinks_and_generic_reader(spark):
    d = tempfile.mkdtemp(prefix="stagecast-sink-", dir="/tmp")
    df = spark.createDataFrame([("A", 1.5, "2020-01-02"), ("B", None, "bad")], "name string, v double, date string")
    IO.write_table(df, os.path.join(d, "out_csv"), "csv")
    IO.write_table(df, os.path.join(d, "out_pq"), "parquet", partition_by=["name"])
    back = spark.read.option("header", True).csv(os.path.join(d, "out_csv"))
    assert back.count() == 2 and spark.read.parquet(os.path.join(d, "out_pq")).count() == 2
    md = [r.line for r in IO.to_markdown_rows(df).orderBy("line").collect()]
    assert md == ["| A | 1.5 | 2020-01-02 |", "| B |  | bad |"]
    p = os.path.join(d, "factors.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿Date,WCS Oil Price,Unnamed: 3\n2024-01-05,1061.5,\n2024-02-05,\"1,061.5\",\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("Date", T.StringType()), T.StructField("WCS Oil Price", T.StringType()),
                           T.StructField("Unnamed: 3", T.StringType())])
    r = IO.read_source(spark, p, schema, date_cols=["date"], numeric_cols=["wcs_oil_price"]).orderBy("date").collect()
    assert [x.wcs_oil_price for x in r] == [1061.5, None] and r[0].date == dt.date(2024, 1, 5)
    assert "unnamed:_3" not in r[0].asDict()
    assert IO.read_source(spark, os.path.join(d, "nope.csv"), schema).count() == 0
    spend = spark.createDataFrame([("t", None, "2024-03-01")], "title string, start_date string, show_date string")
    assert IO.first_date_column(spend, ["start_date", "show_date"]).first().date_key == dt.date(2024, 3, 1)
