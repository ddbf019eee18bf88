import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagecast import config as C
from stagecast.plans.pipeline import ScoringPlan, plan_from_tables


def _plan(spark, benchmark=None, month=None):
    titles = spark.createDataFrame(
        [("Swan Lake", "classic_romance", "female"), ("Giselle", "classic_romance", "female"),
         ("Momix", "contemporary", "na"), ("Phi", "contemporary", "na"), ("New Work", "dramatic", "na")],
        "title string, category string, gender string")
    base = spark.createDataFrame(
        [("Swan Lake", 90.0, 60.0, 70.0, 50.0), ("Giselle", 80.0, 50.0, 60.0, 45.0),
         ("Momix", 60.0, 40.0, 80.0, 40.0), ("Phi", 50.0, 30.0, 50.0, 30.0)],
        "title string, wiki double, trends double, youtube double, chartmetric double")
    d0 = dt.date(2019, 3, 1)
    hist = spark.createDataFrame(
        [("Swan Lake", "Calgary", d0, 1000.0), ("Swan Lake", "Edmonton", d0 + dt.timedelta(days=8), 700.0),
         ("Swan Lake", "Calgary", dt.date(2022, 3, 3), 1300.0), ("Momix", "Calgary", d0, 300.0)],
        "title string, city string, start_date date, single_tickets double")
    pri = spark.createDataFrame([("Province", "classic_romance", s, 1.0) for s in C.SEGMENT_KEYS_IN_ORDER],
                                "region string, category string, segment string, weight double")
    cfg = C.ScoringConfig(proposed_month=month)
    return ScoringPlan(titles, base, hist, pri, cfg, benchmark_title=benchmark, materialize="none")


def test_not_enough_data_tier_and_estimates(spark):
    p = _plan(spark)
    rows = {r.title: r for r in p.scored.collect()}
    # default benchmark = smallest title key with history ("Momix" < "Swan Lake"): index 100 by construction
    assert rows["Momix"].TicketIndex_DeSeason == pytest.approx(100.0) and rows["Momix"].Familiarity == pytest.approx(100.0)
    assert rows["Swan Lake"].TicketIndexSource == "History"
    assert rows["Swan Lake"].TicketIndex_DeSeason == pytest.approx(1500.0 / 300.0 * 100.0)
    assert rows["Swan Lake"].run_count_prior == 2 and rows["Swan Lake"].TicketMedian == pytest.approx(1500.0)
    assert rows["Giselle"].TicketIndexSource == "Not enough data"       # 2 known rows: no overall / category model
    assert rows["Giselle"].TicketIndex_DeSeason_Used is None
    assert rows["Giselle"].Composite == pytest.approx(rows["Giselle"].SignalOnly)
    assert rows["Giselle"].EstimatedTickets is None and rows["Giselle"].EstimatedTickets_Final == 0.0
    assert rows["New Work"].Source == "Estimated"                       # no baseline row -> P11 estimate
    mix = rows["Swan Lake"].segment_mix
    assert sum(m.share for m in mix) == pytest.approx(1.0) and len(mix) == 4
    assert rows["Swan Lake"].city_split_source == "title"
    assert sum(c.share for c in rows["Swan Lake"].city_alloc) == pytest.approx(1.0)
    assert rows["Swan Lake"].city_split["Calgary"] == pytest.approx(2300 / 3000)
    assert rows["Momix"].city_split == {"Calgary": 0.85, "Edmonton": pytest.approx(0.15)}   # one city -> clipped
    assert rows["Phi"].city_split_source == "category"                 # contemporary learned from Momix
    assert rows["Phi"].city_split["Calgary"] == pytest.approx(0.85)
    assert rows["Giselle"].city_split_source == "category"
    assert rows["Giselle"].city_split["Calgary"] == pytest.approx(2300 / 3000)
    assert rows["New Work"].city_split_source == "default" and rows["New Work"].city_split["Calgary"] == 0.6
    assert rows["Swan Lake"].SeasonalityApplied is False and rows["Swan Lake"].RunMonth == ""


def test_seasonality_flags_and_benchmark_check(spark):
    p = _plan(spark, benchmark="Swan Lake", month=12)
    r = {x.title: x for x in p.scored.collect()}
    assert r["Swan Lake"].holiday_flag is True and r["Swan Lake"].RunMonth == "December"
    assert r["Swan Lake"].month_of_opening == 12
    with pytest.raises(ValueError):
        _plan(spark, benchmark="Not A Title").benchmark


def _tables(spark, folder):
    """Sales tables of a few rows: keys twice and without partner, null, zero and negative quantities, null days."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    day = dt.datetime(2020, 1, 1)
    put("region", [(0, "AMERICA"), (1, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(0, 0), (1, 1)], "n_nationkey int, n_regionkey int")
    put("customer", [(1, 0, "BUILDING"), (2, 1, "FURNITURE"), (3, 9, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string")
    put("orders", [(10, 1), (11, 2), (11, 1), (12, 3), (13, None), (None, 1)], "o_orderkey long, o_custkey long")
    put("part", [(k, f"part {k}", "PROMO", k) for k in range(1, 6)], "p_partkey long, p_name string, p_type string, p_size int")
    lines = [(o, t, q, None if n is None else day + dt.timedelta(days=n)) for o in (10, 11, 12, 13, None) for t, q, n in (
        (1, 5.0, 0), (1, 2.0, 0), (1, 3.0, 60), (1, 4.0, 61), (1, 0.0, 200), (2, -1.0, 0), (2, None, 0), (2, 7.0, 3), (3, 6.0, None),
        (3, 1.0, 9), (4, 2.0, None), (5, 0.0, 1), (None, 3.0, 2))]
    put("lineitem", [(o, t, q, 100.0, 0.1, d) for o, t, q, d in lines],
        "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp")


def test_runs_alone_make_no_history_cube(spark, tmp_path):
    """Every query of the runs aggregated and wrote the cube with its cities, segments and revenue."""
    _tables(spark, str(tmp_path))
    for hidden in (0, 2):
        lean, whole = (plan_from_tables(spark, str(tmp_path), month, hidden_every=hidden) for month in (3, 4))
        whole.history
        want = sorted(map(str, whole.runs.collect()))
        assert len(want) == (6 if hidden == 0 else 3)
        assert sorted(map(str, lean.runs.collect())) == want
        assert "history" not in lean.__dict__ and "priors" not in lean.__dict__
        plan = lean.run_history()._jdf.queryExecution().executedPlan().toString()
        assert "l_extendedprice" not in plan and "l_discount" not in plan
        assert whole.run_history() is whole.history
