"""Hand-made frames: NULL, NaN, words for numbers, duplicates, odd spellings."""
import math

import pytest
from pyspark.sql import functions as F

from stagecast.functions import columns as P
from stagecast.functions import signals as SG
from stagecast.operators import joins as J
from stagecast.operators import models as M
from stagecast.operators import profile as PR
from stagecast.operators import rollup as RO
from stagecast.plans import season as SE
from stagecast.sources import io as IO


def test_parse_number_takes_decimal_numbers_only(spark):
    texts = ["7,734", " 1.5 ", "-2", "+.5", "1e3", "nan", "NaN", "Infinity", "-inf", "1d", "2f", "0x1", "", " ", None, "1.2.3", "1e999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(P.parse_number("t", blank_as_zero=False)).collect()]
    assert got == [7734.0, 1.5, -2.0, 0.5, 1000.0] + [None] * 12
    assert [r[0] for r in df.limit(1).select(P.parse_number("t", False, commas=False)).collect()] == [None]
    assert [r[0] for r in df.select(P.parse_number("t")).collect()][5:] == [0.0] * 12


def test_bands_of_nan_and_null_are_the_lowest(spark):
    df = spark.createDataFrame([(math.nan,), (None,), (95.0,)], "v double")
    assert [r[0] for r in df.select(P.letter_score(F.col("v"))).collect()] == ["E", "E", "A"]
    assert [r[0] for r in df.select(P.star_rating(F.col("v"))).collect()][:2] == [P.STAR_EMPTY] * 2


def test_tiers_of_missing_signals(spark):
    rows = [("a", "c", 50.0, 70.0), ("b", "c", 50.0, None), ("d", "x", 50.0, None), ("e", "c", None, None), ("f", "c", math.nan, None)]
    df = spark.createDataFrame(rows, "title string, category string, SignalOnly double, TicketIndex_DeSeason double")
    overall = spark.createDataFrame([(1.0, 10.0)], "slope double, intercept double")
    group = spark.createDataFrame([("c", 2.0, 0.0)], "category string, slope double, intercept double")
    got = {r.title: (r.TicketIndexSource, r.TicketIndex_DeSeason_Used) for r in M.tiered_impute(df, overall, group).collect()}
    assert got == {"a": ("History", 70.0), "b": ("ML Category", 100.0), "d": ("ML Overall", 60.0),
                   "e": ("Not enough data", None), "f": ("Not enough data", None)}
    none = M.tiered_impute(df, overall.limit(0), group.limit(0)).where("title = 'd'").first()
    assert none.TicketIndexSource == "Not enough data"


def test_winsorize_leaves_missing_values(spark):
    ref = spark.createDataFrame([("c", float(v)) for v in range(101)], "category string, v double")
    df = spark.createDataFrame([("c", None), ("c", 500.0), ("z", -5.0), (None, 50.0)], "category string, v double")
    got = [r.v for r in SG.winsorize_by_group(df, ref, "category", "v").collect()]
    assert sorted(got, key=str) == sorted([None, 97.0, 3.0, 50.0], key=str)


def test_sales_without_number_are_dropped(spark):
    df = spark.createDataFrame([("2024-01-01", t) for t in ("nan", "1,200", "-3", "x", None)], "start_date string, single_tickets string")
    assert [r.single_tickets for r in IO.clean_sales_history(df).collect()] == [1200.0]
    num = spark.createDataFrame([("2024-01-01", math.nan), ("2024-01-01", 2.0)], "start_date string, single_tickets double")
    assert IO.clean_sales_history(num).count() == 1


def test_later_duplicates_win(spark):
    b = spark.createDataFrame([(" A", "1", 1), ("A", "2,5", 3), ("A", "7", 2), (" ", "1", 1)], "title string, intentratio string, line int")
    assert [(r.title, r.intentratio) for r in IO.keep_baselines(b, "title", "line").collect()] == [("A", None)]
    p = spark.createDataFrame([("r", "c", "S", "1", 1), ("r ", "c", "S", "2", 2), ("r", "c", "S", "x", 3), ("r", "c", "T", "1", 1)],
                              "region string, category string, segment string, weight string, line int")
    assert [tuple(r) for r in IO.clean_segment_priors(p, ["S"], "line").collect()] == [("r", "c", "S", 2.0)]


def test_lookups_ignore_spelling_and_never_multiply(spark):
    pri = spark.createDataFrame([("Calgary", "c", "S", 1.2), ("calgary ", "C", "s", 1.3), ("PROVINCE", "D", "S", 0.9)],
                                "region string, category string, segment string, weight double")
    keys = spark.createDataFrame([(" CALGARY", "c", "S"), ("Edmonton", "d", "s")], "region string, category string, segment string")
    assert sorted((r.region, r.weight) for r in J.hierarchical_lookup(keys, pri).collect()) == [(" CALGARY", 1.2), ("Edmonton", 0.9)]
    got = J.hierarchical_lookup_set(keys, pri).collect()
    assert sorted((r.region, r.weight, r.weight_source) for r in got) == [(" CALGARY", 1.2, "region"), ("Edmonton", 0.9, "fallback")]


def test_backtest_with_one_category_over_buckets(spark):
    rows = [("c", i, float(i % 13), 3.0 * (i % 13) + (i % 5)) for i in range(300)] + [(None, 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "category string, t int, x double, y double")
    one = M.expanding_backtest(df, "category", ["t"], "x", "y", F.lit(0))
    many = M.expanding_backtest(df, "category", ["t"], "x", "y", F.floor(F.col("t") / 7))
    a, b = ({(r.category, r.t): (r.prediction, r.train_rows) for r in d.collect()} for d in (one, many))
    assert a.keys() == b.keys() and len(a) == 301
    assert all(a[k][1] == b[k][1] and (a[k][0] is None) == (b[k][0] is None) for k in a)
    assert all(a[k][0] == pytest.approx(b[k][0]) for k in a if a[k][0] is not None)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(category" in plan and "_b#" in plan


def test_two_rows_of_one_title_and_month_raise(spark):
    plan = spark.createDataFrame([(1, "March 2027", 5), (1, "March 2027", 6)], "title int, Month string, n int")
    with pytest.raises(Exception, match="two rows of one title and month"):
        SE.metrics_by_month(plan, ["n"]).collect()


def test_profile_covers_every_numeric_column(spark):
    cols = [f"n{i}" for i in range(14)]
    df = spark.createDataFrame([tuple(float(k if r else 1e9) for k in range(14)) for r in range(30)], cols)
    got = {(r.metric, r.column): r.value for r in PR.profile_source(df, "s", expected=["gone"]).collect()}
    assert got[("outliers", "n13")] == 1.0 and got[("missing_expected", "gone")] == 1.0 and got[("row_count", None)] == 30.0
    total = PR.registry_totals(PR.registry_report([PR.profile_source(df, "s", expected=["gone"])])).first()
    assert (total.sources, total.with_errors, total.with_warnings, total.rows) == (1, 1, 1, 30)


def test_batch_summary_counts_titles_once(spark):
    df = spark.createDataFrame([(" A", False), ("A", True), ("B", None), ("C", False)], "t string, bad boolean")
    assert tuple(RO.batch_summary(df, "t", F.col("bad")).first()) == (4, 3, 1, 2, 1)
    assert tuple(RO.batch_summary(df.limit(0), "t", F.col("bad")).first()) == (0, 0, 0, 0, 0)
