import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagecast.functions import quantiles as Q
from stagecast.functions.quantiles import exact_median, exact_percentiles

PROBS = [0.0, 0.03, 0.25, 0.5, 0.75, 0.97, 1.0]


@pytest.mark.parametrize("per_e", [1, 1024])
def test_exact_percentiles_match_numpy(spark, monkeypatch, per_e):
    """Ties, small groups, both signs, all magnitudes, values that share a bucket."""
    monkeypatch.setattr(Q, "PER_E", per_e)
    rnd = random.Random(5)
    rows = [("big", float(rnd.choice([rnd.randint(0, 50), rnd.random() * 1000]))) for _ in range(20000)]
    rows += [("tiny", 3.0), ("tiny", 1.0)] + [("one", 7.5)] + [("ties", 2.0)] * 500 + [("ties", 9.0)] * 3
    rows += [("nulls", None), ("nulls", 4.0), ("nulls", float("nan")), (None, 1.0), (None, 2.0), ("none", None)]
    rows += [("signs", rnd.gauss(0, 3)) for _ in range(3001)] + [("close", 1e8 + rnd.random()) for _ in range(2000)]
    rows += [("wide", rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300)) for _ in range(2000)]
    rows += [("small", rnd.uniform(-1e-9, 1e-9)) for _ in range(1000)] + [("zero", 0.0), ("zero", -0.0), ("zero", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_percentiles(df, "v", PROBS, "g").collect()}
    assert set(got) == {g for g, v in rows if v is not None and v == v}
    for g in got:
        vals = np.array([v for gg, v in rows if gg == g and v is not None and v == v])
        for i, p in enumerate(PROBS):
            assert got[g][f"p{i}"] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12, abs=1e-24), (g, p)
        assert got[g].n == len(vals)


def test_infinite_values(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (float("inf"),)], "v double")
    r = exact_percentiles(df, "v", [0.0, 0.5, 1.0]).first()
    assert (r.p0, r.p1, r.p2) == (float("-inf"), 2.0, float("inf"))


def test_exact_median_global_and_empty(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "v double")
    assert exact_median(df, "v").first().median == 500.0
    r = exact_median(df.where("v < 0"), "v").first()
    assert r.median is None and r.n == 0


def test_buckets_never_decrease_with_the_value(spark):
    rnd = random.Random(1)
    vals = sorted([rnd.choice([-1, 1]) * 10 ** rnd.uniform(-320, 308) for _ in range(5000)] + [rnd.gauss(0, 5) for _ in range(5000)])
    b = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(Q.bucket_of(F.col("v"))).collect()]
    assert b == sorted(b)


@pytest.mark.parametrize("distinct", [7, 1000, 3_000_000])
def test_what_is_counted_stays_small(spark, distinct):
    """3 M rows of one group: the second pass takes the values of one bucket, a value costs one pair."""
    n = 3_000_000
    df = spark.range(n).select(F.lit(0).alias("_k0"), F.pmod(F.xxhash64("id"), F.lit(distinct)).cast("double").alias("_v"))
    buckets = Q.rank_buckets(df, ["_k0"], [0.25])
    assert buckets.count() <= 2
    pairs = Q.bucket_pairs(df, buckets, ["_k0"])
    assert pairs.count() <= 2 * max(1, distinct // 1000)
    if distinct == 7:
        vals = np.array([r[0] for r in df.select("_v").toLocalIterator()])
        assert exact_percentiles(df, "_v", [0.25]).first().p0 == np.percentile(vals, 25)


def test_no_job_runs_while_the_plan_is_built(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    exact_percentiles(spark.range(1000).withColumn("g", F.col("id") % 3), "id", [0.1, 0.9], "g")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(before)


def test_weights_stand_for_repeated_values(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v), int(w)) for g in range(3) for v, w in zip(rng.choice(500, 40, replace=False), rng.integers(1, 9, 40))]
    got = {r.g: r for r in exact_percentiles(spark.createDataFrame(rows, "g int, v double, w int"), "v", [0.25, 0.5, 0.9], "g", weight="w").collect()}
    for g in range(3):
        vals = np.repeat([v for k, v, _ in rows if k == g], [w for k, _, w in rows if k == g])
        assert got[g].n == len(vals)
        assert np.allclose([got[g].p0, got[g].p1, got[g].p2], np.percentile(vals, [25, 50, 90]))
