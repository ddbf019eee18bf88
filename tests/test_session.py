import datetime as dt

from pyspark.sql import functions as F

from stagecast.session import cut


def test_cut_stages_are_columns_on_the_shared_folder(spark):
    """A cut stage is read by column, has the same rows and types, and carries nothing of its plan on."""
    rows = [(1, "a", 0.1, dt.date(1500, 1, 1), [1.0, None]), (2, None, float("nan"), None, None), (2, None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "k long, s string, x double, d date, v array<double>").withColumn("m", F.create_map("k", "x"))
    kept = cut(df)
    assert len(kept.inputFiles()) > 0 and all(f.endswith(".parquet") for f in kept.inputFiles())
    assert [(f.name, f.dataType) for f in kept.schema] == [(f.name, f.dataType) for f in df.schema]
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    plan = kept.select("k")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint>" in plan
    assert cut(df.where("false")).count() == 0


def _stored(spark, tmp_path, rows, schema):
    path = str(tmp_path / "lines")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_ticket_lines_are_read_from_their_source_once(spark, tmp_path):
    """X06 reads its lines for six aggregations, but not the joins that made them."""
    from stagecast.operators import rollup as RO
    d = dt.date(2024, 1, 5)
    rows = [(1, "s", c, "v", 100, day, d, t, 2.0, False, False, False, "A", "1") for c, day, t in
            (("X", d, 10.0), ("X", d, 5.0), ("Y", dt.date(2024, 1, 6), 20.0), ("Y", None, 5.0))]
    lines = _stored(spark, tmp_path, rows, "title_id long, show_title string, city string, venue_name string, capacity int, performance date, "
                    "sold date, tickets double, price double, is_subscription boolean, is_comp boolean, is_refund boolean, channel string, tier string")
    out = RO.ticketing_rollup(lines, ["X", "Y"])
    assert not set(out.inputFiles()) & set(lines.inputFiles())
    r = out.first()
    assert (r["performance_count_total"], r["performance_count_city"], r["total_tickets_all"]) == (2, 1, 40.0)
    assert (r["avg_tickets_per_performance"], r["load_factor"]) == (20.0, 0.2)


def test_event_lines_are_read_from_their_source_once(spark, tmp_path):
    """X07 needs its events for sums at starts and ends and for maxima, but the joins that made them once."""
    from stagecast.operators import joins as J
    day = [dt.date(2024, 1, i) for i in range(1, 10)]
    events = _stored(spark, tmp_path, [("k", day[0], day[2], 5.0, 40, "sports"), ("k", day[4], day[4], 7.0, 10, None)],
                     "title string, start date, end date, attendance double, rank int, kind string")
    runs = spark.createDataFrame([("k", 0, day[1], day[5]), ("k", 1, day[7], day[8])], "title string, run_no long, a date, b date")
    out = J.event_window_features(runs, events, "title", ["title", "run_no"], "a", "b")
    assert not set(out.inputFiles()) & set(events.inputFiles())
    got = {r["run_no"]: r for r in out.collect()}
    assert (got[0]["attendance_sum"], got[0]["event_count"], got[0]["rank_max"]) == (12.0, 1, 40) and got[1]["n_events"] == 0
