import datetime as dt
import random

from stagecast.operators import joins as J

D0 = dt.date(1999, 12, 1)


def day(n):
    return None if n is None else D0 + dt.timedelta(days=n)


def brute(runs, events):
    out = []
    for k, rid, s, e in runs:
        hit = [] if s is None or e is None or s > e else [
            v for kk, a, b, v in events if kk == k and a is not None and b is not None and a <= b and a <= e and b >= s]
        att = sum(v[0] or 0 for v in hit)
        big = [v[1] for v in hit if v[1] is not None and v[1] >= 30]
        ranks = [v[1] for v in hit if v[1] is not None]
        out.append((rid, len(hit), float(att), float(sum(v[0] or 0 for v in hit if v[2] == "sports")),
                    float(sum(v[0] or 0 for v in hit if v[2] == "concerts")), len(big), max(ranks) if ranks else None,
                    sum(big) / len(big) if big else None, int(any(v[2] == "holidays" for v in hit)),
                    int(any(v[2] == "severe-weather" for v in hit))))
    return sorted(out)


def frames(spark, runs, events):
    r = spark.createDataFrame([(k, i, day(s), day(e)) for k, i, s, e in runs], "k string, rid long, s date, e date")
    ev = spark.createDataFrame([(k, day(a), day(b), *v) for k, a, b, v in events],
                               "k string, start date, end date, attendance double, rank int, kind string")
    return r, ev


def features(spark, runs, events):
    r, ev = frames(spark, runs, events)
    got = J.event_window_features(r, ev, "k", ["rid"], "s", "e").collect()
    return sorted(tuple(x) for x in got)


def test_features_match_all_pairs(spark):
    rng = random.Random(3)
    kinds = ["sports", "concerts", "holidays", "severe-weather", "other", None]
    events = [(rng.choice("abc"), s, s + rng.choice([0, 0, 1, 3, 20, 900]),
               (rng.choice([None, float(rng.randrange(5000))]), rng.choice([None, *range(0, 101, 7)]), rng.choice(kinds)))
              for s in (rng.randrange(-400, 2500) for _ in range(300))]
    events += [("a", 5, 4, (9.0, 99, "sports")), ("b", None, 7, (9.0, 99, "sports")), ("d", 0, 9000, (1.0, 100, "holidays"))]
    runs = [(rng.choice("abce"), i, s, s + rng.choice([0, 1, 6, 30, 400])) for i, s in enumerate(rng.randrange(-500, 2600) for _ in range(120))]
    runs += [("a", 900, 10, 9), ("a", 901, None, 9), ("d", 902, 100, 100), ("zz", 903, 1, 2)]
    assert features(spark, runs, events) == brute(runs, events)


def test_before_1970_and_across_levels(spark):
    events = [("a", s, s + n, (1.0, r, "other")) for r, (s, n) in enumerate([(-11000, 3), (-10957, 1), (-10950, 70000), (0, 0), (63, 1), (64, 0)])]
    runs = [("a", i, s, e) for i, (s, e) in enumerate([(-12000, -11000), (-10999, -10956), (-1, 0), (1, 63), (64, 64), (65, 65), (-20000, 90000)])]
    assert features(spark, runs, events) == brute(runs, events)


def test_a_hot_key_makes_no_pairs(spark):
    """20,000 events and 2,000 runs of one key: rows stay near events and runs times the depth of the tree."""
    ev = spark.range(20_000).selectExpr("'k' AS k", "date_add(date'2000-01-01', int(id % 400)) AS start",
                                        "date_add(date'2000-01-01', int(id % 400 + 300)) AS end", "int(id % 101) AS rank")
    runs = spark.range(2_000).selectExpr("'k' AS k", "id AS rid", "date_add(date'2000-01-01', int(id % 350)) AS s",
                                         "date_add(date'2000-01-01', int(id % 350 + 200)) AS e")
    got = J.interval_overlap_max(runs, ev, "k", ["rid"], "s", "e", "start", "end", ["rank"])
    assert got.count() == 2_000 and got.where("max_rank <> 100").count() == 0
    nodes = J._canonical(J._day(ev["start"]), J._day(ev["end"]))
    assert ev.selectExpr("start", "end").distinct().select(J.F.size(nodes).alias("n")).agg({"n": "max"}).first()[0] <= 2 * 9


def test_events_and_runs_are_dealt_once_and_not_joined(spark):
    """Rows of a tree of days and joins on it were most of what X07 shuffled: the pass has neither."""
    r, ev = frames(spark, [("a", 0, 1, 2), ("b", 1, 3, 4)], [("a", 2, 9, (1.0, 5, "sports"))])
    plan = J.event_window_features(r, ev, "k", ["rid"], "s", "e")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(n in plan for n in ("Join", "Generate", "Window")) and plan.count("RepartitionByExpression") == 1
    assert plan.count("Aggregate") == 1                                                # events to a row a (key, start, end)


def test_keys_go_on_over_small_batches(spark):
    """Rows of a key come in many batches, keys start and end within them; further columns of the runs are kept."""
    rng = random.Random(9)
    events = [(rng.choice(["a", "b", "c", None]), s, s + rng.choice([0, 2, 40]), (float(rng.randrange(90)), rng.choice([None, rng.randrange(101)]), "sports"))
              for s in (rng.randrange(200) for _ in range(150))]
    runs = [(rng.choice("abcd"), i, s, s + rng.choice([-1, 0, 5, 60])) for i, s in enumerate(rng.randrange(-9, 260) for _ in range(90))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert features(spark, runs, events) == brute(runs, events)
        r, ev = frames(spark, [*runs, ("a", None, 1, 2)], events)
        got = J.event_window_features(r, ev, "k", ["rid"], "s", "e", keep=["k", "s", "e"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((x["k"], x["rid"], x["s"], x["e"]) for x in got) == sorted((k, i, day(s), day(e)) for k, i, s, e in runs)


def test_maxima_of_any_kind_of_value(spark):
    """Texts and doubles, NaN above all others; a NULL key and a repeated run are rows of their own."""
    nan = float("nan")
    ev = spark.createDataFrame([("k", day(1), day(5), "b", 2.0), ("k", day(2), day(3), "é", nan), ("k", day(4), day(9), "c", 7.0),
                                ("k", day(4), day(9), None, nan), ("k", day(6), day(6), "a", None), (None, day(0), day(9), "z", 9.0)],
                               "k string, a date, b date, t string, x double")
    r = spark.createDataFrame([("k", 0, day(0), day(1)), ("k", 1, day(3), day(4)), ("k", 2, day(6), day(6)), ("k", 3, day(10), day(12)),
                               ("k", 0, day(0), day(1)), (None, 4, day(1), day(2))], "k string, rid long, s date, e date")
    got = J.interval_overlap_max(r, ev, "k", ["rid"], "s", "e", "a", "b", ["t", "x"]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (0, "b", 2.0), (0, "b", 2.0), (1, "é", nan), (2, "c", nan), (3, None, None), (4, None, None)]))
    counts = J.interval_overlap_agg(r, ev, "k", ["rid"], "s", "e", "a", "b").collect()
    assert sorted(map(tuple, counts)) == [(0, 1), (1, 4), (2, 3), (3, 0), (4, 1)]


def test_event_file_takes_the_runs_with_their_features(spark, tmp_path, monkeypatch):
    """S10 joined the features to the runs once more and wrote plain text; now they come together, compressed."""
    from stagecast.plans import catalog as C
    tables = {"region": ([(1, "AMERICA")], "r_regionkey long, r_name string"),
              "nation": ([(1, 1)], "n_nationkey long, n_regionkey long"),
              "customer": ([(1, 1, "BUILDING")], "c_custkey long, c_nationkey long, c_mktsegment string"),
              "part": ([(1, "a", "LARGE", 1), (2, "b", "SMALL", 2)], "p_partkey long, p_name string, p_type string, p_size int"),
              "orders": ([(1, 1, dt.datetime(2020, 1, 1), "1-URGENT")], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
              "lineitem": ([(1, 1, 1, 5.0, 140.0, 0.0, dt.datetime(2020, 1, 10)), (1, 1, 2, 2.0, 10.0, 0.0, dt.datetime(2022, 6, 1)),
                            (1, 2, 3, 3.0, 50.0, 0.0, None), (1, None, 4, 9.0, 90.0, 0.0, dt.datetime(2020, 1, 5))],
                           "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    seen, write = [], C._as_file

    def as_file(session, df, *more):
        seen.append((df._jdf.queryExecution().optimizedPlan().toString(), write(session, df, *more)))
        return seen[-1][1]
    monkeypatch.setattr(C, "_as_file", as_file)
    got = sorted(C.QUERIES["S10_event_features"](spark, str(tmp_path)).collect(), key=lambda r: (r["show_title"], str(r["phq_start_date"])))
    cols = ["show_title", "phq_start_date", "phq_end_date", "phq_attendance_sum", "phq_attendance_sports", "phq_event_count",
            "phq_rank_max", "phq_rank_avg"]
    assert [tuple(r[c] for c in cols) for r in got] == [
        ("1", dt.date(2020, 1, 10), None, 7.0, 7.0, 1.0, 39.0, 39.0), ("1", dt.date(2022, 6, 1), dt.date(2022, 6, 1), 2.0, 2.0, 0.0, 10.0, None),
        ("2", None, None, 0.0, 0.0, 0.0, None, None)]
    (plan, path), = seen
    assert "Join" not in plan
    files = spark.read.format("binaryFile").load(path).select("path").collect()
    assert files and all(r["path"].endswith(".csv.gz") for r in files)
