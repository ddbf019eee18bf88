import datetime as dt
import random

from stagecast.operators import runs as R


def brute_runs(rows, gap=60):
    """Anchored grouping written from the definition: sort by date (undated last), skip
    null/non-positive values, a row joins the run if within ``gap`` days of the run's first
    date, undated values join the last run."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or dt.date.min))
    runs, cur, start = [], [], None
    for d, v in rows:
        if v is None or v <= 0:
            continue
        if d is None:
            cur.append(v)
            continue
        if start is None:
            start = d
            cur.append(v)
        elif (d - start).days <= gap:
            cur.append(v)
        else:
            runs.append(sum(cur))
            cur, start = [v], d
    if cur:
        runs.append(sum(cur))
    return runs


def _spark_runs(spark, rows):
    df = spark.createDataFrame([("t", d, v) for d, v in rows], "title string, start_date date, single_tickets double")
    out = R.anchored_runs(df).orderBy("run_no").collect()
    return [r.tickets for r in out]


def test_anchor_is_first_date_not_last(spark):
    d0 = dt.date(2020, 1, 1)
    rows = [(d0, 10.0), (d0 + dt.timedelta(days=40), 5.0), (d0 + dt.timedelta(days=80), 7.0)]
    # day 80 is 40 days after the previous row but 80 after the anchor -> new run
    assert _spark_runs(spark, rows) == [15.0, 7.0]


def test_gap_boundary_and_skips(spark):
    d0 = dt.date(2021, 3, 1)
    rows = [(d0, 1.0), (d0 + dt.timedelta(days=60), 2.0), (d0 + dt.timedelta(days=61), 4.0),
            (d0 + dt.timedelta(days=5), -3.0), (d0 + dt.timedelta(days=6), None), (None, 8.0)]
    assert _spark_runs(spark, rows) == [3.0, 12.0]


def test_only_undated_rows_form_one_run(spark):
    assert _spark_runs(spark, [(None, 2.0), (None, 3.0), (None, -1.0)]) == [5.0]


def test_random_against_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(300):
        d = None if rnd.random() < 0.05 else dt.date(2019, 1, 1) + dt.timedelta(days=rnd.randint(0, 900))
        v = rnd.choice([None, -1.0, 0.0] + [float(rnd.randint(1, 50))] * 6)
        rows.append((d, v))
    assert _spark_runs(spark, rows) == brute_runs(rows)


def test_prior_stats_and_modelling_dataset(spark):
    d0 = dt.date(2020, 1, 1)
    rows = [(d0 + dt.timedelta(days=100 * i), float(v)) for i, v in enumerate([10, 30, 20, 40])]
    df = spark.createDataFrame([("t", d, v) for d, v in rows], "title string, start_date date, single_tickets double")
    runs = R.anchored_runs(df)
    st = R.prior_stats(runs).first()
    assert st.ticket_median == 25.0 and st.prior_total_tickets == 100.0 and st.run_count_prior == 4
    md = {r.run_no: r for r in R.modelling_dataset(runs).collect()}
    assert md[0].prior_run_count == 0 and md[0].prior_median is None
    assert md[2].prior_median == 20.0 and md[3].prior_median == 20.0 and md[3].prior_total == 60.0


def test_mid_date_and_last_mid(spark):
    df = spark.createDataFrame([("t", dt.date(2020, 1, 1), dt.date(2020, 1, 4)),
                                ("t", dt.date(2021, 5, 1), dt.date(2021, 5, 2))],
                               "title string, run_start date, run_end date")
    m = R.mid_dates(df).orderBy("run_start").collect()
    assert m[0].mid_date == dt.date(2020, 1, 2) and m[1].mid_date == dt.date(2021, 5, 1)
    assert R.last_mid_date(R.mid_dates(df)).first().mid_date == dt.date(2021, 5, 1)
