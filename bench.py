"""Benchmark: headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line.

Each query is forced to completion with the ``noop`` sink (full execution, no
collect to the driver). Every headline is timed from a cleared plan: it binds the
tables and builds all stages that it needs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from stagecast.session import local_session
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="stagecast-bench")

    from stagecast.plans import catalog as C
    from stagecast.plans import pipeline as PL

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        run(fn())
        timings[name] = round(time.perf_counter() - t0, 3)

    # every headline starts from a cleared plan: no stage that an earlier one has written is read
    headline = ["A01_anchored_runs", "A07_seasonality_table", "J06_asof_last", "J01_left_enrich",
                "F14_segment_shares", "R01_season_plan", "A09_profile_source", "X07_event_window_features",
                "P09_title_match"]
    timed("flagship_score_titles", lambda: PL.score_titles_from_tables(spark, sf_dir, proposed_month=3))
    for q in headline:
        PL._PLANS.clear()
        timed(q, lambda q=q: C.QUERIES[q](spark, sf_dir))
    # attribution throughput: E02 fit + E03/E04 over every title of an indexed plan, rows/s
    PL._PLANS.clear()
    n_rows = PL.plan_from_tables(spark, sf_dir, proposed_month=3).indexed.count()
    timed("E_attribution", lambda: C.QUERIES["E04_contributions"](spark, sf_dir))
    rps = round(n_rows / max(timings["E_attribution"], 1e-9), 1)

    total = round(sum(timings.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec", "queries": timings,
                      "sf": sf, "cpus": cpus, "attribution_rows": n_rows,
                      "attribution_rows_per_sec": rps}))
    spark.stop()


if __name__ == "__main__":
    main()
