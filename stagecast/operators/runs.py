"""Production runs and per-title ticket history."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice, tee

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecast.config import RUN_GAP_DAYS

_RUN_TYPE = "array<struct<run_start:date,run_end:date,tickets:double,n_days:bigint>>"


def anchored_runs(df: DataFrame, key_cols: list[str] | str = "title", date_col: str = "start_date",
                  value_col: str = "single_tickets", gap_days: int = RUN_GAP_DAYS) -> DataFrame:
    """A01 — anchored sessionisation of dated sales into production runs.

    Rows are ordered by date per key; a row joins the current run when it is at
    most ``gap_days`` after the run's *first* date, otherwise it opens a new run.
    Null or non-positive values are skipped before they can anchor a run;
    undated rows are added to the key's last run (or form one run if the key
    has no dated rows).

    Output: key cols, run_no (0-based, by date), run_start, run_end, tickets, n_days.

    Scale: values are first summed per (key, day) — map-side partial
    aggregation, lossless for sums — so the per-key sequential fold runs over
    at most the number of distinct days of that key, however many rows a hot
    key holds.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    v = F.col(value_col)
    daily = (df.where(v.isNotNull() & (v > 0))
             .groupBy(*keys, F.col(date_col).cast("date").alias("_d"))
             .agg(F.sum(v).cast("double").alias("_v")))
    per_key = daily.groupBy(*keys).agg(
        F.array_sort(F.collect_list(
            F.when(F.col("_d").isNotNull(), F.struct(F.col("_d").alias("d"), F.col("_v").alias("v"))))).alias("_days"),
        F.sum(F.when(F.col("_d").isNull(), F.col("_v"))).alias("_undated"))
    fold = F.expr(f"""
        aggregate(_days,
          named_struct('s', cast(null as date), 'e', cast(null as date), 't', cast(0 as double),
                       'k', cast(0 as bigint), 'runs', cast(array() as {_RUN_TYPE})),
          (acc, x) -> case
            when acc.s is null then named_struct('s', x.d, 'e', x.d, 't', x.v, 'k', cast(1 as bigint), 'runs', acc.runs)
            when datediff(x.d, acc.s) <= {int(gap_days)}
              then named_struct('s', acc.s, 'e', x.d, 't', acc.t + x.v, 'k', acc.k + 1, 'runs', acc.runs)
            else named_struct('s', x.d, 'e', x.d, 't', x.v, 'k', cast(1 as bigint),
                              'runs', concat(acc.runs, array(named_struct('run_start', acc.s, 'run_end', acc.e,
                                                                          'tickets', acc.t, 'n_days', acc.k))))
          end,
          acc -> case when acc.s is null then acc.runs
                      else concat(acc.runs, array(named_struct('run_start', acc.s, 'run_end', acc.e,
                                                              'tickets', acc.t, 'n_days', acc.k))) end)
    """)
    with_runs = per_key.select(*keys, fold.alias("_runs"), "_undated")
    # undated values go to the last run, or make a single undated run
    fixed = F.expr(f"""
        case when _undated is null then _runs
             when size(_runs) = 0 then array(named_struct('run_start', cast(null as date), 'run_end', cast(null as date),
                                                          'tickets', _undated, 'n_days', cast(0 as bigint)))
             else concat(slice(_runs, 1, size(_runs) - 1),
                         array(named_struct('run_start', _runs[size(_runs) - 1].run_start,
                                            'run_end', _runs[size(_runs) - 1].run_end,
                                            'tickets', _runs[size(_runs) - 1].tickets + _undated,
                                            'n_days', _runs[size(_runs) - 1].n_days)))
        end""")
    return (with_runs.select(*keys, F.posexplode(fixed).alias("run_no", "_r"))
            .select(*keys, F.col("run_no").cast("bigint").alias("run_no"), "_r.run_start", "_r.run_end",
                    "_r.tickets", "_r.n_days"))


def prior_stats(runs: DataFrame, key_col: str = "title", value_col: str = "tickets") -> DataFrame:
    """A02 — per key: median of run totals, sum and count of runs."""
    return runs.groupBy(key_col).agg(
        F.median(value_col).alias("ticket_median"),
        F.sum(value_col).alias("prior_total_tickets"),
        F.count(value_col).alias("run_count_prior"))


def mid_dates(runs: DataFrame, key_col: str = "title", start_col: str = "run_start",
              end_col: str = "run_end") -> DataFrame:
    """P16 on runs — mid date = start + floor((end - start) / 2) days, with month and year."""
    mid = F.date_add(F.col(start_col), F.floor(F.datediff(F.col(end_col), F.col(start_col)) / 2).cast("int"))
    return (runs.withColumn("mid_date", mid)
            .withColumn("month", F.month("mid_date"))
            .withColumn("year", F.year("mid_date")))


def last_mid_date(runs_with_mid: DataFrame, key_col: str = "title", order_col: str = "run_start") -> DataFrame:
    """J14 — title -> mid date of its last run (input order defined as run start; later wins)."""
    return runs_with_mid.groupBy(key_col).agg(
        F.max_by(F.col("mid_date"), F.struct(F.col(order_col), F.col("mid_date"))).alias("mid_date"))


def _running_medians(keys: Iterable, values: Iterable[float | None]) -> Iterator[float | None]:
    """For each value the median of the earlier ones of its key; keys come one after the other.

    Two heaps hold the lower and the upper half of what came before, so a value costs the logarithm of its
    place, and only one key's values are held. NULL values have a median but are part of none.
    """
    key, low, high = None, [], []
    for k, v in zip(keys, values):
        if k != key:
            key, low, high = k, [], []
        yield None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2
        if v is None or v != v:
            continue
        heapq.heappush(high, -heapq.heappushpop(low, -v))
        if len(high) > len(low):
            heapq.heappush(low, -heapq.heappop(high))


def modelling_dataset(runs: DataFrame, key_col: str = "title") -> DataFrame:
    """X04 — forecast-time features per run from strictly earlier runs of the same title.

    prior_run_count, prior_total, prior_median (median of earlier run totals), years_since_last (days
    between run starts / 365.25), target = this run's tickets. Runs are ordered by start and number within
    each title; counts, totals and gaps are windows, the median is kept up to date in one pass over the
    ordered runs (a title's runs stay in one task; nothing is gathered per row).
    """
    w = Window.partitionBy(key_col).orderBy("run_start", "run_no")
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    d = runs.select(
        key_col, "run_no", "run_start", "run_end",
        F.count("tickets").over(prev).alias("prior_run_count"),
        F.sum("tickets").over(prev).alias("prior_total"), F.lit(None).cast("double").alias("prior_median"),
        (F.datediff("run_start", F.lag("run_start").over(w)) / 365.25).alias("years_since_last"),
        F.col("tickets").cast("double").alias("target"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def feed() -> Iterator[tuple]:
            for batch in batches:
                waiting.append(batch)
                yield from zip(batch.column(key_col).to_pylist(), batch.column("target").to_pylist())
        waiting: list = []
        keys, values = tee(feed())
        medians = _running_medians((k for k, _ in keys), (v for _, v in values))
        at = d_names.index("prior_median")
        for first in medians:
            batch = waiting.pop(0)
            column = pa.array([first, *islice(medians, batch.num_rows - 1)], type=pa.float64())
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(batch.num_columns)], names=d_names)
    d_names = d.columns
    ordered = d.repartition(key_col).sortWithinPartitions(key_col, "run_start", "run_no")
    return ordered.mapInArrow(fill, d.schema)
