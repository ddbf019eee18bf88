"""Enrichment joins.

All joins are left joins that keep every left row. Broadcast hints are only
placed on sides whose size is bounded by construction (1-row aggregates,
per-city aggregates); everything else is left to the planner, whose
broadcast decision is checked against ``spark.sql.autoBroadcastJoinThreshold``
(and re-checked at runtime by AQE), with a sort-merge join beyond it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush
from operator import add, sub

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagecast.session import cut

# FIXED VALUES — key candidates for automatic join-key detection, in priority order
YEAR_KEYS = ("year", "season_year")
CITY_KEYS = ("city",)
TITLE_KEYS = ("show_title", "title")


def _find(df: DataFrame, candidates: Sequence[str]) -> str | None:
    lower = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    return None


def detect_keys(left: DataFrame, right: DataFrame, groups: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """Pairs (left_col, right_col) for each candidate group present on both sides."""
    pairs = []
    for g in groups:
        lc, rc = _find(left, g), _find(right, g)
        if lc and rc:
            pairs.append((lc, rc))
    return pairs


def left_enrich(left: DataFrame, right: DataFrame, join_on: Sequence[str] | None = None,
                key_groups: Sequence[Sequence[str]] = (YEAR_KEYS, CITY_KEYS),
                prefix: str = "") -> DataFrame:
    """J01/J02 — left join with explicit or auto-detected keys.

    Right columns already present on the left (other than keys) are dropped;
    with no usable key the left side is returned unchanged.
    """
    if join_on:
        pairs = [(k, k) for k in join_on]
    else:
        pairs = detect_keys(left, right, key_groups)
    if not pairs:
        return left
    rkeys = [r for _, r in pairs]
    lcols = {c.lower() for c in left.columns}
    new_cols = [c for c in right.columns if c not in rkeys and c.lower() not in lcols]
    r = right.select(*[F.col(rk).alias(f"_k{i}") for i, rk in enumerate(rkeys)],
                     *[F.col(c).alias(prefix + c) for c in new_cols])
    cond = None
    for i, (lk, _) in enumerate(pairs):
        c = left[lk] == r[f"_k{i}"]
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"_k{i}" for i in range(len(pairs))])


def enrich_events(history: DataFrame, events: DataFrame) -> DataFrame:
    """J02 — J01 keyed on title (show_title/title) and city."""
    return left_enrich(history, events, key_groups=(TITLE_KEYS, CITY_KEYS))


# FIXED VALUES — weather measures carried by the date/city join
WEATHER_MEASURES = ("min_temperature", "avg_temperature", "max_temperature", "precipitation", "snow",
                    "max_wind_speed")


def join_weather(history: DataFrame, weather: DataFrame, date_col: str = "date", city_col: str | None = "city",
                 weather_city: str | None = "city", measures: Sequence[str] = WEATHER_MEASURES,
                 prefix: str = "weather_") -> DataFrame:
    """J03 — exact (date, city) left join, city keys title-cased and trimmed; measures prefixed.
    When either side has no city, weather is averaged over cities per date first."""
    ms = [m for m in measures if m in weather.columns]
    w = weather.withColumn("_wd", F.col("date").cast("date"))
    if city_col and weather_city and city_col in history.columns and weather_city in weather.columns:
        w = w.select("_wd", F.initcap(F.trim(F.col(weather_city))).alias("_wc"),
                     *[F.col(m).alias(prefix + m) for m in ms])
        cond = ((F.col(date_col).cast("date") == F.col("_wd"))
                & (F.initcap(F.trim(F.col(city_col))) == F.col("_wc")))
        return history.join(w, cond, "left").drop("_wd", "_wc")
    w = w.groupBy("_wd").agg(*[F.avg(m).alias(prefix + m) for m in ms])
    return history.join(w, F.col(date_col).cast("date") == F.col("_wd"), "left").drop("_wd")


def join_marketing(history: DataFrame, spend: DataFrame, date_keys: Sequence[str] = ("date_key", "start_date"),
                   title_keys: Sequence[str] = TITLE_KEYS) -> DataFrame:
    """J04 — left join on date key and/or title, whichever both sides have; duplicate right keys
    multiply rows (checked by ``duplicate_keys``)."""
    return left_enrich(history, spend, key_groups=(date_keys, title_keys))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J05 check — keys that occur more than once (a left join on them would add rows).
    A grouped count on the right side instead of re-counting the joined table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def chained_enrich(history: DataFrame, weather: DataFrame | None, spend: DataFrame | None,
                   weather_kwargs: dict | None = None, checks: tuple[Observation, Observation] | None = None) -> DataFrame:
    """J05 — weather then marketing (economy is a no-op).

    ``checks`` get ``rows`` before and after the joins, counted by the job that reads the result: they differ
    if a key of a joined table is not unique there (``duplicate_keys`` names such keys).
    """
    out = history.observe(checks[0], F.count(F.lit(1)).alias("rows")) if checks else history
    if weather is not None:
        out = join_weather(out, weather, **(weather_kwargs or {}))
    if spend is not None:
        out = join_marketing(out, spend)
    return out.observe(checks[1], F.count(F.lit(1)).alias("rows")) if checks else out


#: Parts of a crowded day of one key.
DAY_PARTS = 64


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _day_cuts(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """``(_ck, _cb, _cuts)`` for the (key, day) buckets with more than ``bucket_rows`` rows: times between parts.

    Any times would do; quantiles of a sketch make parts of like size. Only the rows of such days are sketched.
    """
    crowded = rows.groupBy("_key", "_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    crowded = crowded.select(F.col("_key").alias("_ck"), F.col("_b").alias("_cb"))
    of = rows.join(crowded, (F.col("_key") == F.col("_ck")) & (F.col("_b") == F.col("_cb")))
    at = F.percentile_approx(_micros(F.col("_ts")), F.array(*[F.lit(i / DAY_PARTS) for i in range(1, DAY_PARTS)]), 1000)
    return of.groupBy("_ck", "_cb").agg(at.alias("_cuts"))


def _in_parts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of crowded days with the number of their part in ``_b``."""
    part = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<bigint>")), lambda c: c < _micros(F.col("_ts"))))
    met = rows.join(cuts, (F.col("_key") == F.col("_ck")) & (F.col("_b") == F.col("_cb")), "left")
    return met.withColumn("_b", F.struct(F.col("_b.day").alias("day"), part.alias("part"))).select(*rows.columns)


def asof_last(left: DataFrame, right: DataFrame, key: str, ts: str, value_cols: Sequence[str],
              tie: str | None = None, bucket_seconds: int | None = 86400, bucket_rows: int = 1_000_000) -> DataFrame:
    """J06 — as-of join: for each left row the latest right row of the same key with
    right.ts <= left.ts (NULLs when none). At equal ts the right row counts as
    earlier; among right rows with equal ts the largest ``tie`` value wins.

    Union of both sides (each carrying its own columns as a struct) +
    ``last(..., ignorenulls)`` over a time-ordered window: one shuffle, no pair
    expansion, no join back. To split a hot key the window runs per
    (key, time bucket); the last right row of every earlier bucket is carried in
    through a second window over per-bucket rows only (one row per key and
    bucket), so no task ever holds a whole key.
    """
    tie_col = F.col(tie) if tie else F.lit(0)
    rp = F.struct(F.col(ts).alias("_rts"), tie_col.alias("_rtie"), *[F.col(c).alias(c) for c in value_cols])
    lp = F.struct(*[F.col(c) for c in left.columns])
    r = right.where(F.col(ts).isNotNull()).select(
        F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(0).alias("_side"), tie_col.alias("_tie"),
        rp.alias("_p"), F.lit(None).cast(left.select(lp.alias("x")).schema["x"].dataType).alias("_lp"))
    lsel = left.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"),
                       F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"),
                       F.lit(None).cast(r.schema["_p"].dataType).alias("_p"), lp.alias("_lp"))
    if bucket_seconds:
        bucket = F.floor(F.unix_seconds(F.col("_ts").cast("timestamp")) / bucket_seconds)
    else:
        bucket = F.lit(0).cast("bigint")
    r, lsel = r.withColumn("_b", F.struct(bucket.alias("day"), F.lit(0).alias("part"))), lsel.withColumn(
        "_b", F.struct(bucket.alias("day"), F.lit(0).alias("part")))
    if bucket_seconds:
        cuts = _day_cuts(r.select("_key", "_b", "_ts").unionByName(lsel.select("_key", "_b", "_ts")), bucket_rows)
        r, lsel = _in_parts(r, cuts), _in_parts(lsel, cuts)
    u = r.unionByName(lsel)
    w = (Window.partitionBy("_key", "_b").orderBy("_ts", "_side", "_tie")
         .rowsBetween(Window.unboundedPreceding, 0))
    u = u.withColumn("_in", F.last("_p", ignorenulls=True).over(w))
    lrows = u.where(F.col("_side") == 1).select("_key", "_b", "_lp", "_in")
    if bucket_seconds:
        last_in_bucket = (r.groupBy("_key", "_b")
                          .agg(F.max_by("_p", F.struct("_ts", "_tie")).alias("_bp")))
        wb = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carry = (lrows.select("_key", "_b").distinct()
                 .join(last_in_bucket, ["_key", "_b"], "full")
                 .withColumn("_carry", F.last("_bp", ignorenulls=True).over(wb))
                 .select("_key", "_b", "_carry"))
        lrows = lrows.join(carry, ["_key", "_b"], "left")
        best = F.coalesce(F.col("_in"), F.col("_carry"))
    else:
        best = F.col("_in")
    return lrows.select(*[F.col("_lp")[c].alias(c) for c in left.columns],
                        *[best[c].alias(c) for c in value_cols], best["_rts"].alias("matched_ts"))


def exact_else_latest(left: DataFrame, right: DataFrame, key: str, date_col: str, right_date: str,
                      value_cols: Sequence[str]) -> DataFrame:
    """J07 — right row for the exact (key, date), else the key's globally latest right row
    (not as-of). The per-key latest row is one row per key."""
    r = right.select(F.col(key).alias("_k"), F.col(right_date).cast("date").alias("_d"),
                     F.struct(*[F.col(c) for c in value_cols]).alias("_v"))
    latest = r.groupBy("_k").agg(F.max_by("_v", "_d").alias("_lv"))
    j = (left.join(r, (F.col(key) == F.col("_k")) & (F.col(date_col).cast("date") == F.col("_d")), "left")
         .drop("_k", "_d")
         .join(latest.withColumnRenamed("_k", "_lk"), F.col(key) == F.col("_lk"), "left"))
    pick = F.coalesce(F.col("_v"), F.col("_lv"))
    return j.select(*left.columns, *[pick[c].alias(c) for c in value_cols],
                    F.when(F.col("_v").isNotNull(), F.lit("exact"))
                    .when(F.col("_lv").isNotNull(), F.lit("latest")).otherwise(F.lit("none")).alias("match"))


def _keyed_priors(priors: DataFrame, region: str, category: str, segment: str) -> DataFrame:
    """Priors by trimmed lower-case key, one row a key: of rows that differ only in spelling, the least."""
    key = [F.lower(F.trim(F.col(c))).alias(k) for c, k in ((region, "_r"), (category, "_c"), (segment, "_s"))]
    first = F.struct(F.col(region).alias("region"), F.col(category).alias("category"), F.col(segment).alias("segment"), "weight")
    return (priors.select(*key, first.alias("_p")).groupBy("_r", "_c", "_s").agg(F.min("_p").alias("_p"))
            .select("_r", "_c", "_s", F.col("_p.segment").alias("_segment"), F.col("_p.weight").alias("_w")))


def hierarchical_lookup(left: DataFrame, priors: DataFrame, region: str = "region", category: str = "category",
                        segment: str = "segment", fallback_region: str = "Province",
                        default: float = 1.0) -> DataFrame:
    """J08 — weight for (region, category, segment), case-insensitive; else the fallback
    region's weight; else ``default``. Adds ``weight`` and ``weight_source``. Left rows never multiply."""
    p = _keyed_priors(priors, "region", "category", "segment").drop("_segment")
    fb = p.where(F.col("_r") == fallback_region.strip().lower()).select(
        F.col("_c").alias("_fc"), F.col("_s").alias("_fs"), F.col("_w").alias("_fw"))
    lc, ls = F.lower(F.trim(F.col(category))), F.lower(F.trim(F.col(segment)))
    j = (left.join(p, (F.lower(F.trim(F.col(region))) == F.col("_r")) & (lc == F.col("_c")) & (ls == F.col("_s")), "left")
         .join(fb, (lc == F.col("_fc")) & (ls == F.col("_fs")), "left"))
    return j.select(*left.columns, F.coalesce("_w", "_fw", F.lit(default)).alias("weight"),
                    F.when(F.col("_w").isNotNull(), F.lit("region"))
                    .when(F.col("_fw").isNotNull(), F.lit("fallback")).otherwise(F.lit("default")).alias("weight_source"))


def hierarchical_lookup_set(keys: DataFrame, priors: DataFrame, region: str = "region", category: str = "category",
                            fallback_region: str = "Province") -> DataFrame:
    """J09 — all segment weights for each (region, category), case-insensitive; when the region has no
    row for the category the whole set comes from the fallback region; else nothing."""
    k = keys.select(F.col(region).alias("region"), F.col(category).alias("category")).distinct().withColumn(
        "_r", F.lower(F.trim("region"))).withColumn("_c", F.lower(F.trim("category")))
    pr = _keyed_priors(priors, "region", "category", "segment")
    out = ["region", "category", F.col("_segment").alias("segment"), F.col("_w").alias("weight")]
    own = k.join(pr, ["_r", "_c"]).select(*out, F.lit("region").alias("weight_source"))
    missing = k.join(pr.select("_r", "_c").distinct(), ["_r", "_c"], "left_anti")
    fb = pr.where(F.col("_r") == fallback_region.strip().lower()).drop("_r")
    return own.unionByName(missing.join(fb, "_c").select(*out, F.lit("fallback").alias("weight_source")))


def _day(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))


def _above(a, b) -> bool:
    """Spark's order of two values: NaN is above all others."""
    return a > b or (a != a and b == b)


def _raise(ends: list, tops: list, end: int, top) -> None:
    """Adds an event to the greatest values by end day: ``ends`` go up and ``tops`` strictly down, so the first
    entry that ends on a day or later has the greatest value of all events that do."""
    at = bisect_left(ends, end)
    if top is None or at < len(ends) and not _above(top, tops[at]):
        return
    behind = at + (at < len(ends) and ends[at] == end)
    while at and not _above(tops[at - 1], top):
        at -= 1
    ends[at:behind], tops[at:behind] = [end], [top]


def _sweep(sums: Sequence[str], maxima: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over the rows of keys, ordered by day: events at their start, runs at their end.

    When a run comes, all events that start until its end have been added and, of those, all that end before it
    starts are complete. Its sums are the former's less the latter's; its maxima are those of the former that end
    on its first day or later. Per key there is kept a row for each distinct end day of events, not the events.
    """
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, zero = object(), (0.0,) * len(sums)
        for batch in batches:
            at, to, what = (batch.column(c).to_numpy().tolist() for c in ("_at", "_to", "_what"))
            adds = list(zip(*(batch.column(c).to_numpy().tolist() for c in sums)))
            values = list(zip(*(batch.column(c).to_pylist() for c in maxima))) or [()] * len(at)
            added, most = [], []
            for i, k in enumerate(batch.column("_k").to_pylist()):
                if k != key and (k == k or key == key):
                    key, begun, ending, due, days, ended = k, zero, {}, [], [], [zero]
                    best = [([], []) for _ in maxima]
                if what[i] == EVENT:
                    begun = tuple(map(add, begun, adds[i]))
                    if to[i] in ending:
                        ending[to[i]] = tuple(map(add, ending[to[i]], adds[i]))
                    else:
                        ending[to[i]] = adds[i]
                        heappush(due, to[i])
                    if k is not None:                    # a NULL key has sums, but no maximum
                        for (ends, tops), v in zip(best, values[i]):
                            _raise(ends, tops, to[i], v)
                elif what[i] == RUN:
                    while due and due[0] < at[i]:        # no event to come ends that early
                        days.append(heappop(due))
                        ended.append(tuple(map(add, ended[-1], ending.pop(days[-1]))))
                    added.append(tuple(map(sub, begun, ended[bisect_left(days, to[i])])))
                    found = (bisect_left(ends, to[i]) for ends, _ in best)
                    most.append(tuple(tops[j] if j < len(tops) else None for (_, tops), j in zip(best, found)))
                else:
                    added.append(zero)
                    most.append((None,) * len(maxima))
            rid = batch.column("_rid").filter(pa.array([w != EVENT for w in what]))
            yield pa.RecordBatch.from_arrays(
                [rid, *(pa.array([r[j] for r in added], pa.float64()) for j in range(len(sums))),
                 *(pa.array([r[j] for r in most], batch.schema.field(c).type) for j, c in enumerate(maxima))],
                names=["_rid", *sums, *maxima])
    return sweep


#: Rows of the sweep: an event, a run, a run whose window is empty.
EVENT, RUN, EMPTY = 0, 1, 2


def interval_overlap(runs: DataFrame, events: DataFrame, key: str, run_id: Sequence[str], run_start: str, run_end: str,
                     ev_start: str, ev_end: str, sums: Sequence[tuple[Column, str]] = (), max_cols: Sequence[str] = ()) -> DataFrame:
    """X07 — sums and maxima over the events whose [start, end] overlaps each run window, in one pass and
    without forming (run, event) pairs.

    Events are summed to a row for each (key, start, end) first, however many a hot key holds. These rows and one
    row for each run are dealt by key, ordered by day and swept (``_sweep``): of events and runs nothing else
    is shuffled, and nothing is joined. ``sums`` are expressions over the events with their names, NULL counts
    as 0. Empty windows (start > end, or a NULL bound) overlap nothing. Returns the run_id columns, ``n`` (number
    of events) and the sums as doubles, and ``max_<c>``, NULL without an overlapping event: a row for each run.
    """
    metrics = [(F.lit(1), "n"), *sums]
    names, tops = [n for _, n in metrics], [f"max_{c}" for c in max_cols]
    first, last = _day(F.col(ev_start)), _day(F.col(ev_end))
    ev = events.where(first <= last).groupBy(F.col(key).alias("_k"), first.alias("_at"), last.alias("_to")).agg(
        *[F.coalesce(F.sum(x.cast("double")), F.lit(0.0)).alias(n) for x, n in metrics],
        *[F.max(c).alias(m) for c, m in zip(max_cols, tops)])
    kinds = {f.name: f.dataType for f in ev.schema}
    first, last = _day(F.col(run_start)), _day(F.col(run_end))
    sound = F.coalesce(first <= last, F.lit(False))
    q = runs.select(
        F.col(key).alias("_k"), F.when(sound, last).otherwise(0).alias("_at"), F.when(sound, first).otherwise(0).alias("_to"),
        F.when(sound, RUN).otherwise(EMPTY).alias("_what"), F.struct(*run_id).alias("_rid"),
        *[F.lit(0.0).alias(n) for n in names], *[F.lit(None).cast(kinds[m]).alias(m) for m in tops])
    ev = ev.select("_k", "_at", "_to", F.lit(EVENT).alias("_what"), F.lit(None).cast(q.schema["_rid"].dataType).alias("_rid"), *names, *tops)
    rows = ev.unionByName(q).repartition("_k").sortWithinPartitions("_k", "_at", "_what")
    kept = T.StructType([f for f in rows.schema if f.name not in ("_k", "_at", "_to", "_what")])
    out = rows.mapInArrow(_sweep(names, tops), kept)
    return out.select(*[F.col("_rid")[c].alias(c) for c in run_id], *names, *tops)


def interval_overlap_agg(runs: DataFrame, events: DataFrame, key: str, run_id: Sequence[str], run_start: str,
                         run_end: str, ev_start: str, ev_end: str, sum_cols: Sequence[str] = (),
                         count_values: dict | None = None, distinct_on: Sequence[str] | None = None) -> DataFrame:
    """X07 — exact counts and sums over the events whose [start, end] overlaps each run window
    (``interval_overlap``). Event rows are counted as they come; ``distinct_on`` names columns by which repeats are
    dropped first. Empty windows give zeros. Returns run_id columns, n_events, sum_<c>, n_<c>_<v>: one row a run_id.
    """
    ev = events.where(F.col(ev_start).cast("date") <= F.col(ev_end).cast("date"))
    ev = ev.dropDuplicates(list(distinct_on)) if distinct_on else ev
    sums = [(F.col(c), f"sum_{c}") for c in sum_cols]
    for c, vals in (count_values or {}).items():
        sums += [(F.when(F.col(c) == v, F.lit(1)).otherwise(F.lit(0)), f"n_{c}_{v}") for v in vals]
    out = interval_overlap(runs, ev, key, run_id, run_start, run_end, ev_start, ev_end, sums)
    return out.groupBy(*run_id).agg(F.max("n").cast("bigint").alias("n_events"), *[F.max(n).alias(n) for _, n in sums])


def interval_overlap_max(runs: DataFrame, events: DataFrame, key: str, run_id: Sequence[str], run_start: str,
                         run_end: str, ev_start: str, ev_end: str, max_cols: Sequence[str]) -> DataFrame:
    """X07 — the maximum of event columns over the events whose [start, end] overlaps each run window, for values
    of any kind (``interval_overlap``). Returns the run_id columns and ``max_<c>`` of all runs, NULL without an
    overlapping event; empty windows (start > end) overlap nothing.
    """
    return interval_overlap(runs, events, key, run_id, run_start, run_end, ev_start, ev_end, max_cols=max_cols).drop("n")


#: Levels of the dyadic day tree: nodes of 1 to 2**16 days (longer intervals take several of the largest).
DAY_LEVELS = 16


def _canonical(first: Column, last: Column) -> Column:
    """The fewest nodes that together hold exactly the days from ``first`` to ``last``: two on a level at
    most (all between on the topmost). On level j the days not yet covered are the nodes from
    ceil(first / 2^j) up to floor((last + 1) / 2^j); an odd first one, and the last one before an odd end,
    have no parent inside the interval."""
    def on(j: Column) -> Column:
        a = -F.call_function("shiftright", -first, j)
        b = F.call_function("shiftright", last + 1, j)
        ends = F.array_distinct(F.concat(
            F.when((a < b) & (a % 2 != 0), F.array(a)).otherwise(F.array().cast("array<int>")),
            F.when((a < b) & (b % 2 != 0), F.array(b - 1)).otherwise(F.array().cast("array<int>"))))
        top = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.when(j == DAY_LEVELS, top).otherwise(ends), lambda x: F.struct(j.alias("level"), x.alias("node")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(DAY_LEVELS)), on))


def event_window_features(runs: DataFrame, events: DataFrame, key: str, run_id: Sequence[str], run_start: str, run_end: str,
                          ev_start: str = "start", ev_end: str = "end", attendance: str = "attendance", rank: str = "rank",
                          kind: str = "kind", kinds: Sequence[str] = ("sports", "concerts"), holiday: str = "holidays",
                          weather: str = "severe-weather", significant: int = 30,
                          distinct_on: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """X07 — features of the events around each run: every run, those without events with zeros.

    ``attendance_sum`` and ``attendance_<kind>`` add up the attendance of overlapping events (unknown counts
    as 0), ``event_count`` counts those of at least the ``significant`` rank and ``rank_avg`` is their mean
    rank (NULL without any), ``rank_max`` is the greatest rank of all of them (NULL without any),
    ``holidays_flag`` and ``severe_weather_flag`` are 1 if an event of that kind overlaps. Runs with a NULL in
    ``run_id`` are left out; ``keep`` names further columns of the runs that go on with them.
    """
    big = F.col(rank) >= significant
    number = F.coalesce(F.col(attendance).cast("double"), F.lit(0.0))
    ev = events.select(
        "*", number.alias("_att"), *[F.when(F.col(kind) == k, number).otherwise(F.lit(0.0)).alias(f"_att_{i}") for i, k in enumerate(kinds)],
        F.when(big, F.lit(1)).otherwise(F.lit(0)).alias("_big"), F.when(big, F.col(rank)).otherwise(F.lit(0)).alias("_rank"),
        F.when(F.col(kind) == holiday, F.lit(1)).otherwise(F.lit(0)).alias("_holiday"),
        F.when(F.col(kind) == weather, F.lit(1)).otherwise(F.lit(0)).alias("_weather"))
    ev = ev.dropDuplicates(list(distinct_on)) if distinct_on else ev
    ev = ev.where(F.col(ev_start).cast("date") <= F.col(ev_end).cast("date"))
    ev = cut(ev.select(*dict.fromkeys([key, ev_start, ev_end, rank]), "_att", *[f"_att_{i}" for i in range(len(kinds))],
                       "_big", "_rank", "_holiday", "_weather"))         # ends the lineage of the joins behind the events
    sums = ["_att", *[f"_att_{i}" for i in range(len(kinds))], "_big", "_rank", "_holiday", "_weather"]
    both = interval_overlap(runs.dropna(subset=list(run_id)), ev, key, [*run_id, *keep], run_start, run_end, ev_start, ev_end,
                            [(F.col(c), f"sum{c}") for c in sums], [rank])
    total = {c: F.col(f"sum{c}") for c in sums}
    return both.select(
        *run_id, *keep, F.col("n").cast("bigint").alias("n_events"), total["_att"].alias("attendance_sum"),
        *[total[f"_att_{i}"].alias(f"attendance_{k}") for i, k in enumerate(kinds)],
        total["_big"].cast("bigint").alias("event_count"), F.col(f"max_{rank}").alias("rank_max"),
        (total["_rank"] / F.nullif(total["_big"], F.lit(0.0))).alias("rank_avg"),
        (total["_holiday"] > 0).cast("int").alias("holidays_flag"), (total["_weather"] > 0).cast("int").alias("severe_weather_flag"))
