"""Registered queries: one per operator id, each reading the driver tables at ``sf_dir``.

Each callable takes (spark, sf_dir) and returns a lazy DataFrame whose column
names match the oracle in ``stagecast.plans.oracles``. Doubles are rounded to
6 places at the very end so the value hash is stable across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagecast.operators import rollup as RO
from stagecast.operators import runs as R
from stagecast.session import ensure_checkpoint_dir
from stagecast.sources import binding as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (only for comparison output)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), places) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


@query("A01_anchored_runs")
def q_a01(spark, sf):
    return rounded(R.anchored_runs(B.history_cube(spark, sf)))


@query("A02_prior_stats")
def q_a02(spark, sf):
    return rounded(R.prior_stats(R.anchored_runs(B.history_cube(spark, sf))))


# ---------------------------------------------------------------- scoring pipeline stages
from stagecast.functions import signals as SG  # noqa: E402
from stagecast.operators import allocate as AL  # noqa: E402
from stagecast.operators import models as M  # noqa: E402
from stagecast.operators import neighbours as NB  # noqa: E402
from stagecast.operators import robust as RB  # noqa: E402
from stagecast.plans import pipeline as PL  # noqa: E402


def _plan(spark, sf):
    return PL.plan_from_tables(spark, sf, proposed_month=3)


@query("A05_iqr_filter")
def q_a05(spark, sf):
    p = _plan(spark, sf)
    return rounded(RB.iqr_filter(p.past_runs, "category", "ticket_median")
                   .select("title", "run_no", "category", "month", "ticket_median"))


@query("A06_trimmed_median")
def q_a06(spark, sf):
    p = _plan(spark, sf)
    kept = RB.iqr_filter(p.past_runs, "category", "ticket_median")
    return rounded(RB.trimmed_median_by(kept, "ticket_median", "category"))


@query("A07_seasonality_table")
def q_a07(spark, sf):
    return rounded(_plan(spark, sf).seasonality)


@query("P16_mid_date")
def q_p16(spark, sf):
    return _plan(spark, sf).runs.select("title", "run_no", "mid_date", "month", "year")


@query("J14_last_mid_date")
def q_j14(spark, sf):
    return _plan(spark, sf).last_mid


@query("J15_runs_with_category_and_median")
def q_j15(spark, sf):
    return rounded(_plan(spark, sf).past_runs.select("title", "run_no", "category", "ticket_median"))


@query("J11_known_unknown")
def q_j11(spark, sf):
    """Every seventh title has no baseline row: its signals are estimated, category bumps included."""
    p = _plan(spark, sf)
    known = p.baselines.where(F.col("title") % 7 != 0)
    est = SG.estimate_unknown(p.titles.join(known, "title", "left_anti"), known, "category", bumps=BOUND_BUMPS)
    both = p.titles.join(known.select("title", *PL.SIGNALS), "title").withColumn("Source", F.lit("Baseline")).unionByName(
        est.withColumn("Source", F.lit("Estimated")))
    return rounded(both.select("title", "Source", *PL.SIGNALS))


#: Bumps by category of the driver tables, in the units of each signal; one of them leaves the clip range.
BOUND_BUMPS = {"PROMO": {"wiki": 6.0, "youtube": 4.0}, "SMALL": {"trends": 3.5, "chartmetric": -2.0}, "LARGE": {"wiki": 40.0}}


@query("P11_estimate_unknown")
def q_p11(spark, sf):
    p = _plan(spark, sf)
    return rounded(SG.estimate_unknown(p.titles.select("title", "category"), p.baselines, "category", bumps=BOUND_BUMPS)
                   .select("title", *SG.SIGNALS))


@query("F01_raw_scores")
def q_f01(spark, sf):
    return rounded(_plan(spark, sf).base.select("title", "FamiliarityRaw", "MotivationRaw"))


@query("J12_benchmark_cross")
def q_j12(spark, sf):
    p = _plan(spark, sf)
    b = F.broadcast(p.benchmark.select(F.col("title").alias("benchmark_title")))
    return rounded(SC2.benchmark_index(p.base, p.benchmark).crossJoin(b).select("title", "benchmark_title", "Familiarity"))


@query("F02_benchmark_index")
def q_f02(spark, sf):
    return rounded(_plan(spark, sf).indexed.select("title", "Familiarity", "Motivation"))


@query("F03_signal_only")
def q_f03(spark, sf):
    return rounded(_plan(spark, sf).indexed.select("title", "SignalOnly"))


@query("J13_factor_lookup")
def q_j13(spark, sf):
    return rounded(_plan(spark, sf).indexed.select("title", "HistSeasonalityFactor"))


@query("F05_deseason_index")
def q_f05(spark, sf):
    return rounded(_plan(spark, sf).indexed.select(
        "title", "TicketMedian", "HistSeasonalityFactor", "TicketIndex_DeSeason", "prior_total_tickets",
        "run_count_prior"))


@query("F06_anchored_ridge")
def q_f06(spark, sf):
    return rounded(_plan(spark, sf).overall_model)


@query("F07_group_fit")
def q_f07(spark, sf):
    return rounded(_plan(spark, sf).category_models)


@query("F09_fit_metrics")
def q_f09(spark, sf):
    p = _plan(spark, sf)
    return rounded(M.fit_metrics(p.known, p.overall_model))


def _hidden_plan(spark, sf):
    """The plan with every 5th title's history hidden, so that imputation and fallbacks have work."""
    return PL.plan_from_tables(spark, sf, proposed_month=3, hidden_every=B.HIDDEN_EVERY)


@query("F10_tiered_impute")
def q_f10(spark, sf):
    p = _hidden_plan(spark, sf)
    # some hidden titles have no signal, some a category without a model
    signal = F.when(F.col("title") % 35 == 0, F.lit(None).cast("double")).otherwise(F.col("SignalOnly"))
    category = F.when(F.col("title") % 55 == 0, F.lit("UNSEEN")).otherwise(F.col("category"))
    d = p.indexed.withColumn("SignalOnly", signal).withColumn("category", category)
    out = M.tiered_impute(d, p.overall_model, p.category_models, "category", clip=p.cfg.prediction_clip)
    return rounded(out.select("title", "TicketIndex_DeSeason_Used", "TicketIndexSource", "TicketIndex_Predicted"))


@query("F11_apply_future_factor")
def q_f11(spark, sf):
    return rounded(_plan(spark, sf).imputed.select("title", "FutureSeasonalityFactor", "EffectiveTicketIndex"))


@query("F12_composite")
def q_f12(spark, sf):
    return rounded(_plan(spark, sf).imputed.select("title", "Composite"))


@query("F13_estimate")
def q_f13(spark, sf):
    return rounded(_plan(spark, sf).imputed.select("title", "EstimatedTickets", "EstimatedTickets_Final"))


def _seg_long(spark, sf):
    p = _plan(spark, sf)
    return p.scored.select("title", F.explode("segment_mix").alias("s")).select("title", "s.*")


@query("F04_segment_index")
def q_f04(spark, sf):
    d = _plan(spark, sf).segment_index(_plan(spark, sf).base)
    return rounded(d.select("title", F.explode("_seg_idx").alias("s")).select("title", "s.segment", "s.idx"))


@query("F14_segment_shares")
def q_f14(spark, sf):
    return rounded(_seg_long(spark, sf).select("title", "segment", "share", "rank"))


@query("F15_segment_tickets")
def q_f15(spark, sf):
    return rounded(_seg_long(spark, sf).select("title", "segment", "tickets"))


@query("F16_segment_weights_json")
def q_f16(spark, sf):
    return _plan(spark, sf).scored.select("title", "segment_weights")


@query("A03_long_to_wide")
def q_a03(spark, sf):
    p = _plan(spark, sf)
    return rounded(AL.long_to_wide(AL.city_totals(p.history), "title", "city", p.cities))  # pivot form of A03


@query("A04_title_city_shares")
def q_a04t(spark, sf):
    return rounded(AL.shares_long(_plan(spark, sf).city_shares[0], "title").select("title", "city", "share"))


@query("A04_category_city_shares")
def q_a04c(spark, sf):
    return rounded(AL.shares_long(_plan(spark, sf).city_shares[1], "category").select("category", "city", "share"))


def _city_long(spark, sf, plan=_plan):
    p = plan(spark, sf)
    return p.scored.select("title", F.col("city_split_source").alias("split_source"),
                           F.explode("city_alloc").alias("c")).select("title", "split_source", "c.*")


@query("J10_share_fallback")
def q_j10(spark, sf):
    return rounded(_city_long(spark, sf, _hidden_plan).select("title", "city", "share", "split_source"))


@query("F17_city_allocation")
def q_f17(spark, sf):
    return rounded(_city_long(spark, sf).select("title", "city", "share", "tickets"))


@query("X11_two_stage_split")
def q_x11(spark, sf):
    seg = _seg_long(spark, sf).select("title", "segment", "tickets")
    city = _city_long(spark, sf).select("title", "city", "share")
    return rounded(AL.two_stage_split(seg, city).select("title", "segment", "city", "tickets"))


@query("FLAGSHIP_score_titles")
def q_flagship(spark, sf):
    return rounded(PL.score_titles_from_tables(spark, sf, proposed_month=3))


# ---------------------------------------------------------------- scalar functions, text rules, sources
from stagecast.functions import columns as P  # noqa: E402
from stagecast.sources import io as IO  # noqa: E402

# FIXED VALUES (binding) — text rules over part names for the driver tables
BIND_GENDER_RULES = [("co", ["hot", "rod"], []), ("female", [], ["ring", "plate", "gizmo"]),
                     ("male", [], ["bolt", "anvil", "gear"])]
BIND_CATEGORY_RULES = [("family_classic", ["small", "new"]), ("classic_romance", ["red", "blue"]),
                       ("romantic_tragedy", ["hot"]), ("contemporary", ["cold"])]
BIND_CITY_PATTERNS = [("amer", "AMERICA"), ("eur", "EUROPE")]
BIND_ALIASES = {"small ring": "ring (small)", "red widget": "widget (red)"}


@query("P01_parse_number")
def q_p01(spark, sf):
    li = B.read(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    # some cells hold what is no number
    text = F.when(n == 5, "nan").when(n == 6, "12d").when(n == 7, " ").otherwise(F.format_number("l_extendedprice", 2))
    return rounded(li.select("l_orderkey", "l_linenumber", P.parse_number(text).alias("price")))


@query("P02_canon_city")
def q_p02(spark, sf):
    g = B.customer_geo(spark, sf)
    return (g.groupBy(P.canon_city(F.col("region"), BIND_CITY_PATTERNS).alias("city"))
            .agg(F.count(F.lit(1)).alias("customers")))


@query("P03_title_key")
def q_p03(spark, sf):
    part = B.read(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("title"), P.title_key(F.col("p_name"), BIND_ALIASES).alias("title_key"))


@query("P05_infer_gender_and_category")
def q_p05(spark, sf):
    part = B.read(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("title"),
                       P.infer_gender(F.col("p_name"), BIND_GENDER_RULES).alias("gender"),
                       P.infer_category(F.col("p_name"), BIND_CATEGORY_RULES).alias("category"))


@query("P06_infer_show_type")
def q_p06(spark, sf):
    part = B.read(spark, sf, "part")
    cat = P.infer_category(F.col("p_name"), BIND_CATEGORY_RULES)
    return part.select(F.col("p_partkey").alias("title"), P.infer_show_type(F.col("p_name"), cat).alias("show_type"))


@query("P07_log_index")
def q_p07(spark, sf):
    li = B.read(spark, sf, "lineitem")
    g = (SG.exact_percentiles(li.withColumn("title", F.col("l_partkey")), F.col("l_extendedprice") / 100.0, [0.5], "title")
         .select("title", F.col("n").alias("_n"), F.col("p0").alias("_mv")))
    return rounded(g.select("title", SG.wiki_index(F.col("_n")).alias("wiki_index"),
                            SG.video_index(F.col("_mv")).alias("video_index")))


@query("P08_median_percentile_signals")
def q_p08(spark, sf):
    li = B.read(spark, sf, "lineitem").withColumnRenamed("l_partkey", "title")
    return rounded(SG.signal_stats(li, "title", "l_quantity"))


@query("P09_title_match")
def q_p09(spark, sf):
    conv = B.read(spark, sf, "conversations")
    q = conv.where(F.col("turn") == 0).select("conv_id", F.col("text").alias("query"))
    c = conv.where(F.col("turn") > 0).join(q, "conv_id")
    m = P.add_title_match(c, "text", "query", "matched").select("conv_id", "turn", "matched")
    found = F.count_if(F.col("matched")).over(Window.partitionBy("conv_id"))
    return m.select("conv_id", "turn", "matched", (F.col("matched") | (found < 5)).alias("used"))


@query("P10_winsorize_by_group")
def q_p10(spark, sf):
    p = _plan(spark, sf)
    y = F.when(F.col("title") % 7 != 0, SG.length_video(F.col("name")))       # some titles have no value
    vals = p.titles.select("title", "category", y.alias("youtube"))
    ref = p.baselines.select("category", "youtube")
    return rounded(SG.winsorize_by_group(vals, ref, "category", "youtube").select("title", "youtube"))


@query("P12_length_heuristics")
def q_p12(spark, sf):
    part = B.read(spark, sf, "part")
    return rounded(part.select(F.col("p_partkey").alias("title"), SG.length_trends(F.col("p_name")).alias("trends"),
                               SG.length_video(F.col("p_name")).alias("youtube"),
                               SG.length_streaming(F.col("p_name")).alias("streaming")))


@query("P13_bands")
def q_p13(spark, sf):
    d = _plan(spark, sf).scored
    return d.select("title", P.letter_score(F.col("Composite")).alias("score"),
                    P.star_rating(F.col("EffectiveTicketIndex")).alias("stars"),
                    P.signal_level(F.col("SignalOnly")).alias("signal_level"),
                    P.demand_tier(F.col("TicketIndex_DeSeason_Used")).alias("demand_tier"))


@query("P14_segment_tilt")
def q_p14(spark, sf):
    d = _plan(spark, sf).scored
    return d.select("title", P.first_nonblank(F.lit(""), F.col("dominant_audience_segment"),
                                              F.col("PredictedPrimarySegment")).alias("segment_tilt"))


@query("P17_temporal_flags")
def q_p17(spark, sf):
    r = _plan(spark, sf).runs
    m = F.month("run_start")
    return r.select("title", "run_no", m.alias("month_of_opening"), P.holiday_flag(m).alias("holiday_flag"),
                    P.month_name(m).alias("run_month"))


@query("S01_normalize_columns")
def q_s01(spark, sf):
    c = B.read(spark, sf, "customer")
    messy = c.toDF(*[f"  {n.upper().replace('_', ' - ', 1)} " for n in c.columns])
    return IO.normalize_columns(messy)


@query("S02_clean_frame")
def q_s02(spark, sf):
    ev = B.read(spark, sf, "events").select(
        "event_id", F.concat(F.when(F.col("event_type") == "signup", "1,").when(F.col("event_type") == "error", "x").otherwise(""),
                             F.col("value").cast("string")).alias("value"), F.lit(None).cast("string").alias("Unnamed: 0"),
        F.col("props").alias("unnamed_props"), "event_type")
    return rounded(IO.clean_frame(ev, drop_unnamed=True, drop_empty_unnamed_only=True, numeric_columns=["value"]))


@query("S03_read_sales_history")
def q_s03(spark, sf):
    h = B.history(spark, sf).select("title", "city", "start_date", F.col("single_tickets").cast("string").alias("single_tickets"))
    bad = h.where(F.col("single_tickets") == "1.0").withColumn("single_tickets", F.lit("nan"))   # rows to be dropped
    h = h.unionByName(bad)
    return IO.clean_sales_history(h, date_cols=("start_date",)).groupBy("title", "city").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("single_tickets"), 6).alias("tickets"),
        F.min("start_date").alias("first_date"))


def _bind_baselines(spark, sf):
    return B.baselines(spark, sf).withColumn(
        "source", F.when(F.col("category") == "PROMO", F.lit("external_reference")).otherwise(F.lit("historical")))


@query("S04_baselines_source_filter")
def q_s04(spark, sf):
    return IO.baselines_by_source(_bind_baselines(spark, sf), include_reference=False).select("title", "source")


@query("S05_baselines_keep_last")
def q_s05(spark, sf):
    b = _bind_baselines(spark, sf).select(
        F.col("name").alias("title_name"), "title", "wiki", "category",
        F.format_number(F.col("chartmetric") / 1000.0, 4).alias("intentratio"))
    k = IO.keep_baselines(b, "title_name", order_col="title")
    return rounded(k.select("title_name", "title", "wiki", "category", "intentratio"))


@query("S08_segment_priors_clean")
def q_s08(spark, sf):
    p = _plan(spark, sf)
    pr = p.priors.select(F.concat(F.lit(" "), "region").alias("region"), "category", "segment",
                         F.col("weight").cast("string").alias("weight"), F.lit(2).alias("line"))
    # an earlier duplicate of each row, and a later one without a number
    old = pr.withColumn("weight", F.lit("9")).withColumn("line", F.lit(1))
    bad = pr.withColumn("weight", F.lit("1,5")).withColumn("line", F.lit(3))
    return rounded(IO.clean_segment_priors(pr.unionByName(old).unionByName(bad), PL.BINDING_SEGMENTS[:4], "line"))


@query("S09_past_runs_parse")
def q_s09(spark, sf):
    r = _plan(spark, sf).runs.select(F.col("title").cast("string").alias("title"),
                                     F.date_format("run_start", "yyyy-MM-dd").alias("start_date"),
                                     F.date_format("run_end", "yyyy/MM/dd").alias("end_date"))
    strict = IO.clean_past_runs(r, drop_bad_dates=False)
    return strict.groupBy("title").agg(F.count(F.lit(1)).alias("runs"), F.count("start_date").alias("parsed_start"),
                                       F.count("end_date").alias("parsed_end"))


# FIXED VALUES (binding) — the event types, each a "city" with a table of its own
EVENT_TYPES = ("view", "purchase", "click", "signup", "error")


@query("S15_weather_union")
def q_s15(spark, sf):
    w = B.daily_weather(spark, sf)
    frames = {c: w.where(F.col("city") == c).drop("city") for c in EVENT_TYPES}
    return rounded(IO.union_cities(frames).groupBy("city").agg(F.count(F.lit(1)).alias("days"),
                                                               F.avg("snow").alias("avg_snow")))


# ---------------------------------------------------------------- joins and factors
from stagecast.operators import joins as J  # noqa: E402
from stagecast.operators import scoring as SC2  # noqa: E402


def _ext_factors(spark, sf):
    """External factors per (year, city) from orders: order count and mean order value."""
    o = B.read(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    g = B.customer_geo(spark, sf)
    return (o.join(g, o.o_custkey == g.c_custkey)
            .groupBy(F.year("o_orderdate").alias("year"), F.col("region").alias("city"))
            .agg(F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("avg_order_value")))


@query("J01_left_enrich")
def q_j01(spark, sf):
    cube = B.history_cube(spark, sf).withColumn("year", F.year("start_date"))
    out = J.left_enrich(cube.select("title", "city", "segment", "start_date", "year"), _ext_factors(spark, sf))
    return rounded(out)


def _event_features(spark, sf):
    """Per (part, supplier region): supplied line count and mean discount."""
    li = B.read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_discount")
    s = B.read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = B.read(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = B.read(spark, sf, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name"))
    sg = s.join(geo, s.s_nationkey == geo.n_nationkey).select("s_suppkey", "r_name")
    return (li.join(sg, li.l_suppkey == sg.s_suppkey)
            .groupBy(F.col("l_partkey").alias("show_title"), F.col("r_name").alias("city"))
            .agg(F.count(F.lit(1)).alias("supplied_lines"), F.avg("l_discount").alias("avg_discount")))


@query("J02_left_enrich_events")
def q_j02(spark, sf):
    cube = B.history_cube(spark, sf).select("title", "city", "segment", "start_date")
    return rounded(J.enrich_events(cube, _event_features(spark, sf)))


def _events_with_city(spark, sf):
    ev = B.read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select("event_id", F.col("ts").cast("date").alias("date"), F.col("event_type").alias("city"))


@query("J03_weather_by_date_city")
def q_j03(spark, sf):
    out = J.join_weather(_events_with_city(spark, sf), B.daily_weather(spark, sf), "date", "city", "city",
                         ("min_temperature", "snow"))
    return rounded(out.select("event_id", "weather_min_temperature", "weather_snow"))


def _spend(spark, sf):
    li = B.read(spark, sf, "lineitem").select("l_partkey", "l_extendedprice", "l_discount")
    return li.groupBy(F.col("l_partkey").alias("title")).agg(
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("marketing_spend"))


@query("J04_marketing_join")
def q_j04(spark, sf):
    cube = B.history_cube(spark, sf).select("title", "city", "segment", "start_date")
    return rounded(J.join_marketing(cube, _spend(spark, sf)))


@query("J05_chained_enrich_check")
def q_j05(spark, sf):
    li = B.read(spark, sf, "lineitem")
    return J.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


def _asof(spark, sf):
    left, right = B.as_of_sides(spark, sf)
    return J.asof_last(left, right, "user_id", "ts", ["view_value", "view_id"], tie="view_id")


@query("J06_asof_last")
def q_j06(spark, sf):
    a = _asof(spark, sf)
    # timestamps as epoch microseconds so both engines report the same type
    return rounded(a.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "value",
                            "view_value", "view_id",
                            F.unix_micros(F.col("matched_ts").cast("timestamp")).alias("matched_ts_us")))


def _exact_latest(spark, sf):
    ev = B.read(spark, sf, "events").select("event_id", F.col("event_type").alias("city"),
                                            F.date_add(F.col("ts").cast("date"), 15).alias("run_date"))
    return J.exact_else_latest(ev, B.daily_weather(spark, sf), "city", "run_date", "date", ["min_temperature", "snow"])


@query("J07_exact_else_latest")
def q_j07(spark, sf):
    return rounded(_exact_latest(spark, sf).select("event_id", "min_temperature", "snow", "match"))


@query("F21_weather_factor")
def q_f21(spark, sf):
    d = _exact_latest(spark, sf)
    return rounded(d.select("event_id", SC2.weather_factor("min_temperature", "snow").alias("weather_factor")))


@query("F20_economic_factor")
def q_f20(spark, sf):
    left, views = B.as_of_sides(spark, sf)
    ev = B.read(spark, sf, "events")
    signups = ev.where(F.col("event_type") == "signup").select(
        "user_id", "ts", (F.col("value") / 10.0).alias("rate"), F.col("event_id").alias("signup_id"))
    a = J.asof_last(left, views, "user_id", "ts", ["view_value", "view_id"], tie="view_id").drop("matched_ts")
    b = J.asof_last(a, signups, "user_id", "ts", ["rate", "signup_id"], tie="signup_id")
    return rounded(b.select("event_id", SC2.economic_factor("view_value", "rate").alias("economic_factor")))


def _lookup_keys(spark, sf):
    s = B.sales(spark, sf).select("title", "region", "segment")
    t = B.titles(spark, sf).select("title", "category")
    return s.join(t, "title").select("region", "category", "segment").distinct()


def _spelled_twice(priors):
    """Priors with a second spelling of every row, as source files have them."""
    again = priors.select(F.lower("region").alias("region"), F.concat(F.lit(" "), F.lower("category")).alias("category"), "segment", "weight")
    return priors.unionByName(again)


@query("J08_hierarchical_lookup")
def q_j08(spark, sf):
    return rounded(J.hierarchical_lookup(_lookup_keys(spark, sf), _spelled_twice(_plan(spark, sf).priors)))


@query("J09_hierarchical_lookup_set")
def q_j09(spark, sf):
    return rounded(J.hierarchical_lookup_set(_lookup_keys(spark, sf), _plan(spark, sf).priors))


# ---------------------------------------------------------------- profiling and summaries
from stagecast.operators import profile as PR  # noqa: E402
from stagecast.plans import season as SE  # noqa: E402

SOURCE_LABELS = ["History", "Category model", "Overall model", "ML Category", "ML Overall", "kNN Fallback",
                 "Not enough data"]


@query("A08_monthly_weather_summary")
def q_a08(spark, sf):
    w = B.daily_weather(spark, sf)
    return rounded(PR.monthly_weather_summary(w))


@query("A09_profile_source")
def q_a09(spark, sf):
    li = B.read(spark, sf, "lineitem")
    return rounded(PR.profile_source(li, "lineitem", expected=["l_orderkey", "l_comment"],
                                     required=["l_quantity"], date_col="l_shipdate"))


@query("A10_registry_report")
def q_a10(spark, sf):
    profs = [PR.profile_source(B.read(spark, sf, t), t, expected=e, date_col=d)
             for t, d, e in (("lineitem", "l_shipdate", ()), ("orders", "o_orderdate", ("o_orderkey", "o_comment")),
                             ("events", "ts", ()), ("customer", None, ()))]
    return PR.registry_report(profs)


@query("A11_source_mix")
def q_a11(spark, sf):
    """Sources of the tiered imputation (F10), which reaches every tier."""
    return PR.source_mix(QUERIES["F10_tiered_impute"](spark, sf), "TicketIndexSource", SOURCE_LABELS)


def _intent(spark, sf):
    li = B.read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("title")).agg(
        (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("IntentRatio"))


@query("A12_intent_summary")
def q_a12(spark, sf):
    return rounded(PR.intent_summary(_intent(spark, sf)))


@query("A13_implied_benchmark")
def q_a13(spark, sf):
    return rounded(SE.implied_benchmark(_plan(spark, sf).imputed))


def _season_plan(spark, sf):
    p = _plan(spark, sf)
    split = p.scored.select("title", "city_split")
    months = [m for _, m in SE.PLAN_MONTHS]
    last = F.month("mid_date")
    # a title whose last month is no plan month gets one by its key, so that every title has a slot
    other = F.element_at(F.array(*[F.lit(m) for m in months]), (F.col("title") % len(months)).cast("int") + 1)
    assign = p.last_mid.select("title", F.when(last.isin(*months), last).otherwise(other).alias("month"))
    return SE.season_plan(assign, p.scored, p.seasonality, split, 2027, p.cities)


@query("R01_season_plan")
def q_r01(spark, sf):
    return rounded(_season_plan(spark, sf).select(
        "Month", "title", "FutureSeasonalityFactor", "TicketIndex_used", "EstimatedTickets", "EstimatedTickets_Final",
        "Singles_AMERICA", "Singles_EUROPE", "CityShare_AMERICA", "Score", "holiday_flag"))


@query("R02_board_summary")
def q_r02(spark, sf):
    return SE.board_summary(_season_plan(spark, sf), ["AMERICA", "EUROPE"])


@query("R03_financial_summary")
def q_r03(spark, sf):
    plan = _season_plan(spark, sf)
    plan = (plan.withColumn("EstimatedTickets_Final", F.col("EstimatedTickets_Final").cast("bigint"))
            .withColumn("Singles_AMERICA", F.col("Singles_AMERICA").cast("bigint"))
            .withColumn("Singles_EUROPE", F.col("Singles_EUROPE").cast("bigint")))
    return SE.metrics_by_month(plan, ["title", "EstimatedTickets_Final", "Singles_AMERICA", "Singles_EUROPE"])


@query("R04_wide_plan")
def q_r04(spark, sf):
    p = _plan(spark, sf)
    return rounded(SE.wide_metrics(_season_plan(spark, sf), p.scored, p.cities))


@query("R05_rank_plan")
def q_r05(spark, sf):
    plan = _season_plan(spark, sf).withColumn("Composite", F.round("Composite", 6))
    return rounded(SE.rank_plan(plan).select("rank", "Month", "title", "Composite", "EstimatedTickets_Final"))


@query("A14_plan_totals")
def q_a14(spark, sf):
    return rounded(SE.plan_totals(_season_plan(spark, sf), ["AMERICA", "EUROPE"]))


@query("A15_city_by_month")
def q_a15(spark, sf):
    return rounded(SE.city_by_month(_season_plan(spark, sf), ["AMERICA", "EUROPE"]))


@query("A16_scatter_quadrants")
def q_a16(spark, sf):
    return rounded(SE.scatter_quadrants(_season_plan(spark, sf)))


@query("A18_sort_topk")
def q_a18(spark, sf):
    d = _plan(spark, sf).scored
    top = d.select("title", "EstimatedTickets", "Composite").orderBy(
        F.col("EstimatedTickets").desc_nulls_last(), F.col("Composite").desc(), F.col("Motivation").desc(),
        F.col("Familiarity").desc(), F.col("title")).limit(25)
    return rounded(top)


@query("A19_union_all")
def q_a19(spark, sf):
    w = B.daily_weather(spark, sf)
    frames = {c: w.where(F.col("city") == c).drop("city") for c in EVENT_TYPES}
    u = IO.union_cities(frames)
    return u.groupBy("city").agg(F.count(F.lit(1)).alias("days"))


# ---------------------------------------------------------------- attribution
from stagecast.operators import explain as EX  # noqa: E402

ATTR_FEATURES = ["wiki", "trends", "youtube", "chartmetric"]


def _attr(spark, sf):
    """Whole-table attribution: E02 fit on titles with history, E03 applied to every title."""
    p = _plan(spark, sf)
    if not hasattr(p, "attribution"):          # kept with the plan that it belongs to
        coefs = EX.fit_multi_ridge(p.known, ATTR_FEATURES, "TicketIndex_DeSeason", alpha=5.0)
        a = EX.attribute(p.indexed.select("title", *ATTR_FEATURES), coefs, ATTR_FEATURES)
        a = a.withColumn("contributions", EX.contributions(ATTR_FEATURES))
        p.attribution = (coefs, p._mat(a))
    return p.attribution


@query("E01_sanitize_features")
def q_e01(spark, sf):
    ev = B.read(spark, sf, "events")
    x = F.when(F.col("event_type") == "error", F.lit(float("inf"))).when(
        F.col("event_type") == "signup", F.lit(None).cast("double")).otherwise(F.col("value"))
    return rounded(ev.select("event_id", EX.sanitize(x).alias("value")))


@query("E02_multi_ridge")
def q_e02(spark, sf):
    coefs, _ = _attr(spark, sf)
    return rounded(coefs.select("intercept", *[f"beta_{f}" for f in ATTR_FEATURES], "n"))


@query("E03_linear_attribution")
def q_e03(spark, sf):
    _, a = _attr(spark, sf)
    return rounded(a.select("title", "prediction", "base_value", *[f"shap_{f}" for f in ATTR_FEATURES]))


@query("E04_contributions")
def q_e04(spark, sf):
    _, a = _attr(spark, sf)
    x = a.select("title", F.posexplode("contributions").alias("i", "c"))
    return rounded(x.select("title", (F.col("i") + 1).alias("rank"), "c.name", "c.shap", "c.direction"))


@query("E05_top_drivers")
def q_e05(spark, sf):
    _, a = _attr(spark, sf)
    x = a.select("title", F.posexplode(EX.top_drivers(F.col("contributions"), 3, 0.5)).alias("i", "c"))
    return rounded(x.select("title", (F.col("i") + 1).alias("rank"), "c.name", "c.shap"))


@query("E06_attribution_text")
def q_e06(spark, sf):
    _, a = _attr(spark, sf)
    return a.select("title", EX.attribution_text(F.col("prediction"), F.col("base_value"),
                                                 F.col("contributions")).alias("narrative"))


@query("E07_attribution_table")
def q_e07(spark, sf):
    _, a = _attr(spark, sf)
    return rounded(EX.attribution_table(a, "title", "contributions", 3))


@query("E08_batch_attribution")
def q_e08(spark, sf):
    _, a = _attr(spark, sf)
    total = sum((F.col(f"shap_{f}") for f in ATTR_FEATURES), F.lit(0.0))
    return rounded(a.select("title", "prediction", F.abs(F.col("base_value") + total - F.col("prediction")).alias("additivity_gap")))


@query("E09_push_pull")
def q_e09(spark, sf):
    _, a = _attr(spark, sf)
    pp = EX.push_pull(F.col("contributions"))
    return rounded(a.select("title", pp["total_positive"].alias("total_positive"),
                            pp["total_negative"].alias("total_negative"),
                            F.size(pp["positive"]).alias("n_positive"), F.size(pp["negative"]).alias("n_negative")))


@query("E10_driver_sentence")
def q_e10(spark, sf):
    _, a = _attr(spark, sf)
    return a.select("title", EX.driver_sentence(F.col("contributions")).alias("drivers"))


@query("A17_mean_abs_attribution")
def q_a17(spark, sf):
    _, a = _attr(spark, sf)
    return rounded(EX.mean_abs_attribution(a, ATTR_FEATURES, top=8))


# ---------------------------------------------------------------- fallback fits, priors, tier-2 operators
from stagecast.operators import runs as RN  # noqa: E402


@query("F08_anchored_ols")
def q_f08(spark, sf):
    p = _plan(spark, sf)
    ov = M.anchored_ridge(p.known, anchor_rule="ols", min_rows=5).select(
        F.lit("__overall__").alias("category"), "n", "slope", "intercept")
    cat = M.group_fit(p.known, "category", anchors=True)
    return rounded(ov.unionByName(cat))


@query("F18_tempered_prior")
def q_f18(spark, sf):
    pr = _plan(spark, sf).priors
    return rounded(pr.select("region", "category", "segment", SC2.tempered_prior("weight", 0.5).alias("weight")))


@query("F19_softmax_like")
def q_f19(spark, sf):
    pr = _plan(spark, sf).priors.withColumn("_g", F.concat_ws("|", "region", "category"))
    return rounded(SC2.softmax_like(pr, "_g", "weight", temperature=0.5).select("region", "category", "segment", "mix"))


@query("X02_calibrate")
def q_x02(spark, sf):
    _, a = _attr(spark, sf)
    p = _plan(spark, sf)
    d = a.select("title", "prediction").join(p.known.select("title", "category", "TicketIndex_DeSeason"), "title")
    g = M.calibrate(d, "prediction", "TicketIndex_DeSeason", "category")
    o = M.calibrate(d, "prediction", "TicketIndex_DeSeason").select(F.lit("__overall__").alias("category"), "*")
    return rounded(g.unionByName(o))


@query("X03_backtest")
def q_x03(spark, sf):
    p = _plan(spark, sf)
    first = p.runs.groupBy("title").agg(F.min("run_start").alias("first_run"))
    d = p.known.select("title", "category", "SignalOnly", "TicketIndex_DeSeason").join(first, "title")
    bt = M.expanding_backtest(d, "category", ["first_run", "title"], "SignalOnly", "TicketIndex_DeSeason",
                              F.date_trunc("month", "first_run"))
    err = F.col("TicketIndex_DeSeason") - F.col("prediction")
    return rounded(bt.where(F.col("prediction").isNotNull()).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("MAE"), F.sqrt(F.avg(err * err)).alias("RMSE")))


@query("X04_modelling_dataset")
def q_x04(spark, sf):
    runs = _plan(spark, sf).runs
    return rounded(RN.modelling_dataset(runs))


def _ticket_lines(spark, sf):
    """lineitem as ticket lines: order priority tells subscriptions and tiers, return flag the channel."""
    li = B.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
                                              "l_returnflag", "l_shipdate")
    o = B.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    geo = B.customer_geo(spark, sf).select("c_custkey", "region")
    part = B.read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    city = F.create_map(*[F.lit(x) for kv in B.CITY_OF_REGION.items() for x in kv])[F.col("region")]
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(geo, F.col("o_custkey") == geo.c_custkey)
            .join(part, li.l_partkey == part.p_partkey)
            .select(F.col("l_partkey").alias("title_id"), F.col("p_name").alias("show_title"), city.alias("city"),
                    F.col("p_brand").alias("venue_name"), (F.col("p_size") * 10).alias("capacity"),
                    F.col("l_shipdate").cast("date").alias("performance"), F.col("o_orderdate").cast("date").alias("sold"),
                    F.col("l_quantity").alias("tickets"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                    (F.substring("o_orderpriority", 1, 1) == "1").alias("is_subscription"),
                    (F.col("l_discount") == 0).alias("is_comp"), (F.col("l_returnflag") == "R").alias("is_refund"),
                    F.col("l_returnflag").alias("channel"), F.substring("o_orderpriority", 1, 1).alias("tier")))


@query("X06_ticketing_normalize")
def q_x06(spark, sf):
    return rounded(RO.ticketing_rollup(_ticket_lines(spark, sf), B.CITIES))


def _event_lines(spark, sf):
    """Order lines as events: from order to ship date, attendance = quantity, rank 0 to 100, four kinds."""
    li = B.read(spark, sf, "lineitem").select(                    # what the events need of a line: little of it to shuffle
        "l_orderkey", F.col("l_partkey").alias("title"), F.col("l_shipdate").cast("date").alias("end"),
        F.col("l_quantity").alias("attendance"), F.floor(F.col("l_extendedprice") % 101).cast("int").alias("rank"))
    o = B.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"), "o_orderpriority")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "sports").when(F.col("o_orderpriority").startswith("2"), "concerts").when(
        F.col("o_orderkey") % 7 == 0, "holidays").when(F.col("o_orderkey") % 11 == 0, "severe-weather")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("title", "start", "end", "attendance", "rank", kind.alias("kind"))


def _event_windows(spark, sf, keep=()):
    runs = _plan(spark, sf).runs.select("title", "run_no", "run_start", "run_end")
    return rounded(J.event_window_features(runs, _event_lines(spark, sf), "title", ["title", "run_no"], "run_start", "run_end", keep=keep))


@query("X07_event_window_features")
def q_x07(spark, sf):
    """Every run with the features of the order lines around it, runs without any included."""
    return _event_windows(spark, sf)


@query("X01_knn_impute")
def q_x01(spark, sf):
    """Titles without history: the five titles with the most similar signals, and their index, newer runs first."""
    p = _hidden_plan(spark, sf)
    today = F.broadcast(p.runs.agg(F.max("run_end").alias("_today")))                      # one row
    known = p.known.select("title", *PL.SIGNALS, "TicketIndex_DeSeason", "mid_date").crossJoin(today).withColumn(
        "years", F.datediff("_today", "mid_date") / 365.25)
    unknown = p.indexed.where(F.col("TicketIndex_DeSeason").isNull()).select("title", *PL.SIGNALS)
    return rounded(NB.knn_impute(unknown, known, PL.SIGNALS, "TicketIndex_DeSeason", years="years"))


@query("X08_batch_rescale")
def q_x08(spark, sf):
    b = _plan(spark, sf).baselines.select("title", "category", "wiki")
    ctrl = b.groupBy("category").agg(F.min("title").alias("_ct"))
    d = b.join(ctrl, "category").withColumn("is_control", F.col("title") == F.col("_ct"))
    out = SG.batch_rescale(d, "category", "wiki", "is_control", True, "wiki_rescaled")
    return rounded(out.select("title", "wiki_rescaled"))


@query("X08_rank_and_views")
def q_x08r(spark, sf):
    p = _plan(spark, sf)
    b = p.baselines.select("title", "category", "wiki", F.col("trends").alias("rank"))
    bench = F.broadcast(p.benchmark.select(F.col("wiki").alias("bench_wiki")))           # one row
    out = SG.inverted_rank(b, "rank", "category").crossJoin(bench)
    return rounded(out.select("title", "rank_index", SG.share_of_benchmark("wiki", "bench_wiki").alias("views_index")))


@query("X09_batch_history_dedupe")
def q_x09(spark, sf):
    part = B.read(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("name"), "p_size")
    return RO.batch_summary(part, "name", F.col("p_size") == 1)


@query("A10_registry_totals")
def q_a10t(spark, sf):
    return PR.registry_totals(q_a10(spark, sf))


@query("A18_first_row_per_title")
def q_a18f(spark, sf):
    h = B.history(spark, sf).select("title", "start_date", "city", "segment", "single_tickets")
    return rounded(RO.first_row_per_key(h, "title", ["start_date", "city", "segment"]))


@query("A18_sorted_unique_titles")
def q_a18u(spark, sf):
    return RO.sorted_unique(B.read(spark, sf, "part"), "p_name")


@query("J05_chained_enrich")
def q_j05c(spark, sf):
    """Every order line: weather of its city and day, then the title's spend; no row is added."""
    h = B.history(spark, sf).select("title", "city", "start_date", "single_tickets")
    # all five event types are weather: two of them in America, three in Europe
    west = F.col("city").isin("view", "click")
    w = B.daily_weather(spark, sf).groupBy(F.when(west, F.lit("america")).otherwise(F.lit(" Europe ")).alias("city"), "date").agg(
        F.avg("snow").alias("snow"))
    checks = Observation(), Observation()
    out = J.chained_enrich(h, w, _spend(spark, sf), {"date_col": "start_date", "measures": ("snow",)}, checks)
    return rounded(out.groupBy("title", "city").agg(
        F.count(F.lit(1)).alias("rows"), F.count("weather_snow").alias("with_weather"), F.sum("weather_snow").alias("snow"),
        F.max("marketing_spend").alias("spend")))


@query("J03_weather_no_city")
def q_j03n(spark, sf):
    out = J.join_weather(_events_with_city(spark, sf), B.daily_weather(spark, sf).drop("city"), "date", None, None, ("snow",))
    return rounded(out.select("event_id", "weather_snow"))


@query("J04_marketing_by_date")
def q_j04d(spark, sf):
    daily = B.read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date_key")).agg(
        F.sum("o_totalprice").alias("marketing_spend"))
    h = B.history(spark, sf).select("title", F.col("start_date").alias("date_key"), "single_tickets")
    out = J.join_marketing(h, daily)
    return rounded(out.groupBy("date_key").agg(F.count(F.lit(1)).alias("rows"), F.max("marketing_spend").alias("spend")))


@query("F09_fit_metrics_by_category")
def q_f09c(spark, sf):
    p = _plan(spark, sf)
    return rounded(M.fit_metrics(p.known, p.category_models, group="category"))


# ---------------------------------------------------------------- sources as files: written by S19, read back
def _as_file(spark, df, tag, compression=None):
    """A table as CSV files in a fresh folder that all machines share."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    IO.write_table(df, path, compression=compression)
    return path


def _as_texts(df, fields, absent=(), extra=(), **cols):
    """``df`` as a source file of these fields: text, columns in reverse order, ``absent`` ones left out,
    unknown ones empty, and ``extra`` columns that no field names between them."""
    named = [cols.get(IO.normalize_name(f.name), F.lit(None)).cast("string").alias(f.name) for f in reversed(fields) if f.name not in absent]
    return df.select(named[0], *[F.lit("extra").alias(c) for c in extra], *named[1:])


@query("S06_external_factors")
def q_s06(spark, sf):
    f = _as_texts(_ext_factors(spark, sf), IO.EXTERNAL_FACTORS, absent=("alberta_real_gdp_growth_rate",), extra=("Source - Page",),
                  year=F.col("year"), city=F.col("city"), population_city=F.col("n_orders"), median_household_income_city=F.col("avg_order_value"))
    d = IO.read_source(spark, _as_file(spark, f, "s06"), IO.EXTERNAL_FACTORS)
    return rounded(d.select(F.col("year").cast("int").alias("year"), "city", "population_city", "median_household_income_city",
                            "alberta_real_gdp_growth_rate", "source_page"))


@query("S07_dated_series")
def q_s07(spark, sf):
    ev = B.read(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(F.avg("value").alias("v"))
    oil = _as_texts(ev.where("event_type = 'view'"), IO.OIL_PRICES, date=F.col("date"), wcs_oil_price=F.col("v"), oil_series=F.col("event_type"))
    un = _as_texts(ev.where("event_type <> 'view'"), IO.UNEMPLOYMENT, extra=("note",), date=F.date_format("date", "yyyy-MM-dd"),
                   unemployment_rate=F.col("v"), region=F.col("event_type"))
    a = IO.read_source(spark, _as_file(spark, oil, "s07a"), IO.OIL_PRICES)
    b = IO.read_source(spark, _as_file(spark, un, "s07b"), IO.UNEMPLOYMENT)
    return rounded(a.select("date", F.col("oil_series").alias("series"), F.col("wcs_oil_price").alias("value")).unionByName(
        b.select("date", F.col("region").alias("series"), F.col("unemployment_rate").alias("value"))))


@query("S10_event_features")
def q_s10(spark, sf):
    """The features of the runs (X07), written under the names of the event file and read back: 13 columns."""
    x = _event_windows(spark, sf, keep=("run_start", "run_end"))
    phq = {"attendance_sum": "attendance_sum", "attendance_sports": "attendance_sports", "attendance_concerts": "attendance_concerts",
           "event_count": "event_count", "rank_max": "rank_max", "rank_avg": "rank_avg", "holidays_flag": "holidays_flag",
           "severe_weather_flag": "severe_weather_flag"}
    f = _as_texts(x, IO.EVENT_FEATURES, absent=("phq_demand_impact_score",), show_title=F.col("title"), city=F.lit("all"),
                  phq_start_date=F.col("run_start"), phq_end_date=F.when(F.col("run_no") > 0, F.col("run_end").cast("string")).otherwise("not a date"),
                  **{f"phq_{a}": F.col(b) for a, b in phq.items()})
    d = IO.read_source(spark, _as_file(spark, f, "s10", "gzip"), IO.EVENT_FEATURES)      # as many rows as there are runs
    return rounded(d)


@query("S11_survey")
def q_s11(spark, sf):
    c = B.read(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    f = _as_texts(c, IO.SURVEY, category=F.col("c_mktsegment"), subcategory=F.lit("all"), metric=F.lit("balance"),
                  year_or_period=F.when(F.col("c_nationkey") % 5 == 0, F.lit("Q1")).otherwise((F.col("c_nationkey") + 2000).cast("string")),
                  value=F.col("v"), unit=F.lit("dollars, all")).withColumnRenamed("year_or_period", "Period")
    d = IO.read_source(spark, _as_file(spark, f, "s11"), IO.SURVEY)
    return rounded(d.withColumn("value", P.parse_number("value", blank_as_zero=False)))


@query("S13_index_series")
def q_s13(spark, sf):
    o = B.read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(
        F.sum("o_totalprice").alias("a"), F.count(F.lit(1)).alias("n"))
    f = _as_texts(o, IO.COMMODITY_INDEX, absent=("A.FISH",), **{"date": F.col("d"), "a.bcpi": F.col("a"), "a.ener": F.col("n")})
    d = IO.read_source(spark, _as_file(spark, f, "s13"), IO.COMMODITY_INDEX)
    return rounded(d.select("date", F.col("`a.bcpi`").alias("bcpi"), F.col("`a.ener`").alias("ener"), F.col("`a.fish`").alias("fish")))


@query("S16_marketing_spend_file")
def q_s16f(spark, sf):
    """Spend of each title under the headers of the spend file; the date is the first city's that has one."""
    s = _spend(spark, sf).withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("title") % 300).cast("int")))
    f = _as_texts(s, IO.MARKETING_SPEND, show_title=F.col("title"), calgary_show_date=F.when(F.col("title") % 2 == 0, F.col("d")),
                  edmonton_show_date=F.date_add("d", 1), marketing_spend_calgary=F.col("marketing_spend"))
    d = IO.first_date_column(IO.read_source(spark, _as_file(spark, f, "s16"), IO.MARKETING_SPEND),
                             ["start_date", "calgary_show_date", "edmonton_show_date"])
    return rounded(d.select("show_title", "date_key", "marketing_spend_calgary", "marketing_spend_edmonton"))


@query("S14_census")
def q_s14(spark, sf):
    g = B.customer_geo(spark, sf).groupBy("region", "segment").agg(F.count(F.lit(1)).alias("Customers - All"))
    path = _as_file(spark, g, "s14")
    d = IO.normalize_columns(IO.read_csv(spark, path))          # free-form columns: no schema given
    return d.select("region", "segment", P.parse_number("customers_all").cast("bigint").alias("customers_all"))


@query("S17_csv_quirks")
def q_s17(spark, sf):
    p = B.read(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("\ufeffid"), F.concat(F.lit('"'), "p_name", F.lit('", in short, é')).alias("name"), "p_type")
    d = IO.read_csv(spark, _as_file(spark, p, "s17"))
    return d.select(F.col("id").cast("bigint").alias("id"), "name", F.col("p_type").alias("type"))


@query("S19_markdown_rows")
def q_s19(spark, sf):
    return IO.to_markdown_rows(B.read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"))


def _as_report(spark, df, tag, order_by):
    """A table as a markdown report in a fresh shared folder, read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    IO.write_markdown(df, path, order_by)
    return IO.read_markdown(spark, path, df.schema)


@query("S19_board_report")
def q_s19b(spark, sf):
    return _as_report(spark, QUERIES["R02_board_summary"](spark, sf), "board", ["month_rank", "title"])


@query("S19_financial_report")
def q_s19f(spark, sf):
    return _as_report(spark, QUERIES["R03_financial_summary"](spark, sf), "financial", ["title", "metric"])


@query("S19_registry_report")
def q_s19r(spark, sf):
    return _as_report(spark, q_a10(spark, sf), "registry", ["source"]).fillna("", ["details"])     # an empty cell reads as NULL


@query("S19_wide_plan_csv")
def q_s19w(spark, sf):
    """R04 as CSV: every metric of every plan row, written and read back by its header."""
    d = QUERIES["R04_wide_plan"](spark, sf)
    back = IO.read_source(spark, _as_file(spark, d.select(*reversed(d.columns)), "wide"), [
        IO.Field(f.name, "number" if f.dataType.simpleString() == "double" else "text") for f in d.schema.fields])
    return back.select(*[F.col(IO.normalize_name(f.name)).cast(f.dataType).alias(f.name) for f in d.schema.fields])


@query("S20_missing_source")
def q_s20(spark, sf):
    """A source that is not there reads as an empty table of its schema; the others stay whole."""
    c = B.read(spark, sf, "customer").select(F.col("c_mktsegment").alias("city"))
    f = _as_texts(c, IO.UNEMPLOYMENT, region=F.col("city"))
    path = _as_file(spark, f, "s20")
    there = IO.read_source(spark, path, IO.UNEMPLOYMENT)
    gone = IO.read_source(spark, path + "-missing", IO.UNEMPLOYMENT)
    both = there.withColumn("found", F.lit(1)).unionByName(gone.withColumn("found", F.lit(0)))
    return both.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.min("found").alias("found"))


@query("S12_tidy_slice")
def q_s12(spark, sf):
    ev = B.read(spark, sf, "events").select(
        F.col("event_type").alias("category"), F.lit("value").alias("metric"),
        F.when(F.col("event_type") == "purchase", F.dayofmonth("ts").cast("string"))
        .otherwise(F.concat(F.lit("d"), F.dayofmonth("ts").cast("string"))).alias("year_or_period"),
        F.col("value").cast("string").alias("value"))
    return rounded(IO.tidy_slice(ev, {"category": "purchase", "metric": "value"}).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")))


@query("S16_first_date_column")
def q_s16(spark, sf):
    o = B.read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("calgary_show_date"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 1), "yyyy-MM-dd").alias("edmonton_show_date"))
    return IO.first_date_column(o, ["start_date", "calgary_show_date", "edmonton_show_date"]).select("o_orderkey", "date_key")


@query("E11_narrative")
def q_e11(spark, sf):
    plan = _season_plan(spark, sf)
    _, a = _attr(spark, sf)
    p = _plan(spark, sf)
    last = p.runs.groupBy("title").agg(F.max("run_end").alias("last_end"))
    d = (plan.join(a.select("title", EX.driver_sentence(F.col("contributions")).alias("drivers")), "title", "left")
         .join(_intent(spark, sf), "title", "left").join(last, "title", "left")
         .withColumn("years_since", F.datediff("run_date", "last_end") / 365.25))
    city = F.array(*[F.struct(F.lit(c).alias("city"), F.col(f"Singles_{c}").alias("tickets")) for c in p.cities])
    return d.select("title", "Month", EX.narrative(
        F.col("title").cast("string"), F.col("Month"), F.col("category"), F.col("Familiarity"), F.col("Motivation"),
        F.col("SignalOnly"), F.col("TicketIndex_used"), F.col("FutureSeasonalityFactor"),
        F.col("PredictedPrimarySegment"), F.col("PredictedSecondarySegment"), city,
        F.col("IntentRatio"), F.col("years_since"), F.col("drivers")).alias("narrative"))
