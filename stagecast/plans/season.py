"""Season plan and summary tables.

A plan is a (month, title) assignment table joined to the scored titles; all
outputs are per-row expressions, grouped sums or bounded pivots (month lists
are configuration).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecast import config as C
from stagecast.functions import columns as P
from stagecast.functions.quantiles import bucket_of, exact_median
from stagecast.operators import robust as RB
from stagecast.session import cut

# FIXED VALUES — plan months (slot name, month number) and summary month orders
PLAN_MONTHS = [("September", 9), ("October", 10), ("January", 1), ("February", 2), ("March", 3), ("May", 5)]
BOARD_MONTH_ORDER = ["September", "October", "November", "December", "January", "February", "March", "April",
                     "May", "June"]
FINANCIAL_MONTH_ORDER = ["September", "October", "January", "February", "March", "May"]


def implied_benchmark(scored: DataFrame) -> DataFrame:
    """A13 — 1 row: median of EstimatedTickets / (Used x FutureFactor) x 100 over rows with a
    positive effective index and known tickets."""
    eff = F.col("TicketIndex_DeSeason_Used") * F.col("FutureSeasonalityFactor")
    d = scored.where((eff > 0) & F.col("EstimatedTickets").isNotNull())
    return exact_median(d, F.col("EstimatedTickets") / eff * 100.0, None, "bench_med_deseason_est").drop("n")


def month_rank(month_name_col, order: Sequence[str] = BOARD_MONTH_ORDER):
    """Position of a month name in the season order; unknown months last (99)."""
    m = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    return F.coalesce(F.element_at(m, month_name_col), F.lit(99))


def season_plan(assign: DataFrame, scored: DataFrame, seasonality: DataFrame, city_split: DataFrame,
                season_end_year: int, cities: Sequence[str], month_col: str = "month",
                postcovid: float = C.POSTCOVID_FACTOR) -> DataFrame:
    """R01 — plan rows for (month, title) assignments.

    Run year = season start year for months 9/10/12, else the end year; run day 15;
    the category factor of the run month is always applied; index = Used, else
    SignalOnly; tickets = half-even round(eff / 100 x implied benchmark (A13));
    final = round(tickets x factor); city split title -> category -> default,
    normalised; Month label uses the season *end* year.
    ``city_split`` has one row per title with a map ``city_split``.
    """
    start_year = season_end_year - 1
    names = F.create_map(*[x for n, m in PLAN_MONTHS for x in (F.lit(m), F.lit(n))])
    run_year = (F.when(F.col("month_of_opening").isin(*C.PLAN_START_YEAR_MONTHS), F.lit(start_year))
                .otherwise(F.lit(start_year + 1)))
    bench = F.broadcast(implied_benchmark(scored))
    s = scored.select("title", "category", "SignalOnly", "Familiarity", "Motivation", "TicketIndex_DeSeason_Used",
                      "TicketIndexSource", "Composite", "PredictedPrimarySegment", "PredictedSecondarySegment")
    d = (assign.select(F.col(month_col).cast("int").alias("month_of_opening"), "title")
         .join(s, "title")
         .withColumn("run_date", F.make_date(run_year, F.col("month_of_opening"), F.lit(15))))
    d = RB.attach_factor(d, seasonality, "category", "run_date", "FutureSeasonalityFactor")
    idx = F.coalesce(F.nanvl(F.col("TicketIndex_DeSeason_Used"), F.lit(None)), F.col("SignalOnly"))
    d = (d.crossJoin(bench)
         .withColumn("TicketIndex_used", idx * F.col("FutureSeasonalityFactor"))
         .withColumn("EstimatedTickets", F.bround(F.col("TicketIndex_used") / 100.0 * F.col("bench_med_deseason_est"), 0))
         .withColumn("EstimatedTickets_Final",
                     F.bround(F.coalesce(F.col("EstimatedTickets"), F.lit(0.0)) * C.REMOUNT_FACTOR * postcovid, 0)))
    d = d.join(city_split.select("title", "city_split"), "title", "left")
    vals = [F.coalesce(F.element_at(F.col("city_split"), F.lit(c)), F.lit(0.0)) for c in cities]
    tot = vals[0]
    for v in vals[1:]:
        tot = tot + v
    tot = F.when(tot == 0, F.lit(1.0)).otherwise(tot)
    extra = []
    for c, v in zip(cities, vals):
        extra += [(v / tot).alias(f"CityShare_{c}"),
                  F.bround(F.col("EstimatedTickets_Final") * (v / tot), 0).alias(f"Singles_{c}")]
    return d.select(
        F.concat_ws(" ", F.element_at(names, F.col("month_of_opening")), F.lit(str(season_end_year))).alias("Month"),
        "month_of_opening", "title", "category", "run_date", "PredictedPrimarySegment", "PredictedSecondarySegment",
        "Familiarity", "Motivation", "SignalOnly", "TicketIndex_DeSeason_Used", "TicketIndex_used", "TicketIndexSource",
        "FutureSeasonalityFactor", "Composite", P.letter_score(F.col("Composite")).alias("Score"),
        "EstimatedTickets", "EstimatedTickets_Final",
        P.holiday_flag(F.col("month_of_opening")).alias("holiday_flag"), *extra)


def board_summary(plan: DataFrame, cities: Sequence[str]) -> DataFrame:
    """R02 — month, title, category, tickets (Final -> Estimated -> sum of city singles),
    city singles, segment tilt, index stars; rank column for the Sep..Jun order (unknown last)."""
    mname = F.split(F.col("Month"), " ")[0]
    city_sum = sum((F.coalesce(F.col(f"Singles_{c}"), F.lit(0.0)) for c in cities), F.lit(0.0))
    tickets = F.coalesce(F.col("EstimatedTickets_Final"), F.col("EstimatedTickets"), city_sum)
    return plan.select(
        mname.alias("month_name"), month_rank(mname).alias("month_rank"), "title", "category",
        tickets.cast("bigint").alias("estimated_tickets"),
        *[F.coalesce(F.col(f"Singles_{c}"), F.lit(0.0)).cast("bigint").alias(f"singles_{c}") for c in cities],
        P.first_nonblank(F.col("PredictedPrimarySegment")).alias("segment_tilt"),
        P.star_rating(F.col("TicketIndex_used")).alias("index_strength"))


def metrics_by_month(plan: DataFrame, metrics: Sequence[str], months: Sequence[str] = FINANCIAL_MONTH_ORDER,
                     key: str = "title") -> DataFrame:
    """R03/R04 — metrics as rows, plan months as columns: unpivot to (key, metric, month, value)
    then pivot on the bounded month list (values as strings). A title has one row per month: two
    different values for one cell raise."""
    mname = F.split(F.col("Month"), " ")[0]
    d = plan.withColumn("_m", F.upper(mname)).where(mname.isin(*months))
    long = d.select(key, "_m", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("string").alias("value")) for m in metrics])).alias("e"))
    return (long.select(key, "_m", "e.metric", "e.value")
            .groupBy(key, "metric").pivot("_m", [m.upper() for m in months]).agg(
                F.when(F.min("value").eqNullSafe(F.max("value")), F.max("value")).otherwise(
                    F.raise_error(F.lit("two rows of one title and month")).cast("string"))))


# FIXED VALUES — metrics of the full plan export, in order (numbers, then texts)
WIDE_NUMBERS = ("wiki", "trends", "youtube", "chartmetric", "Familiarity", "Motivation", "SignalOnly", "TicketMedian",
                "TicketIndex_DeSeason_Used", "TicketIndex_used", "FutureSeasonalityFactor", "HistSeasonalityFactor",
                "Composite", "EstimatedTickets", "EstimatedTickets_Final", "ticket_median_prior", "prior_total_tickets",
                "run_count_prior", "TicketIndex_Predicted", "month_of_opening", "category_seasonality_factor")
WIDE_TEXTS = ("title", "category", "PredictedPrimarySegment", "PredictedSecondarySegment", "TicketIndexSource", "Score",
              "gender", "dominant_audience_segment", "segment_weights", "holiday_flag")


def wide_metrics(plan: DataFrame, scored: DataFrame, cities: Sequence[str]) -> DataFrame:
    """R04 — every metric of every plan row as ``(title, Month, metric, number, text)``: numbers stay
    numbers, texts texts. The neighbour-imputation fields are absent, as nothing computes them."""
    numbers = [*WIDE_NUMBERS, *[f"Singles_{c}" for c in cities], *[f"CityShare_{c}" for c in cities]]
    more = [c for c in [*numbers, *WIDE_TEXTS] if c not in plan.columns]
    d = plan.join(scored.select("title", *more), "title")
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("number"), F.lit(None).cast("string").alias("text"))
             for m in numbers]
    cells += [F.struct(F.lit(m).alias("metric"), F.lit(None).cast("double").alias("number"), F.col(m).cast("string").alias("text"))
              for m in WIDE_TEXTS]
    return d.select("title", "Month", F.explode(F.array(*cells)).alias("e")).select("title", "Month", "e.*")


def _below(counts: DataFrame, by: str, coarse: int = 128) -> DataFrame:
    """Adds ``_before``: the sum of ``_c`` over all rows with a lesser ``by``, without a window over all rows.

    Rows are summed in stretches of ``coarse`` numbers; each stretch adds up its own rows, and the sums of
    the stretches before it come from a join of the few stretches with themselves.
    """
    d = counts.withColumn("_s", F.floor(F.col(by) / coarse))
    sums = d.groupBy("_s").agg(F.sum("_c").alias("_t"))
    other = sums.select(F.col("_s").alias("_o"), F.col("_t").alias("_u"))
    ahead = sums.join(other, F.col("_o") < F.col("_s"), "left").groupBy("_s").agg(F.coalesce(F.sum("_u"), F.lit(0)).alias("_ahead"))
    own = F.sum("_c").over(Window.partitionBy("_s").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    return d.withColumn("_own", own).join(ahead, "_s").withColumn("_before", F.col("_own") + F.col("_ahead")).drop("_s", "_own", "_ahead")


def global_rank(df: DataFrame, first: str, second: str, out: str = "rank") -> DataFrame:
    """``df`` plus SQL's ``rank()`` by two numeric columns, both descending, NULLs last, over the whole table.

    The table is cut into ranges of the first column (``bucket_of``, whose numbers never decrease with it, so
    equal values share a range); distinct pairs of values are counted, ranges get the count of all rows in
    higher ranges, and a window runs over the distinct pairs of one range. Ties, however many, are one pair.
    """
    place = F.when(F.col(first).isNull() | F.isnan(F.col(first).cast("double")), F.lit((1 << 40))).otherwise(-bucket_of(F.col(first).cast("double")))
    pairs = df.groupBy(F.col(first).alias("_x"), F.col(second).alias("_y"), place.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    ranges = _below(pairs.groupBy("_b").agg(F.sum("_c").alias("_c")), "_b").select("_b", "_before")
    order = Window.partitionBy("_b").orderBy(F.desc_nulls_last("_x"), F.desc_nulls_last("_y")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = pairs.withColumn("_upto", F.sum("_c").over(order)).join(ranges, "_b").select(
        "_x", "_y", (F.col("_before") + F.col("_upto") - F.col("_c") + 1).alias(out))
    return df.join(ranked, F.col(first).eqNullSafe(F.col("_x")) & F.col(second).eqNullSafe(F.col("_y"))).drop("_x", "_y")


def rank_plan(plan: DataFrame) -> DataFrame:
    """R05 — plan rows with their ``rank`` by Composite desc, then final tickets desc (equal rows share a rank),
    in that order (a distributed range sort)."""
    cols = ["Month", "title", "category", "PredictedPrimarySegment", "PredictedSecondarySegment", "Composite", "EstimatedTickets_Final"]
    kept = cut(plan.select(*cols))              # read several times
    return global_rank(kept, "Composite", "EstimatedTickets_Final").select("rank", *cols).orderBy("rank", "title")


def plan_totals(plan: DataFrame, cities: Sequence[str]) -> DataFrame:
    """A14 — long (scope, tickets, share): season total, per-city sums and shares (zero total -> 1)."""
    aggs = [F.sum("EstimatedTickets_Final").alias("_g")] + [F.sum(f"Singles_{c}").alias(f"_c{i}")
                                                         for i, c in enumerate(cities)]
    one = plan.agg(*aggs)
    g = F.coalesce(F.nullif(F.col("_g"), F.lit(0.0)), F.lit(1.0))
    rows = [F.struct(F.lit("season").alias("scope"), F.coalesce("_g", F.lit(0.0)).alias("tickets"),
                     F.lit(1.0).alias("share"))]
    rows += [F.struct(F.lit(c).alias("scope"), F.coalesce(F.col(f"_c{i}"), F.lit(0.0)).alias("tickets"),
                      (F.coalesce(F.col(f"_c{i}"), F.lit(0.0)) / g).alias("share"))
             for i, c in enumerate(cities)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def city_by_month(plan: DataFrame, cities: Sequence[str]) -> DataFrame:
    """A15 — city singles summed by plan month."""
    return plan.groupBy("Month").agg(*[F.sum(f"Singles_{c}").alias(f"singles_{c}") for c in cities])


def scatter_quadrants(plan: DataFrame, x: str = "Familiarity", y: str = "Motivation",
                      size_col: str = "EstimatedTickets_Final") -> DataFrame:
    """A16 — medians of x and y (1-row, broadcast), bubble size 3*sqrt(max(t, 0), 0 -> 1) and quadrant."""
    d = plan.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(size_col).isNotNull())
    axes = d.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("at")) for a in (x, y)])).alias("e")).select("e.*")
    both = exact_median(axes, "at", "axis")
    med = F.broadcast(both.agg(*[F.max(F.when(F.col("axis") == a, F.col("median"))).alias(m) for a, m in ((x, "_mx"), (y, "_my"))]))
    t = F.greatest(F.col(size_col).cast("double"), F.lit(0.0))
    size = F.sqrt(F.when(t == 0, F.lit(1.0)).otherwise(t)) * 3.0
    quad = F.concat(F.when(F.col(x) >= F.col("_mx"), F.lit("high_")).otherwise(F.lit("low_")), F.lit(x.lower()), F.lit("/"),
                    F.when(F.col(y) >= F.col("_my"), F.lit("high_")).otherwise(F.lit("low_")), F.lit(y.lower()))
    return d.crossJoin(med).select("Month", "title", x, y, size.alias("bubble_size"), quad.alias("quadrant"))
