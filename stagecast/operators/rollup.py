"""Per-show rollups and small table forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecast.session import cut


# A18 -------------------------------------------------------------------------
def first_row_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A18 — the first row of each key by ``order`` (one aggregation, no window)."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(key, "_r.*")


def sorted_unique(df: DataFrame, col: str) -> DataFrame:
    """A18 — distinct non-blank values in order (a distributed sort)."""
    v = F.trim(F.col(col).cast("string"))
    return df.select(v.alias(col)).where(F.length(col) > 0).distinct().orderBy(col)


# X09 -------------------------------------------------------------------------
def batch_summary(df: DataFrame, title: str, failed: Column) -> DataFrame:
    """X09 — one row over a batch of titles: rows, unique titles, duplicates skipped, and how many unique
    titles succeeded and failed (a title fails if any of its rows does)."""
    per = df.select(F.trim(F.col(title)).alias("_t"), failed.alias("_f")).groupBy("_t").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.coalesce("_f", F.lit(False)).cast("int")).alias("_bad"))
    n, rows = F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))
    bad = F.coalesce(F.sum("_bad"), F.lit(0)).cast("bigint")
    return per.agg(rows.alias("n_input"), n.alias("n_unique"), (rows - n).alias("n_duplicates_skipped"),
                   (n - bad).alias("n_succeeded"), bad.alias("n_failed"))


# X06 -------------------------------------------------------------------------
def _four_places(share: Column) -> Column:
    """A share as text with four places, halves up."""
    n = F.floor(share * 10000 + 0.5).cast("bigint")
    return F.concat(F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))


def _shares(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """``key:value`` shares of a key's tickets by ``col``, in order of ``col``, as one string."""
    per = df.groupBy(key, F.col(col).cast("string").alias("_v")).agg(F.sum("tickets").alias("_t"))
    pairs = F.array_sort(F.collect_list(F.struct("_v", "_t")))
    total = F.sum("_t")
    return per.groupBy(key).agg(pairs.alias("_p"), total.alias("_all")).select(key, F.array_join(F.transform(
        "_p", lambda p: F.concat(p["_v"], F.lit(":"), _four_places(p["_t"].cast("double") / F.col("_all")))), ";").alias(out))


def ticketing_rollup(sales: DataFrame, cities: Sequence[str], late_days: int = 7, group_size: int = 30) -> DataFrame:
    """X06 — one row per show with the 28 columns of the normalised ticketing table.

    ``sales``: title_id, show_title, city, venue_name, capacity, performance (date), sold (date), tickets,
    price, is_subscription, is_comp, is_refund (booleans), channel, tier. A column of NULL input is NULL.
    Primary city: most tickets, then name. Week of 80 %: weeks from the first sale to the day on which 80 %
    of the tickets are sold; the window behind it holds one row per (show, day). The lines are read six times,
    so they are cut first: the joins behind them run once. Performance days are counted from a table of their
    own, so that the sums of a show are not carried for each of its days.
    """
    sales = cut(sales)
    k, t, n = "title_id", F.col("tickets"), F.count(F.lit(1))
    sub = F.coalesce("is_subscription", F.lit(False))
    total = F.sum(t)

    def share(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, t)), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    by_city = sales.groupBy(k, "city").agg(total.alias("_t"), F.countDistinct("performance").alias("_perf"))
    primary = by_city.groupBy(k).agg(F.max(F.struct("_t", F.col("city").alias("c"), "_perf")).alias("_p")).select(
        k, F.col("_p.c").alias("city"), F.col("_p._perf").alias("performance_count_city"))
    weekend = F.dayofweek("performance").isin(1, 7)
    opening = F.min("performance")
    start_year = F.year(F.add_months(opening, -7))           # a season runs from August to July
    days = sales.select(k, "performance").distinct().groupBy(k).agg(F.count("performance").alias("performance_count_total"))
    one = sales.groupBy(k).agg(
        F.min("show_title").alias("show_title"),
        F.concat(start_year, F.lit("-"), F.lpad((start_year + 1) % 100, 2, "0")).alias("production_season"),
        F.min("venue_name").alias("venue_name"), F.max("capacity").alias("venue_capacity"),
        *[F.coalesce(F.sum(F.when((F.col("city") == c) & ~sub, t)), F.lit(0.0)).alias(f"single_tickets_{c.lower()}") for c in cities],
        *[F.coalesce(F.sum(F.when((F.col("city") == c) & sub, t)), F.lit(0.0)).alias(f"subscription_tickets_{c.lower()}") for c in cities],
        F.coalesce(F.sum(F.when(~sub, t)), F.lit(0.0)).alias("total_single_tickets"),
        F.coalesce(F.sum(F.when(sub, t)), F.lit(0.0)).alias("total_subscription_tickets"),
        total.alias("total_tickets_all"),
        share(F.datediff("performance", "sold") <= late_days).alias("late_sales_share"),
        share(t >= group_size).alias("group_sales_share"), share(F.col("is_comp")).alias("comp_ticket_share"),
        (F.count_if("is_refund") / n).alias("refund_cancellation_rate"),
        (F.sum(F.col("price") * t) / F.nullif(total, F.lit(0.0))).alias("average_base_ticket_price"),
        opening.alias("opening_date"), F.max("performance").alias("closing_date"),
        F.concat(F.lit("weekday:"), _four_places(share(~weekend)), F.lit(";weekend:"),
                 _four_places(share(weekend))).alias("weekday_vs_weekend_mix"))
    played = F.col("performance_count_total")
    one = one.join(days, k).withColumn("avg_tickets_per_performance", F.col("total_tickets_all") / played).withColumn(
        "load_factor", F.col("total_tickets_all") / (F.col("venue_capacity") * played))
    daily = sales.groupBy(k, "sold").agg(total.alias("_t"))
    upto = Window.partitionBy(k).orderBy("sold")
    daily = daily.select(k, "sold", F.sum("_t").over(upto).alias("_upto"), F.sum("_t").over(Window.partitionBy(k)).alias("_all"))
    weeks = daily.groupBy(k).agg((F.datediff(F.min(F.when(F.col("_upto") >= 0.8 * F.col("_all"), F.col("sold"))),
                                             F.min("sold")) / 7.0).alias("weeks_to_80pct_sold"))
    out = (one.join(primary, k).join(weeks, k).join(_shares(sales, k, "channel", "channel_mix_distribution"), k)
           .join(_shares(sales, k, "tier", "pricing_tier_structure"), k))
    return out.select(
        "show_title", F.col(k).alias("show_title_id"), "production_season", "city", "venue_name", "venue_capacity",
        "performance_count_city", "performance_count_total", *[f"single_tickets_{c.lower()}" for c in cities],
        *[f"subscription_tickets_{c.lower()}" for c in cities], "total_single_tickets", "total_subscription_tickets",
        "total_tickets_all", "avg_tickets_per_performance", "load_factor", "weeks_to_80pct_sold", "late_sales_share",
        "channel_mix_distribution", "group_sales_share", "comp_ticket_share", "refund_cancellation_rate",
        "pricing_tier_structure", "average_base_ticket_price", "opening_date", "closing_date", "weekday_vs_weekend_mix")
