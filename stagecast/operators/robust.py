"""Robust category statistics and the category x month seasonality table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast import config as C
from stagecast.functions.quantiles import exact_median, exact_percentiles


def iqr_filter(df: DataFrame, group: str, value: str, k: float = 1.5, weight: str | None = None) -> DataFrame:
    """A05 — keep rows with value inside [q1 - k*IQR, q3 + k*IQR] of their group (exact
    linear-interpolated quartiles); NULL values are dropped first. Groups are categories
    (a bounded domain), so the per-group fences are broadcast. With ``weight`` a row stands for so many values."""
    d = df.where(F.col(value).isNotNull())
    q = exact_percentiles(d, value, [0.25, 0.75], group, weight=weight).select(
        group, (F.col("p0") - k * (F.col("p1") - F.col("p0"))).alias("_lo"),
        (F.col("p1") + k * (F.col("p1") - F.col("p0"))).alias("_hi"))
    return (d.join(q, group).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
            .drop("_lo", "_hi"))


def trimmed_median(c) -> Column:
    """A06 — median after dropping one min and one max when n >= 4.

    Dropping one value from each end of a sorted sample never moves its median,
    so this is exactly the median. This Column form suits small groups; for hot
    groups use ``trimmed_median_by`` (two-pass exact quantile).
    """
    return F.median(c)


def trimmed_median_by(df: DataFrame, value: str, group, alias: str = "trimmed_median") -> DataFrame:
    """A06 per category via the exact two-pass median (columns: group, n, ``alias``)."""
    return exact_median(df, value, group, alias)


def seasonality_table(runs: DataFrame, category: str = "category", month: str = "month",
                      value: str = "ticket_median", k_shrink: float = C.K_SHRINK,
                      clip: tuple[float, float] = (C.SEASON_MIN_FACTOR, C.SEASON_MAX_FACTOR),
                      winter: tuple[int, ...] = C.WINTER_POOL, n_min: int | None = None) -> DataFrame:
    """A07 — one row per (category, month 1..12): n, month median, raw ratio, weight, factor.

    Per category after the IQR fence: overall median; month median when the
    month has runs (n >= n_min if given), else the pooled winter median for
    winter months, else the overall median; raw = month/overall;
    w = n/(n+K); factor = clip(1 + w*(raw-1)). Categories whose overall median
    is not positive emit nothing; month medians <= 0 are dropped.
    """
    spark = runs.sparkSession
    # every step below reads these counts (one exchange, used again), not the runs
    counts = runs.where(F.col(value).isNotNull()).groupBy(category, month, value).agg(F.count(F.lit(1)).alias("_c"))
    f = iqr_filter(counts, category, value, weight="_c")
    # all medians in one exact computation keyed by (category, level):
    # level 0 = whole category, -1 = winter pool, 1..12 = month
    lv = F.col("_lvl")
    own = F.col(month).cast("int")
    levels = f.select(category, value, "_c", F.explode(F.array_compact(F.array(
        F.lit(0), own, F.when(own.isin(*winter), F.lit(-1))))).alias("_lvl"))
    med = exact_median(levels, value, [category, "_lvl"], "_med", weight="_c")
    cat = med.groupBy(category).agg(F.max(F.when(lv == 0, F.col("_med"))).alias("cat_median"),
                                    F.max(F.when(lv == -1, F.col("_med"))).alias("winter_median"))
    cat = cat.where(F.col("cat_median") > 0)
    mon = med.where(lv > 0).select(category, lv.alias(month), F.col("n").alias("_n"), F.col("_med").alias("_m"))
    months = F.broadcast(spark.range(1, 13).select(F.col("id").cast("int").alias(month)))
    grid = cat.crossJoin(months).join(mon, [category, month], "left")
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    use_month = n >= (n_min if n_min else 1)
    m_med = (F.when(use_month, F.col("_m"))
             .when(F.col(month).isin(*winter) & F.col("winter_median").isNotNull(), F.col("winter_median"))
             .otherwise(F.col("cat_median")))
    raw = m_med / F.col("cat_median")
    w = n / (n + F.lit(float(k_shrink)))
    factor = F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), F.lit(1.0) + w * (raw - F.lit(1.0))))
    return (grid.select(category, month, n.alias("n"), m_med.alias("month_median"), "cat_median",
                        raw.alias("raw_ratio"), w.alias("weight"), factor.alias("factor"))
            .where(F.col("month_median") > 0))


def attach_factor(df: DataFrame, table: DataFrame, category: str, date_or_month: Column | str,
                  out: str, table_category: str = "category", table_month: str = "month",
                  is_month: bool = False) -> DataFrame:
    """J13 — (category, month of date) -> factor; no row or NULL date -> 1.0.

    The table has at most 12 rows per category; it joins on equality keys.
    """
    m = F.col(date_or_month) if isinstance(date_or_month, str) else date_or_month
    m = m.cast("int") if is_month else F.month(m)
    t = table.select(F.col(table_category).alias("_fc"), F.col(table_month).alias("_fm"),
                     F.col("factor").alias("_ff"))
    j = df.withColumn("_jm", m).join(t, (F.col(category) == F.col("_fc")) & (F.col("_jm") == F.col("_fm")), "left")
    return j.withColumn(out, F.coalesce(F.col("_ff"), F.lit(1.0))).drop("_fc", "_fm", "_ff", "_jm")
