"""Signal indices (P07–P12, X08): column functions and small grouped operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast import config as C
from stagecast.functions.quantiles import exact_percentiles

SIGNALS = ("wiki", "trends", "youtube", "chartmetric")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# P07 -------------------------------------------------------------------------
def wiki_index(daily_views) -> Column:
    """40 + min(110, 20*ln(1+max(0, v)))."""
    v = F.greatest(F.lit(0.0), _c(daily_views).cast("double"))
    return F.lit(40.0) + F.least(F.lit(110.0), F.lit(20.0) * F.log1p(v))


def video_index(median_views) -> Column:
    """50 + min(90, 9*ln(1+median views)); no views (NULL) -> 0."""
    v = _c(median_views).cast("double")
    return F.when(v.isNull(), F.lit(0.0)).otherwise(F.lit(50.0) + F.least(F.lit(90.0), F.lit(9.0) * F.log1p(v)))


# P08 -------------------------------------------------------------------------
def signal_stats(df: DataFrame, key: str, value: str, days: float = 365.0) -> DataFrame:
    """Per key: median, exact 80th percentile and mean daily value (sum / days).
    Quantiles use the two-pass exact method, so a hot key is not merged in one task."""
    q = exact_percentiles(df, value, [0.5, 0.8], key).select(
        key, F.col("p0").alias("median_value"), F.col("p1").alias("p80_value"))
    s = df.groupBy(key).agg((F.sum(value) / F.lit(days)).alias("mean_daily"))
    return q.join(s, key)


# P10 -------------------------------------------------------------------------
def winsorize_by_group(values: DataFrame, reference: DataFrame, group: str, value: str,
                       ref_value: str | None = None, lo: float = 0.03, hi: float = 0.97) -> DataFrame:
    """Clip ``value`` to the [lo, hi] exact percentiles of the group's reference values,
    else of all reference values, else leave unchanged. NULL and NaN stay as they are.

    Group bounds are one aggregation over the reference (bounded by the number
    of groups); the global bounds are a 1-row aggregate, broadcast.
    """
    rv = ref_value or value
    ref = reference.where(F.col(rv).isNotNull())
    by_group = exact_percentiles(ref, rv, [lo, hi], group).select(
        F.col(group).alias("_g"), F.col("p0").alias("_glo"), F.col("p1").alias("_ghi"))
    overall = F.broadcast(exact_percentiles(ref, rv, [lo, hi]).select(F.col("p0").alias("_alo"), F.col("p1").alias("_ahi")))
    j = (values.join(by_group, values[group].eqNullSafe(by_group["_g"]), "left").drop("_g")
         .crossJoin(overall))
    lo_c = F.coalesce("_glo", "_alo")
    hi_c = F.coalesce("_ghi", "_ahi")
    clipped = F.when(lo_c.isNull() | F.col(value).isNull() | F.isnan(F.col(value)), F.col(value)).otherwise(F.least(hi_c, F.greatest(lo_c, F.col(value))))
    return j.withColumn(value, clipped).drop("_glo", "_ghi", "_alo", "_ahi")


# P11 -------------------------------------------------------------------------
def estimate_unknown(unknown: DataFrame, baselines: DataFrame, category_col: str = "category",
                     bumps: dict | None = None, fallback: dict | None = None,
                     clip: dict | None = None) -> DataFrame:
    """Signals for titles without a baseline: baseline medians (fallback constants when
    there are no baselines) + category bump, clipped per signal."""
    bumps = C.UNKNOWN_CATEGORY_BUMPS if bumps is None else bumps
    fallback = C.UNKNOWN_FALLBACK_MEDIANS if fallback is None else fallback
    clip = C.UNKNOWN_CLIP if clip is None else clip
    spark = unknown.sparkSession
    # global medians of the four signals: one unpivoted two-pass exact quantile, folded to 1 row
    long = baselines.select(F.explode(F.array(*[F.struct(F.lit(s).alias("_s"), F.col(s).cast("double").alias("_x"))
                                                 for s in SIGNALS])).alias("e")).select("e._s", "e._x")
    mq = exact_percentiles(long, "_x", [0.5], "_s")   # 4 groups
    med = F.broadcast(mq.agg(*[F.max(F.when(F.col("_s") == s, F.col("p0"))).alias(f"_m_{s}") for s in SIGNALS])
                      .crossJoin(baselines.agg(F.count(F.lit(1)).alias("_nb"))))
    rows = [(cat, *(float(b.get(s, 0.0)) for s in SIGNALS)) for cat, b in bumps.items()]
    bump_df = F.broadcast(spark.createDataFrame(
        rows, "_bcat string, " + ", ".join(f"_b_{s} double" for s in SIGNALS)))
    j = unknown.crossJoin(med).join(bump_df, F.col(category_col) == F.col("_bcat"), "left")
    out = j
    for s in SIGNALS:
        base = F.when(F.col("_nb") > 0, F.col(f"_m_{s}")).otherwise(F.lit(fallback[s]))
        v = base + F.coalesce(F.col(f"_b_{s}"), F.lit(0.0))
        lo, hi = clip[s]
        out = out.withColumn(s, F.least(F.lit(hi), F.greatest(F.lit(lo), v)))
    return out.drop(*[f"_m_{s}" for s in SIGNALS], *[f"_b_{s}" for s in SIGNALS], "_nb", "_bcat")


# P12 -------------------------------------------------------------------------
def length_trends(title) -> Column:
    return F.lit(60.0) + F.pmod(F.length(_c(title)), F.lit(40)).cast("double")


def length_video(title) -> Column:
    v = F.lit(55.0) + F.pmod(F.length(_c(title)) * F.lit(1.2), F.lit(45.0))
    return F.least(F.lit(140.0), F.greatest(F.lit(45.0), v))


def length_streaming(title) -> Column:
    return F.lit(50.0) + F.pmod(F.length(_c(title)) * F.lit(1.7), F.lit(40.0))


# X08 -------------------------------------------------------------------------
def batch_rescale(df: DataFrame, batch: str, value: str, control_key: str, control_value,
                  out: str = "rescaled") -> DataFrame:
    """Bridge calibration: value / value of the batch's control row * 100
    (NULL when the batch has no control row or it is 0)."""
    ctrl = (df.where(F.col(control_key) == F.lit(control_value))
            .groupBy(batch).agg(F.max(value).alias("_ctrl")))   # deterministic if a batch has several controls
    return (df.join(ctrl, batch, "left")
            .withColumn(out, F.try_divide(F.col(value) * 100.0, F.nullif(F.col("_ctrl"), F.lit(0.0))))
            .drop("_ctrl"))


def share_of_benchmark(value, benchmark) -> Column:
    """Views as a percentage of the benchmark's (NULL without a benchmark or with 0)."""
    return F.try_divide(_c(value).cast("double") * 100.0, F.nullif(_c(benchmark).cast("double"), F.lit(0.0)))


def inverted_rank(df: DataFrame, rank_col: str, partition: str | None = None,
                  out: str = "rank_index") -> DataFrame:
    """100 * (1 - rank / max rank) within the partition (max joined back, no global window)."""
    if partition:
        mx = df.groupBy(partition).agg(F.max(rank_col).alias("_mx"))
        j = df.join(mx, partition, "left")
    else:
        j = df.crossJoin(F.broadcast(df.agg(F.max(rank_col).alias("_mx"))))
    return j.withColumn(out, F.lit(100.0) * (F.lit(1.0) - F.try_divide(F.col(rank_col), F.col("_mx")))).drop("_mx")
