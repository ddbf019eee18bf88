"""Closed-form linear models as aggregations.

A one-feature ridge with unpenalised intercept is slope = Sxy / (Sxx + alpha),
intercept = mean(y) - slope * mean(x), where Sxx/Sxy are centred sums; Spark's
``regr_sxx``/``regr_sxy`` give them in one (partial + final) aggregation.
Repeated anchor points are merged analytically (pairwise moment update), so
no anchor rows are materialised and the fit is one pass over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecast import config as C


def _moments(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
            F.coalesce(F.regr_sxx(y, x), F.lit(0.0)).alias("sxx"),
            F.coalesce(F.regr_sxy(y, x), F.lit(0.0)).alias("sxy")]
    return d.groupBy(group).agg(*aggs) if group else d.agg(*aggs)


def _merge_anchors(n: Column, mx: Column, my: Column, sxx: Column, sxy: Column, copies: Column,
                   low=C.ANCHOR_LOW, high=C.ANCHOR_HIGH):
    """Add ``copies`` copies of each anchor point to the moments (Chan et al. update)."""
    na = copies * 2.0
    ax = (low[0] + high[0]) / 2.0
    ay = (low[1] + high[1]) / 2.0
    sxx_a = copies * ((low[0] - ax) ** 2 + (high[0] - ax) ** 2)
    sxy_a = copies * ((low[0] - ax) * (low[1] - ay) + (high[0] - ax) * (high[1] - ay))
    nt = n + na
    dx = F.lit(ax) - mx
    dy = F.lit(ay) - my
    mx_t = mx + dx * na / nt
    my_t = my + dy * na / nt
    sxx_t = sxx + sxx_a + dx * dx * n * na / nt
    sxy_t = sxy + sxy_a + dx * dy * n * na / nt
    return nt, mx_t, my_t, sxx_t, sxy_t


def _coef(mx: Column, my: Column, sxx: Column, sxy: Column, alpha: Column):
    den = sxx + alpha
    slope = F.when(den > 0, sxy / den).otherwise(F.lit(0.0))   # all-equal x with alpha 0 -> slope 0
    return slope, my - slope * mx


def anchored_ridge(df: DataFrame, x: str = "SignalOnly", y: str = "TicketIndex_DeSeason",
                   alpha: float = C.OVERALL_RIDGE_ALPHA,
                   min_rows: int = C.OVERALL_MIN_ROWS, anchor_rule: str = "ridge") -> DataFrame:
    """F06 (anchor_rule='ridge': copies = max(3, n//2)) / F08 (anchor_rule='ols': copies = max(2, n//3),
    alpha 0) — one-row table: n, slope, intercept, anchor_0, anchor_100. Empty when n < min_rows."""
    m = _moments(df, x, y)
    if anchor_rule == "ridge":
        copies = F.greatest(F.lit(3), F.floor(F.col("n") / 2)).cast("double")
    else:
        copies = F.greatest(F.lit(2), F.floor(F.col("n") / 3)).cast("double")
        alpha = 0.0
    nt, mx, my, sxx, sxy = _merge_anchors(F.col("n").cast("double"), F.col("mx"), F.col("my"),
                                          F.col("sxx"), F.col("sxy"), copies)
    slope, icpt = _coef(mx, my, sxx, sxy, F.lit(float(alpha)))
    return (m.where(F.col("n") >= min_rows)
            .select(F.col("n").cast("bigint").alias("n"), slope.alias("slope"), icpt.alias("intercept"))
            .withColumn("anchor_0", F.col("intercept"))
            .withColumn("anchor_100", F.col("intercept") + F.col("slope") * 100.0))


def group_fit(df: DataFrame, group: str = "category", x: str = "SignalOnly", y: str = "TicketIndex_DeSeason",
              alpha: float = C.CATEGORY_RIDGE_ALPHA, ridge_min: int = C.CATEGORY_RIDGE_MIN_ROWS,
              min_rows: int = C.CATEGORY_MIN_ROWS, anchors: bool = False) -> DataFrame:
    """F07 — per group: ridge (alpha) when n >= ridge_min, OLS when min_rows <= n < ridge_min,
    none below. With ``anchors`` (F08 fallback) copies = max(1, n//3) anchors and alpha 0."""
    m = _moments(df, x, y, group)
    n = F.col("n").cast("double")
    mx, my, sxx, sxy = F.col("mx"), F.col("my"), F.col("sxx"), F.col("sxy")
    a = F.when(F.col("n") >= ridge_min, F.lit(float(alpha))).otherwise(F.lit(0.0))
    if anchors:
        copies = F.greatest(F.lit(1), F.floor(F.col("n") / 3)).cast("double")
        _, mx, my, sxx, sxy = _merge_anchors(n, mx, my, sxx, sxy, copies)
        a = F.lit(0.0)
    slope, icpt = _coef(mx, my, sxx, sxy, a)
    return (m.where(F.col("n") >= min_rows)
            .select(group, F.col("n").cast("bigint").alias("n"), slope.alias("slope"), icpt.alias("intercept")))


def fit_metrics(df: DataFrame, coefs: DataFrame, x: str = "SignalOnly", y: str = "TicketIndex_DeSeason",
                group: str | None = None) -> DataFrame:
    """F09 — MAE, RMSE, R2 of a fitted line on the real rows (per group when given).
    R2 with zero total variance: 1.0 if the residuals are all zero else 0.0."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    j = d.join(coefs.select(*( [group] if group else []), "slope", "intercept"), group) if group \
        else d.crossJoin(F.broadcast(coefs.select("slope", "intercept")))
    res = F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.abs(res)).alias("MAE"),
            F.sqrt(F.avg(res * res)).alias("RMSE"), F.sum(res * res).alias("_sse"),
            F.coalesce(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0)).alias("_sst")]
    g = j.groupBy(group).agg(*aggs) if group else j.agg(*aggs)
    r2 = (F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_sse") / F.col("_sst"))
          .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return g.withColumn("R2", r2).drop("_sse", "_sst")


def tiered_impute(df: DataFrame, overall: DataFrame, by_group: DataFrame, group: str = "category",
                  x: str = "SignalOnly", y: str = "TicketIndex_DeSeason",
                  clip: tuple[float, float] = C.PREDICTION_CLIP,
                  labels: tuple[str, str] = ("ML Category", "ML Overall")) -> DataFrame:
    """F10 — history value, else group model, else overall model, else 'Not enough data'.
    Predictions are clipped; history is not. A row whose signal is NULL or NaN has no prediction from
    either model. Adds TicketIndex_DeSeason_Used, TicketIndexSource, TicketIndex_Predicted."""
    o = F.broadcast(overall.select(F.col("slope").alias("_os"), F.col("intercept").alias("_oi")))
    g = by_group.select(F.col(group).alias("_gk"), F.col("slope").alias("_gs"), F.col("intercept").alias("_gi"))
    j = df.join(g, F.col(group) == F.col("_gk"), "left").join(o, how="left")
    def clipped(raw: Column) -> Column:
        # least/greatest skip NULLs, so a missing prediction would otherwise become the floor
        return F.when(raw.isNotNull() & ~F.isnan(raw), F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), raw)))
    gp = clipped(F.col("_gi") + F.col("_gs") * F.col(x))
    op = clipped(F.col("_oi") + F.col("_os") * F.col(x))
    has_hist = F.col(y).isNotNull()
    pred = F.when(~has_hist, F.coalesce(gp, op))
    src = (F.when(has_hist, F.lit("History")).when(gp.isNotNull(), F.lit(labels[0]))
           .when(op.isNotNull(), F.lit(labels[1])).otherwise(F.lit("Not enough data")))
    return (j.withColumn("TicketIndex_Predicted", pred)
            .withColumn("TicketIndexSource", src)
            .withColumn("TicketIndex_DeSeason_Used", F.when(has_hist, F.col(y)).otherwise(F.col("TicketIndex_Predicted")))
            .drop("_gk", "_gs", "_gi", "_os", "_oi"))


def calibrate(df: DataFrame, pred: str, actual: str, group: str | None = None) -> DataFrame:
    """X02 — linear calibration actual ~ pred (global, per category or per ``remount_bin``): slope, intercept, n."""
    d = df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.regr_slope(actual, pred).alias("slope"),
            F.regr_intercept(actual, pred).alias("intercept")]
    return d.groupBy(group).agg(*aggs) if group else d.agg(*aggs)


def remount_bin(run_count: Column, years_since: Column) -> Column:
    """X02 — the bin of a title for calibration: 'new' without an earlier run, else 'recent' (last run at most
    two years ago, or at an unknown time), 'returning' (at most five) or 'old'."""
    return (F.when(F.coalesce(run_count, F.lit(0)) == 0, F.lit("new")).when(years_since > 5, F.lit("old"))
            .when(years_since > 2, F.lit("returning")).otherwise(F.lit("recent")))


def expanding_backtest(df: DataFrame, group: str, order: list[str], x: str, y: str, bucket: Column,
                       alpha: float = 0.0, min_rows: int = 2) -> DataFrame:
    """X03 — time-ordered backtest: each row is predicted by a line fitted on strictly
    earlier rows (running sums over an expanding window), no future leakage.

    ``bucket`` cuts the order into stretches (a month of the first order column, say; it must not
    decrease along the order). Sums per (group, bucket) are few; their running sums are carried into a
    window per (group, bucket), so a group that holds all rows is still spread over its buckets. Sums are of
    deviations from the group's means (which leave the fitted line as it is), so that large means do not
    cancel the digits of the squares. Prediction NULL until ``min_rows`` earlier rows.
    """
    whole = F.col(y).isNotNull() & F.col(x).isNotNull()
    centre = df.groupBy(F.col(group).alias("_mg")).agg(F.avg(F.when(whole, F.col(x))).alias("_mx"), F.avg(F.when(whole, F.col(y))).alias("_my"))
    d = df.join(centre, F.col(group).eqNullSafe(F.col("_mg")), "left").drop("_mg").withColumn("_b", bucket)
    dx, dy = F.when(whole, F.col(x) - F.col("_mx")), F.when(whole, F.col(y) - F.col("_my"))
    terms = {"_n": F.when(whole, 1.0), "_sx": dx, "_sy": dy, "_sxx": dx * dx, "_sxy": dx * dy}
    sums = d.groupBy(group, "_b").agg(*[F.sum(t).alias(c) for c, t in terms.items()])
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col(group).alias("_cg"), F.col("_b").alias("_cb"), *[F.sum(c).over(before).alias(f"_c{c}") for c in terms])
    d = d.join(carry, F.col(group).eqNullSafe(F.col("_cg")) & F.col("_b").eqNullSafe(F.col("_cb"))).drop("_cg", "_cb")
    within = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[(F.coalesce(F.sum(t).over(within), F.lit(0.0)) + F.coalesce(f"_c{c}", F.lit(0.0))).alias(c)
                        for c, t in terms.items()])
    n = F.nullif(F.col("_n"), F.lit(0.0))
    cxx = F.col("_sxx") - F.col("_sx") * F.col("_sx") / n
    cxy = F.col("_sxy") - F.col("_sx") * F.col("_sy") / n
    den = cxx + F.lit(float(alpha))
    slope = F.when(den > 1e-12, cxy / den).otherwise(F.lit(0.0))
    icpt = F.col("_my") + F.col("_sy") / n - slope * F.col("_sx") / n
    pred = F.when(F.col("_n") >= min_rows, icpt + slope * (F.col(x) - F.col("_mx")))
    return d.withColumn("prediction", pred).withColumn("train_rows", F.col("_n").cast("bigint")).drop(
        "_b", "_mx", "_my", *terms, *[f"_c{c}" for c in terms])
