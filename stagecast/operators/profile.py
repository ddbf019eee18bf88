"""Source profiling and summaries.

Profiles are computed with one aggregation per pass over the table (counts,
null counts, min/max dates, exact quartiles), then a second aggregation for
outlier counts against the quartile fences; the result is long
(source, metric, column, value) so any number of columns fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagecast.functions.columns import intent_clarity
from stagecast.functions.quantiles import exact_median, exact_percentiles


def monthly_weather_summary(weather: DataFrame, date_col: str = "date", city: str | None = "city",
                            cold_limit: float = -20.0) -> DataFrame:
    """A08 — per month (and city): mean avg/min temperature, mean snow and precipitation,
    number of days colder than ``cold_limit``; the whole table at once."""
    keys = [F.month(F.col(date_col)).alias("month")] + ([F.col(city)] if city else [])
    return weather.groupBy(*keys).agg(
        F.avg("avg_temperature").alias("avg_temperature"),
        F.avg("min_temperature").alias("avg_min_temperature"),
        F.avg("snow").alias("avg_snow"),
        F.avg("precipitation").alias("avg_precipitation"),
        F.count_if(F.col("min_temperature") < cold_limit).alias("extreme_cold_days"),
        F.count(F.lit(1)).alias("days"))


_NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)


def profile_source(df: DataFrame, source: str, expected: Sequence[str] = (), required: Sequence[str] = (),
                   date_col: str | None = None, min_values: int = 10,
                   fence: float = 3.0) -> DataFrame:
    """A09 — long profile rows (source, metric, column, value):
    row_count, column_count, missing_expected (value 1 per missing column),
    null_count per column (only > 0), required_nulls, date_min/date_max (as yyyymmdd),
    outliers beyond q1 - 3 IQR / q3 + 3 IQR for the numeric columns with more than
    ``min_values`` non-null values (only > 0)."""
    cols = df.columns
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"__null_{i}") for i, c in enumerate(cols)]
    if date_col and date_col in cols:
        aggs += [F.min(F.col(date_col).cast("date")).alias("__dmin"), F.max(F.col(date_col).cast("date")).alias("__dmax")]
    rows = df
    if numeric:
        # quartiles of all numeric columns in one unpivoted exact quantile (grouped by column): two scans
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"`{c}`").cast("double").alias("_x"))
                                             for i, c in enumerate(numeric)])).alias("e")).select("e._c", "e._x")
        q = exact_percentiles(long, "_x", [0.25, 0.75], "_c")   # one group per column
        rows = df.crossJoin(F.broadcast(q.agg(*[F.max(F.when(F.col("_c") == i, F.array("p0", "p1"))).alias(f"__q_{i}")
                                                for i in range(len(numeric))])))       # one row
    for i, c in enumerate(numeric):
        q1, q3 = F.col(f"__q_{i}")[0], F.col(f"__q_{i}")[1]
        lo, hi = q1 - fence * (q3 - q1), q3 + fence * (q3 - q1)
        v = F.col(f"`{c}`").cast("double")
        outside = F.count_if(v.isNotNull() & ~F.isnan(v) & ((v < lo) | (v > hi)))
        aggs.append(F.when(F.count(v) > min_values, outside).otherwise(0).alias(f"__out_{i}"))
    row = rows.agg(*aggs)          # counts, NULLs, dates and outliers: the third scan

    def E(metric, column, value):
        col = F.lit(column).cast("string")
        return F.struct(F.lit(metric).alias("metric"), col.alias("column"), value.cast("double").alias("value"))

    entries = [E("row_count", None, F.col("__rows")), E("column_count", None, F.lit(float(len(cols))))]
    lower = {c.lower() for c in cols}
    for e in expected:
        if e.lower() not in lower:
            entries.append(E("missing_expected", e, F.lit(1.0)))
    for i, c in enumerate(cols):
        entries.append(E("null_count", c, F.col(f"__null_{i}")))
        if c in required:
            entries.append(E("required_nulls", c, F.col(f"__null_{i}")))
    if date_col and date_col in cols:
        entries.append(E("date_min", date_col, F.date_format("__dmin", "yyyyMMdd")))
        entries.append(E("date_max", date_col, F.date_format("__dmax", "yyyyMMdd")))
    for i, c in enumerate(numeric):
        entries.append(E("outliers", c, F.col(f"__out_{i}")))
    long = row.select(F.explode(F.array(*entries)).alias("e")).select(
        F.lit(source).alias("source"), "e.metric", "e.column", "e.value")
    return long.where(~F.col("metric").isin("null_count", "outliers") | (F.col("value") > 0))


def registry_report(profiles: Sequence[DataFrame]) -> DataFrame:
    """A10 — one row per source from A09 rows: rows, columns, null columns, outlier columns, date
    coverage, missing columns (errors), required columns with NULLs (warnings) and a details string."""
    u = profiles[0]
    for p in profiles[1:]:
        u = u.unionByName(p)
    metric = F.col("metric")
    return u.groupBy("source").agg(
        F.max(F.when(metric == "row_count", F.col("value"))).cast("bigint").alias("row_count"),
        F.max(F.when(metric == "column_count", F.col("value"))).cast("bigint").alias("column_count"),
        F.count_if(metric == "null_count").alias("columns_with_nulls"),
        F.count_if(metric == "outliers").alias("columns_with_outliers"),
        F.max(F.when(metric == "date_min", F.col("value"))).cast("bigint").alias("date_min"),
        F.max(F.when(metric == "date_max", F.col("value"))).cast("bigint").alias("date_max"),
        F.count_if(metric == "missing_expected").alias("errors"),
        F.count_if((metric == "null_count") | (metric == "outliers") | ((metric == "required_nulls") & (F.col("value") > 0)))
        .alias("warnings"),
        F.concat_ws("; ", F.array_sort(F.collect_list(F.when(
            (metric == "missing_expected") | ((metric == "required_nulls") & (F.col("value") > 0)),
            F.concat_ws(":", "metric", "column"))))).alias("details"))


def registry_totals(report: DataFrame) -> DataFrame:
    """A10 — one row over a report: sources found, with errors, with warnings, and all their rows."""
    return report.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("errors") > 0).alias("with_errors"),
                      F.count_if(F.col("warnings") > 0).alias("with_warnings"),
                      F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"))


def source_mix(df: DataFrame, col: str, labels: Sequence[str]) -> DataFrame:
    """A11 — counts over a fixed label list (missing -> 0), non-zero labels only, in label order."""
    spark = df.sparkSession
    lab = F.broadcast(spark.createDataFrame([(l, i) for i, l in enumerate(labels)], "label string, pos int"))
    counts = df.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return (lab.join(counts, "label", "left").select("label", "pos", F.coalesce("n", F.lit(0)).alias("n"))
            .where(F.col("n") > 0))


def intent_summary(df: DataFrame, col: str = "IntentRatio") -> DataFrame:
    """A12 — median intent ratio and its clarity band (1 row)."""
    return (exact_median(df, col, None, "intent_ratio").drop("n")
            .withColumn("clarity", intent_clarity("intent_ratio")))
