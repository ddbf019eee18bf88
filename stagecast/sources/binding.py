"""Binding of the driver's TPC-H-like tables to the planning roles.

Role            table / rule
--------------  ---------------------------------------------------------------
title           part.p_partkey (p_name only for text rules)
category        part.p_type
lead gender     p_size % 4 -> female, male, co, na
city            region.r_name through lineitem->orders->customer->nation: the five regions are
                sold from two cities (``CITY_OF_REGION``)
segment         customer.c_mktsegment
single_tickets  lineitem.l_quantity
start_date      cast(l_shipdate as date)
signals         per part over all lineitem rows (wiki/trends/youtube/chartmetric)
hidden titles   only where a query asks for it (``hidden_every``, F10 and J10): every n-th part key has
                no sales history, so that imputation and fallbacks have work; elsewhere nothing is hidden

Every builder is lazy and reads whole tables. The oracle SQL in
``stagecast.plans.oracles`` builds the same roles with its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES — binding constants
CITIES = ("AMERICA", "EUROPE")
CITY_OF_REGION = {"AMERICA": "AMERICA", "AFRICA": "AMERICA", "EUROPE": "EUROPE", "ASIA": "EUROPE", "MIDDLE EAST": "EUROPE"}
HIDDEN_EVERY = 5
GENDER_BY_SIZE_MOD4 = ("female", "male", "co", "na")
DEFAULT_SPLIT = {"AMERICA": 0.60, "EUROPE": 0.40}
EVENT_LEFT_TYPE, EVENT_RIGHT_TYPE = "purchase", "view"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gender_of_size(size: Column) -> Column:
    g = F.lit(GENDER_BY_SIZE_MOD4[3])
    for i in (2, 1, 0):
        g = F.when(F.pmod(size, F.lit(4)) == i, F.lit(GENDER_BY_SIZE_MOD4[i])).otherwise(g)
    return g


def customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> (c_custkey, segment, region). nation/region are bounded (25/5 rows)."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey)
                      .select("n_nationkey", "r_name"))
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (cust.join(geo, cust.c_nationkey == geo.n_nationkey)
            .select("c_custkey", F.col("c_mktsegment").alias("segment"),
                    F.col("r_name").alias("region")))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-level sales rows, all of them: title, city, region, segment, start_date, single_tickets, revenue."""
    cust = customer_geo(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "segment", "region")
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return (li.join(oc, li.l_orderkey == oc.o_orderkey)
            .select(F.col("l_partkey").alias("title"),
                    F.create_map(*[F.lit(x) for kv in CITY_OF_REGION.items() for x in kv])[F.col("region")].alias("city"),
                    "region", "segment",
                    F.col("l_shipdate").cast("date").alias("start_date"),
                    F.col("l_quantity").alias("single_tickets"),
                    (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")))


def history(spark: SparkSession, sf_dir: str, hidden_every: int = 0) -> DataFrame:
    """Sales history; with ``hidden_every`` every n-th title has none."""
    s = sales(spark, sf_dir)
    if hidden_every:
        s = s.where(F.pmod(F.col("title"), F.lit(hidden_every)) != 0)
    return s


def history_cube(spark: SparkSession, sf_dir: str, hidden_every: int = 0) -> DataFrame:
    """History pre-aggregated to one row per (title, city, segment, day).

    Lossless for every downstream use (sums, run grouping by day, city and
    segment shares) and much smaller than the line-level table; partial
    aggregation happens before the shuffle.
    """
    return (history(spark, sf_dir, hidden_every)
            .where(F.col("single_tickets").isNotNull() & (F.col("single_tickets") >= 0))
            .groupBy("title", "city", "segment", "start_date")
            .agg(F.sum("single_tickets").alias("single_tickets"),
                 F.sum("revenue").alias("revenue"),
                 F.count(F.lit(1)).alias("n_rows")))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles to score: title, name, category, gender."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return part.select(F.col("p_partkey").alias("title"), F.col("p_name").alias("name"),
                       F.col("p_type").alias("category"), gender_of_size(F.col("p_size")).alias("gender"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-title digital signals from all lineitem rows (one partial+final aggregation)."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    agg = li.groupBy(F.col("l_partkey").alias("title")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("l_quantity").alias("_q"),
        F.avg("l_extendedprice").alias("_p"), F.avg("l_discount").alias("_d"))
    return agg.select(
        "title",
        (F.lit(40.0) + F.least(F.lit(110.0), F.lit(20.0) * F.log1p(F.col("_n").cast("double")))).alias("wiki"),
        F.col("_q").alias("trends"),
        (F.lit(50.0) + F.least(F.lit(90.0), F.lit(9.0) * F.log1p(F.col("_p") / 100.0))).alias("youtube"),
        (F.lit(1000.0) * F.col("_d")).alias("chartmetric"))


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline signal table: titles with signals (title, name, category, gender, 4 signals, source)."""
    return (titles(spark, sf_dir).join(signals(spark, sf_dir), "title")
            .withColumn("source", F.lit("historical")))


def default_split(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_SPLIT.items()), "city string, share double")


def as_of_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """events: left = purchases, right = views, key user_id, time ts, value."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    left = ev.where(F.col("event_type") == EVENT_LEFT_TYPE).select("event_id", "user_id", "ts", "value")
    right = ev.where(F.col("event_type") == EVENT_RIGHT_TYPE).select(
        "user_id", "ts", F.col("value").alias("view_value"), F.col("event_id").alias("view_id"))
    return left, right


def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by (event_type as city, day): min_temperature = 30 - max(value)/5, snow = avg(value)/5."""
    ev = read(spark, sf_dir, "events").select("ts", "event_type", "value")
    return (ev.groupBy(F.col("event_type").alias("city"), F.col("ts").cast("date").alias("date"))
            .agg((F.lit(30.0) - F.max("value") / 5.0).alias("min_temperature"),
                 (F.avg("value") / 5.0).alias("snow"),
                 (F.lit(30.0) - F.avg("value") / 5.0).alias("avg_temperature"),
                 (F.lit(30.0) - F.min("value") / 5.0).alias("max_temperature"),
                 (F.sum("value") / 100.0).alias("precipitation"),
                 F.count(F.lit(1)).cast("double").alias("max_wind_speed")))
