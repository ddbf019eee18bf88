"""Signal scoring against a benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast import config as C


def _mult_map(mult: dict, segment: str) -> Column:
    d = mult.get(segment, {})
    if not d:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))])


def familiarity_raw(wiki="wiki", trends="trends", chartmetric="chartmetric") -> Column:
    w = C.FAMILIARITY_WEIGHTS
    return (F.col(wiki) * w["wiki"] + F.col(trends) * w["trends"] + F.col(chartmetric) * w["chartmetric"])


def motivation_raw(youtube="youtube", trends="trends", chartmetric="chartmetric", wiki="wiki") -> Column:
    w = C.MOTIVATION_WEIGHTS
    return (F.col(youtube) * w["youtube"] + F.col(trends) * w["trends"]
            + F.col(chartmetric) * w["chartmetric"] + F.col(wiki) * w["wiki"])


def segment_multiplier(gender: Column, category: Column, segment: str, mult: dict | None = None) -> Column:
    """seg[gender] * seg[category], missing keys -> 1.0 (config map literal, no join)."""
    mult = C.SEGMENT_MULT if mult is None else mult
    m = _mult_map(mult, segment)
    return (F.coalesce(F.element_at(m, gender), F.lit(1.0))
            * F.coalesce(F.element_at(m, category), F.lit(1.0)))


def raw_scores(df: DataFrame, segment: str = "General Population", region: str = "Province",
               mult: dict | None = None, region_mult: dict | None = None,
               gender: str = "gender", category: str = "category") -> DataFrame:
    """F01 — FamiliarityRaw / MotivationRaw with segment (gender x category) and region multipliers."""
    region_mult = C.REGION_MULT if region_mult is None else region_mult
    k = segment_multiplier(F.col(gender), F.col(category), segment, mult) * F.lit(float(region_mult.get(region, 1.0)))
    return (df.withColumn("FamiliarityRaw", familiarity_raw() * k)
              .withColumn("MotivationRaw", motivation_raw() * k))


def benchmark_index(df: DataFrame, bench: DataFrame) -> DataFrame:
    """F02/J12 — Familiarity/Motivation = raw / benchmark raw * 100 (benchmark raw 0 or NULL -> 1.0);
    F03 SignalOnly = mean of the two. ``bench`` has exactly one row (broadcast)."""
    b = F.broadcast(bench.select(
        F.coalesce(F.nullif(F.col("FamiliarityRaw"), F.lit(0.0)), F.lit(1.0)).alias("_bf"),
        F.coalesce(F.nullif(F.col("MotivationRaw"), F.lit(0.0)), F.lit(1.0)).alias("_bm")))
    return (df.crossJoin(b)
            .withColumn("Familiarity", F.col("FamiliarityRaw") / F.col("_bf") * 100.0)
            .withColumn("Motivation", F.col("MotivationRaw") / F.col("_bm") * 100.0)
            .withColumn("SignalOnly", signal_only())
            .drop("_bf", "_bm"))


def signal_only(fam="Familiarity", mot="Motivation") -> Column:
    """F03 — mean of the two indices."""
    return (F.col(fam) + F.col(mot)) / 2.0


def segment_raw_pair(gender: Column, category: Column, fam0: Column, mot0: Column,
                     segments: Sequence[str] | None = None, mult: dict | None = None) -> Column:
    """F01 for every segment: array<struct(segment, fam, mot)> (multiplier maps are config literals)."""
    segments = C.SEGMENT_KEYS_IN_ORDER if segments is None else segments
    items = []
    for s in segments:
        k = segment_multiplier(gender, category, s, mult)
        items.append(F.struct(F.lit(s).alias("segment"), (fam0 * k).alias("fam"), (mot0 * k).alias("mot")))
    return F.array(*items)


def segment_signal_index(raw: Column, bench_raw: Column) -> Column:
    """F04 — per segment, the title's familiarity/motivation indexed to the benchmark's score for the
    same segment (0 -> 1.0), averaged: array<struct(segment, idx)>. Pure per-row array work."""
    return F.transform(F.arrays_zip(raw.alias("r"), bench_raw.alias("b")), lambda z: F.struct(
        z["r"]["segment"].alias("segment"),
        ((z["r"]["fam"] / F.coalesce(F.nullif(z["b"]["fam"], F.lit(0.0)), F.lit(1.0)) * 100.0
          + z["r"]["mot"] / F.coalesce(F.nullif(z["b"]["mot"], F.lit(0.0)), F.lit(1.0)) * 100.0) / 2.0).alias("idx")))


def deseason_index(df: DataFrame, bench: DataFrame, median_col: str = "TicketMedian",
                   hist_factor_col: str = "HistSeasonalityFactor") -> DataFrame:
    """F05 — TicketIndex_DeSeason = (median / hist factor) / benchmark de-seasoned median * 100.

    ``bench`` is one row with columns bench_median, bench_hist_factor; a missing or
    zero benchmark median counts as 1.0; NULL median -> NULL index.
    """
    b = F.broadcast(bench.select(
        (F.coalesce(F.nullif(F.col("bench_median"), F.lit(0.0)), F.lit(1.0))
         / F.coalesce(F.nullif(F.col("bench_hist_factor"), F.lit(0.0)), F.lit(1.0))).alias("BenchMedianDeSeason")))
    f = F.coalesce(F.nullif(F.col(hist_factor_col), F.lit(0.0)), F.lit(1.0))
    return (df.crossJoin(b)
            .withColumn("TicketIndex_DeSeason",
                        F.when(F.col(median_col).isNotNull(),
                               (F.col(median_col) / f) / F.coalesce(F.nullif(F.col("BenchMedianDeSeason"), F.lit(0.0)), F.lit(1.0)) * 100.0)))


def composite(signal="SignalOnly", effective="EffectiveTicketIndex", source="TicketIndexSource",
              weight: float = C.TICKET_BLEND_WEIGHT) -> Column:
    """F12 — (1-w)*signal + w*index, index replaced by signal when there is not enough data."""
    idx = F.when(F.col(source) == "Not enough data", F.col(signal)).otherwise(F.col(effective))
    return F.lit(1.0 - weight) * F.col(signal) + F.lit(weight) * idx


def estimated_tickets(effective="EffectiveTicketIndex", bench_deseason="BenchMedianDeSeason") -> Column:
    """F13 — half-even round(index / 100 * de-seasoned benchmark median)."""
    b = F.coalesce(F.nullif(F.col(bench_deseason), F.lit(0.0)), F.lit(1.0))
    return F.bround(F.col(effective) / 100.0 * b, 0)


def final_tickets(est="EstimatedTickets", factor: float = C.POSTCOVID_FACTOR) -> Column:
    """F13 — Final = half-even round(coalesce(est, 0) * factor)."""
    return F.bround(F.coalesce(F.col(est), F.lit(0.0)) * F.lit(float(factor)), 0)


def tempered_prior(w, p: float = 1.0) -> Column:
    """F18 — weight^p when p != 1 (w <= 0 -> 1.0); p == 1 leaves weights unchanged."""
    wc = F.col(w) if isinstance(w, str) else w
    if p == 1.0:
        return wc
    return F.when(wc > 0, F.pow(wc, F.lit(float(p)))).otherwise(F.lit(1.0))


def softmax_like(df: DataFrame, group: str, value: str, temperature: float = 1.0, out: str = "mix") -> DataFrame:
    """F19 — exp(ln(max(v,1e-9))/T - max) / sum within the group (group-level aggregate joined back)."""
    t = max(1e-6, float(temperature))
    lg = F.log(F.greatest(F.col(value).cast("double"), F.lit(1e-9))) / F.lit(t)
    d = df.withColumn("_lg", lg)
    mx = d.groupBy(group).agg(F.max("_lg").alias("_mx"))
    e = d.join(mx, group).withColumn("_e", F.exp(F.col("_lg") - F.col("_mx")))
    z = e.groupBy(group).agg(F.sum("_e").alias("_z"))
    return (e.join(z, group).withColumn(out, F.col("_e") / F.coalesce(F.nullif("_z", F.lit(0.0)), F.lit(1.0)))
            .drop("_lg", "_mx", "_e", "_z"))


def clip(c, lo: float, hi: float) -> Column:
    cc = F.col(c) if isinstance(c, str) else c
    return F.least(F.lit(hi), F.greatest(F.lit(lo), cc))


def economic_factor(oil_price, unemployment_rate, weights: dict | None = None) -> Column:
    """F20 — oil = .8+.4*clip(price/60,.5,1.5), unemployment = .8+.4*clip(6/rate,.5,1.5);
    a missing or non-positive input counts as 1.0; weights (.4/.6) normalised;
    result clipped to [.85, 1.10]."""
    w = C.ECON_WEIGHTS if weights is None else weights
    tot = float(w["oil"] + w["unemployment"])
    if tot <= 0:
        return F.lit(1.0)
    oil = F.col(oil_price) if isinstance(oil_price, str) else oil_price
    un = F.col(unemployment_rate) if isinstance(unemployment_rate, str) else unemployment_rate
    oil_f = F.when(oil > 0, F.lit(0.8) + F.lit(0.4) * clip(oil / C.ECON_OIL_REF, 0.5, 1.5)).otherwise(F.lit(1.0))
    un_f = F.when(un > 0, F.lit(0.8) + F.lit(0.4) * clip(F.lit(C.ECON_UNEMP_REF) / un, 0.5, 1.5)).otherwise(F.lit(1.0))
    comb = F.lit(w["oil"] / tot) * oil_f + F.lit(w["unemployment"] / tot) * un_f
    return clip(comb, *C.ECON_CLIP)


def weather_factor(min_temperature, snow) -> Column:
    """F21 — x.90 if min temp < -20, x.95 if snow > 10, clip [.85, 1.05]; no data -> 1.0."""
    mt = F.col(min_temperature) if isinstance(min_temperature, str) else min_temperature
    sn = F.col(snow) if isinstance(snow, str) else snow
    f = (F.when(mt < C.WEATHER_COLD_LIMIT, F.lit(C.WEATHER_COLD_MULT)).otherwise(F.lit(1.0))
         * F.when(sn > C.WEATHER_SNOW_LIMIT, F.lit(C.WEATHER_SNOW_MULT)).otherwise(F.lit(1.0)))
    return F.when(mt.isNull() & sn.isNull(), F.lit(1.0)).otherwise(clip(f, *C.WEATHER_CLIP))
