"""City and audience-segment allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecast import config as C


def city_totals(history: DataFrame, key: str = "title", city: str = "city",
                value: str = "single_tickets") -> DataFrame:
    """A03 (long form) — total tickets per (key, city); missing cells are absent (0 when pivoted)."""
    return history.groupBy(key, city).agg(F.sum(value).alias("tickets"))


def long_to_wide(totals: DataFrame, key: str, city: str, cities: Sequence[str], value: str = "tickets") -> DataFrame:
    """A03 — pivot city totals to one column per city, missing -> 0 (city list given, so one pass)."""
    return totals.groupBy(key).pivot(city, list(cities)).agg(F.sum(value)).na.fill(0.0, subset=list(cities))


def _share_map(totals_wide: DataFrame, key: str, cities: Sequence[str], clip: tuple[float, float]) -> DataFrame:
    """Per key: city -> share over the full city list (absent city = 0), keys with
    total <= 0 dropped, each share clipped then renormalised (per-row arithmetic)."""
    vals = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cities]
    tot = vals[0]
    for v in vals[1:]:
        tot = tot + v
    clipped = [F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), v / tot)) for v in vals]
    csum = clipped[0]
    for v in clipped[1:]:
        csum = csum + v
    m = F.create_map(*[x for c, cv in zip(cities, clipped) for x in (F.lit(c), cv / csum)])
    t = F.create_map(*[x for c, v in zip(cities, vals) for x in (F.lit(c), v)])
    return totals_wide.where(tot > 0).select(key, m.alias("shares"), t.alias("tickets"), tot.alias("total"))


def _wide_totals(history: DataFrame, key: str, city: str, value: str, cities: Sequence[str]) -> DataFrame:
    """A03 in one grouped pass: per key one conditional sum per (configured) city."""
    return history.groupBy(key).agg(*[F.sum(F.when(F.col(city) == c, F.col(value))).alias(c) for c in cities])


def learn_city_shares(history: DataFrame, categories: DataFrame, cities: Sequence[str], key: str = "title",
                      city: str = "city", value: str = "single_tickets", category: str = "category",
                      clip: tuple[float, float] = C.CITY_CLIP_RANGE) -> tuple[DataFrame, DataFrame]:
    """A04 — learned city shares at title and category level, as maps city -> share.

    share = city / total over the given city list (absent city = 0), clipped to
    ``clip`` and renormalised (for two cities with a symmetric clip this is
    exactly clip(c) and 1 - clip(c)); totals <= 0 are dropped. Category totals
    are sums of title totals, the category taken from ``categories``.
    One grouped pass per level. Returns (title_shares(key, shares, tickets, total),
    category_shares(category, shares, tickets, total)).
    """
    tw = _wide_totals(history, key, city, value, cities)
    title_sh = _share_map(tw, key, cities, clip)
    cw = (tw.join(categories.select(key, category), key)
          .groupBy(category).agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in cities]))
    cat_sh = _share_map(cw, category, cities, clip)
    return title_sh, cat_sh


def shares_long(shares: DataFrame, key: str, city: str = "city") -> DataFrame:
    """Long (key, city, share, tickets, total) view of a share-map table."""
    return (shares.select(key, "total", "tickets", F.explode("shares").alias(city, "share"))
            .select(key, city, "share", F.element_at("tickets", F.col(city)).alias("tickets"), "total"))


def city_split(df: DataFrame, title_shares: DataFrame, category_shares: DataFrame, default: dict,
               key: str = "title", category: str = "category", out: str = "city_split") -> DataFrame:
    """J10 — city split per row: title shares, else category shares, else default, chosen as a
    *whole* map (never mixed per city) so shares still add to 1."""
    ts = title_shares.select(key, F.col("shares").alias("_tm"))
    cs = category_shares.select(F.col(category).alias("_ck"), F.col("shares").alias("_cm"))
    dflt = F.create_map(*[x for k, v in default.items() for x in (F.lit(k), F.lit(float(v)))])
    j = df.join(ts, key, "left").join(cs, F.col(category) == F.col("_ck"), "left")
    return (j.withColumn(out, F.coalesce(F.col("_tm"), F.col("_cm"), dflt))
            .withColumn(out + "_source", F.when(F.col("_tm").isNotNull(), F.lit("title"))
                        .when(F.col("_cm").isNotNull(), F.lit("category")).otherwise(F.lit("default")))
            .drop("_tm", "_cm", "_ck"))


def city_allocation(split_map: Column, total: Column, cities: Sequence[str]) -> Column:
    """F17 — array<struct(city, share, tickets)>: shares normalised over ``cities`` (missing -> 0,
    zero sum -> 1), tickets = half-even round(total * share)."""
    vals = [F.coalesce(F.element_at(split_map, F.lit(c)), F.lit(0.0)) for c in cities]
    s = vals[0]
    for v in vals[1:]:
        s = s + v
    s = F.when(s == 0, F.lit(1.0)).otherwise(s)
    tot = F.coalesce(total.cast("double"), F.lit(0.0))
    return F.array(*[F.struct(F.lit(c).alias("city"), (v / s).alias("share"),
                              F.bround(tot * (v / s), 0).alias("tickets")) for c, v in zip(cities, vals)])


def prior_weights(priors: DataFrame, region: str, segments: Sequence[str] | None = None,
                  strength: float = 1.0, category: str = "category") -> DataFrame:
    """F14/F18 input — per category the prior weight array in segment order for ``region``
    (missing segment -> 1.0; tempered w**p when p != 1, w <= 0 -> 1.0). Bounded: categories x segments."""
    segments = C.SEGMENT_KEYS_IN_ORDER if segments is None else list(segments)
    p = priors.where(F.col("region") == region)
    m = p.groupBy(category).agg(F.map_from_entries(F.collect_list(F.struct("segment", "weight"))).alias("_pm"))
    ws = []
    for s in segments:
        w = F.element_at(F.col("_pm"), F.lit(s))
        if strength != 1.0:
            w = F.when(w > 0, F.pow(w, F.lit(float(strength)))).otherwise(F.lit(1.0))
        ws.append(F.coalesce(w, F.lit(1.0)))
    return m.select(F.col(category).alias("_prior_cat"), F.array(*ws).alias("prior_weights"))


def add_segment_mix(df: DataFrame, seg_idx: str, prior_w: str | None, estimate: str, out: str = "segment_mix",
                    floor: float = C.SEGMENT_SHARE_FLOOR) -> DataFrame:
    """F14/F15 — adds ``out`` = array<struct(segment, pos, share, tickets, rank)> per row.

    combined_k = max(floor, prior_k * idx_k); share = combined / sum;
    tickets = half-even round(estimate * share) (independently per segment);
    rank 1..n by share desc, ties in segment order. Per-row array work bounded
    by the number of segments, written as chained projections so no
    sub-expression is repeated.
    """
    pw = F.col(prior_w) if prior_w else F.lit(None).cast("array<double>")
    d = df.withColumn("_comb", F.transform(F.col(seg_idx), lambda e, i: F.struct(
        e["segment"].alias("segment"), i.alias("pos"),
        F.greatest(F.lit(floor), F.coalesce(F.element_at(pw, i + 1), F.lit(1.0))
                   * F.coalesce(F.nanvl(e["idx"], F.lit(0.0)), F.lit(0.0))).alias("c"))))
    d = d.withColumn("_ctot", F.aggregate(F.col("_comb"), F.lit(0.0), lambda acc, e: acc + e["c"]))
    tot = F.when(F.col("_ctot") == 0, F.lit(1.0)).otherwise(F.col("_ctot"))
    est = F.coalesce(F.nanvl(F.col(estimate).cast("double"), F.lit(0.0)), F.lit(0.0))
    d = d.withColumn("_shares", F.array_sort(
        F.transform(F.col("_comb"), lambda e: F.struct(
            e["segment"].alias("segment"), e["pos"].alias("pos"), (e["c"] / tot).alias("share"),
            F.bround(est * (e["c"] / tot), 0).alias("tickets"))),
        lambda a, b: F.when(a["share"] > b["share"], F.lit(-1)).when(a["share"] < b["share"], F.lit(1))
        .when(a["pos"] < b["pos"], F.lit(-1)).when(a["pos"] > b["pos"], F.lit(1)).otherwise(F.lit(0))))
    d = d.withColumn(out, F.transform(F.col("_shares"), lambda e, i: F.struct(
        e["segment"].alias("segment"), e["pos"].alias("pos"), e["share"].alias("share"),
        e["tickets"].alias("tickets"), (i + 1).alias("rank"))))
    return d.drop("_comb", "_ctot", "_shares")


def segment_weights_json(mix: Column) -> Column:
    """F16 — JSON object segment -> share rounded to 4 places, in segment order."""
    by_pos = F.array_sort(mix, lambda a, b: F.when(a["pos"] < b["pos"], F.lit(-1))
                          .when(a["pos"] > b["pos"], F.lit(1)).otherwise(F.lit(0)))
    return F.to_json(F.map_from_entries(F.transform(by_pos, lambda e: F.struct(
        e["segment"], F.round(e["share"], 4)))))


def two_stage_split(seg_long: DataFrame, city_long: DataFrame, key: str = "title") -> DataFrame:
    """X11 — segment tickets x city share: one row per (key, segment, city)."""
    return (seg_long.select(key, "segment", F.col("tickets").alias("seg_tickets"))
            .join(city_long.select(key, "city", F.col("share").alias("city_share")), key)
            .withColumn("tickets", F.bround(F.col("seg_tickets") * F.col("city_share"), 0)))
