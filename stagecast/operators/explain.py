"""Linear attribution and its text forms.

For a linear model with an independent background sample, kernel attribution
values are exactly beta_j * (x_j - mean_bg(x_j)) and the base value is the mean
prediction over the background; so attribution is a column expression over
the whole table (no sampling, no per-row solver, no cache).

The multi-feature anchored ridge (E02) is fitted from one aggregation of
centred co-moments, which Spark merges across partitions without ever forming
raw sums of squares; the k x k normal equations are solved by a Cholesky
decomposition written as column expressions over that one row, so the whole
fit is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP_INF = 1e10


def sanitize(c) -> Column:
    """E01 — NULL/NaN -> 0, +-inf -> +-1e10."""
    col = F.col(c) if isinstance(c, str) else c
    v = F.coalesce(F.nanvl(col.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(CLIP_INF), F.greatest(F.lit(-CLIP_INF), v))


def sanitize_frame(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*[sanitize(c).alias(c) if c in features else F.col(c) for c in df.columns])


def ridge_moments(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row over sanitised rows with a target: n, means ``m{j}`` and ``my``, sums of products of deviations
    ``c{a}_{b}`` (b >= a) and ``cy{j}``."""
    k, n = len(features), F.count(F.lit(1))
    aggs = [n.alias("n"), F.avg(target).alias("my"), *[F.avg(f).alias(f"m{j}") for j, f in enumerate(features)]]
    aggs += [(F.covar_pop(features[a], features[b]) * n).alias(f"c{a}_{b}") for a in range(k) for b in range(a, k)]
    aggs += [(F.covar_pop(f, target) * n).alias(f"cy{j}") for j, f in enumerate(features)]
    return sanitize_frame(df.where(F.col(target).isNotNull()), features).agg(*aggs)


def with_anchors(moments: DataFrame, k: int, low: float = 25.0, high: float = 100.0) -> DataFrame:
    """Adds max(3, n // 2) copies of (0, ..., 0) -> ``low`` and of (mean x) -> ``high`` to the moments.

    The second anchor lies at the mean, so it moves the target's mean alone; the first one is merged by the
    pairwise update of centred moments.
    """
    c = F.greatest(F.lit(3), F.floor(F.col("n") / 2)).cast("double")
    one = moments.select("*", c.alias("_c"), (F.col("n") + c).alias("_n1"), (F.col("n") + 2 * c).alias("_nt"),
                         ((F.col("n") * F.col("my") + c * high) / (F.col("n") + c)).alias("_my1"))
    part = F.col("_n1") * F.col("_c") / F.col("_nt")
    dy = F.lit(low) - F.col("_my1")
    new = {f"c{a}_{b}": F.col(f"c{a}_{b}") + F.col(f"m{a}") * F.col(f"m{b}") * part for a in range(k) for b in range(a, k)}
    new |= {f"cy{j}": F.col(f"cy{j}") - F.col(f"m{j}") * dy * part for j in range(k)}
    new |= {f"m{j}": F.col(f"m{j}") * F.col("_n1") / F.col("_nt") for j in range(k)}
    new["my"] = F.col("_my1") + dy * F.col("_c") / F.col("_nt")
    return one.select("n", *[x.alias(c) for c, x in new.items()])


def solved(moments: DataFrame, k: int, alpha: float) -> DataFrame:
    """Adds ``b{j}``, the solution of (C + alpha I) b = c_y, by Cholesky decomposition column by column."""
    d = moments
    for j in range(k):
        own = F.col(f"c{j}_{j}") + F.lit(float(alpha)) - sum((F.col(f"_l{j}_{s}") * F.col(f"_l{j}_{s}") for s in range(j)), F.lit(0.0))
        d = d.withColumn(f"_l{j}_{j}", F.sqrt(own))
        d = d.withColumns({f"_l{i}_{j}": (F.col(f"c{j}_{i}") - sum((F.col(f"_l{i}_{s}") * F.col(f"_l{j}_{s}") for s in range(j)), F.lit(0.0)))
                           / F.col(f"_l{j}_{j}") for i in range(j + 1, k)}) if j + 1 < k else d
    for j in range(k):
        d = d.withColumn(f"_z{j}", (F.col(f"cy{j}") - sum((F.col(f"_l{j}_{s}") * F.col(f"_z{s}") for s in range(j)), F.lit(0.0))) / F.col(f"_l{j}_{j}"))
    for j in reversed(range(k)):
        d = d.withColumn(f"b{j}", (F.col(f"_z{j}") - sum((F.col(f"_l{s}_{j}") * F.col(f"b{s}") for s in range(j + 1, k)), F.lit(0.0)))
                         / F.col(f"_l{j}_{j}"))
    return d


def fit_multi_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 5.0,
                    anchors: bool = True) -> DataFrame:
    """E02 — ridge with unpenalised intercept on data and anchors, one row: intercept, beta_<feature>...,
    background means mean_<feature>..., n. Without a row of data all but n = 0 are NULL or 0."""
    k = len(features)
    data = ridge_moments(train, features, target)
    means = data.select(*[F.coalesce(f"m{j}", F.lit(0.0)).alias(f"mean_{f}") for j, f in enumerate(features)])
    fit = solved(with_anchors(data, k) if anchors else data, k, alpha)
    icpt = F.col("my") - sum((F.col(f"b{j}") * F.col(f"m{j}") for j in range(k)), F.lit(0.0))
    return fit.select(icpt.alias("intercept"), *[F.col(f"b{j}").alias(f"beta_{f}") for j, f in enumerate(features)], "n").crossJoin(
        F.broadcast(means)).select("intercept", *[f"beta_{f}" for f in features], *[f"mean_{f}" for f in features], "n")  # 1 x 1 rows


def attribute(df: DataFrame, coefs: DataFrame, features: Sequence[str]) -> DataFrame:
    """E03/E08 — per row: prediction, base_value and shap_<feature> = beta_j (x_j - mean_j)
    (features sanitised first). ``coefs`` is the 1-row table from ``fit_multi_ridge`` (broadcast)."""
    d = df.crossJoin(F.broadcast(coefs))
    x = {f: sanitize(f) for f in features}
    pred = F.col("intercept")
    base = F.col("intercept")
    cols = []
    for f in features:
        pred = pred + F.col(f"beta_{f}") * x[f]
        base = base + F.col(f"beta_{f}") * F.col(f"mean_{f}")
        cols.append((F.col(f"beta_{f}") * (x[f] - F.col(f"mean_{f}"))).alias(f"shap_{f}"))
    keep = [c for c in df.columns]
    return d.select(*keep, pred.alias("prediction"), base.alias("base_value"), *cols)


def contributions(features: Sequence[str], value_prefix: str = "", shap_prefix: str = "shap_") -> Column:
    """E04 — array<struct(name, value, shap, direction, abs_impact, pos)> sorted by |shap| desc
    (ties keep feature order); zero counts as 'down'."""
    items = [F.struct(F.lit(f).alias("name"), sanitize(value_prefix + f).alias("value"),
                      F.col(shap_prefix + f).alias("shap"),
                      F.when(F.col(shap_prefix + f) > 0, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
                      F.abs(F.col(shap_prefix + f)).alias("abs_impact"), F.lit(i).alias("pos"))
             for i, f in enumerate(features)]
    return F.array_sort(F.array(*items), lambda a, b: F.when(a["abs_impact"] > b["abs_impact"], F.lit(-1))
                        .when(a["abs_impact"] < b["abs_impact"], F.lit(1))
                        .when(a["pos"] < b["pos"], F.lit(-1)).when(a["pos"] > b["pos"], F.lit(1))
                        .otherwise(F.lit(0)))


def top_drivers(contribs: Column, n_top: int = 5, min_impact: float = 0.5) -> Column:
    """E05 — contributions with |shap| >= min_impact, first n."""
    return F.slice(F.filter(contribs, lambda c: c["abs_impact"] >= min_impact), 1, n_top)


def _fmt0(x: Column) -> Column:
    """Python '{:.0f}' (half-even, '-0' kept for small negatives)."""
    r = F.bround(x, 0)
    s = F.format_string("%.0f", r)
    return F.when((x < 0) & (r == 0), F.lit("-0")).otherwise(s)


def attribution_text(prediction: Column, base: Column, contribs: Column, n_top: int = 5,
                     min_impact: float = 1.0, include_base: bool = True) -> Column:
    """E06 — '185 tickets (base 100 Wiki +15 Trends -8)' or '... (insufficient signal to decompose)'."""
    drivers = top_drivers(contribs, n_top, min_impact)
    parts = F.transform(drivers, lambda d: F.concat(
        F.initcap(F.regexp_replace(d["name"], "_", " ")), F.lit(" "),
        F.when(d["shap"] > 0, F.concat(F.lit("+"), _fmt0(d["shap"]))).otherwise(_fmt0(d["shap"]))))
    txt = F.array_join(parts, " ")
    head = _fmt0(prediction)
    inner = F.concat(F.lit("base "), _fmt0(base), F.lit(" "), txt) if include_base else txt
    return F.when(F.size(drivers) == 0, F.concat(head, F.lit(" tickets (insufficient signal to decompose)"))) \
            .otherwise(F.concat(head, F.lit(" tickets ("), inner, F.lit(")")))


def attribution_table(df: DataFrame, key: str, contribs: str = "contributions", n_features: int = 5) -> DataFrame:
    """E07 — long rows (key, rank, feature, value, contribution, direction) for the first n."""
    return (df.select(key, F.posexplode(F.slice(F.col(contribs), 1, n_features)).alias("p", "c"))
            .select(key, (F.col("p") + 1).alias("rank"), F.initcap(F.col("c.name")).alias("feature"),
                    F.col("c.value").alias("value"), F.col("c.shap").alias("contribution"),
                    F.upper(F.col("c.direction")).alias("direction")))


def push_pull(contribs: Column, max_features: int = 5, min_impact: float = 0.5) -> Column:
    """E09 — struct(positive desc, negative asc, total_positive, total_negative)."""
    d = top_drivers(contribs, max_features, min_impact)
    pos = F.filter(d, lambda c: c["shap"] > 0)
    neg = F.filter(d, lambda c: c["shap"] < 0)
    pos_s = F.array_sort(F.transform(pos, lambda c: F.struct(c["shap"].alias("contribution"), c["name"].alias("feature"))),
                         lambda a, b: F.when(a["contribution"] > b["contribution"], F.lit(-1))
                         .when(a["contribution"] < b["contribution"], F.lit(1)).otherwise(F.lit(0)))
    neg_s = F.array_sort(F.transform(neg, lambda c: F.struct(c["shap"].alias("contribution"), c["name"].alias("feature"))))
    return F.struct(pos_s.alias("positive"), neg_s.alias("negative"),
                    F.aggregate(pos, F.lit(0.0), lambda acc, c: acc + c["shap"]).alias("total_positive"),
                    F.aggregate(neg, F.lit(0.0), lambda acc, c: acc + c["shap"]).alias("total_negative"))


# FIXED VALUES — feature-name substrings -> driver phrases (first match wins)
DRIVER_PHRASES = [
    (("familiarity", "wiki"), "strong public recognition signals"),
    (("motivation", "youtube"), "elevated engagement indicators"),
    (("season", "month"), "favorable seasonal positioning"),
    (("remount", "years_since"), "remount timing dynamics"),
    (("category",), "category-specific historical patterns"),
    (("prior", "median"), "strong historical precedent"),
]


def _phrase(name: Column) -> Column:
    n = F.lower(name)
    out = F.lower(F.regexp_replace(name, "_", " "))
    for keys, phrase in reversed(DRIVER_PHRASES):
        cond = F.lit(False)
        for k in keys:
            cond = cond | n.contains(k)
        out = F.when(cond, F.lit(phrase)).otherwise(out)
    return out


def _format_list(arr: Column) -> Column:
    n = F.size(arr)
    return (F.when(n == 0, F.lit(""))
            .when(n == 1, F.element_at(arr, 1))
            .when(n == 2, F.concat(F.element_at(arr, 1), F.lit(" and "), F.element_at(arr, 2)))
            .otherwise(F.concat(F.array_join(F.slice(arr, 1, n - 1), ", "), F.lit(", and "), F.element_at(arr, -1))))


# FIXED VALUES — sentences of the driver text and of the fallback phrases
UP_TEXT = ("Key upward drivers include ", ", which collectively elevate the forecast by approximately ", " index points.")
DOWN_TEXT = ("Offsetting factors include ", ", which moderate expectations by roughly ", " index points.")
BALANCED_TEXT = "Feature contributions are relatively balanced, with no single factor dominating the prediction."
FALLBACK_PHRASES = ("elevated public recognition", "strong engagement signals", "favorable seasonal timing",
                    "renewed interest after an appropriate interval")


def driver_sentence(contribs: Column) -> Column:
    """E10 — top 5 by |shap|; upward/downward phrases (unique, at most 3) with point totals."""
    top = F.slice(contribs, 1, 5)
    pos = F.filter(top, lambda c: c["shap"] > 0)
    neg = F.filter(top, lambda c: c["shap"] < 0)
    pdesc = _format_list(F.slice(F.array_distinct(F.transform(pos, lambda c: _phrase(c["name"]))), 1, 3))
    ndesc = _format_list(F.slice(F.array_distinct(F.transform(neg, lambda c: _phrase(c["name"]))), 1, 3))
    psum = F.aggregate(pos, F.lit(0.0), lambda a, c: a + c["shap"])
    nsum = F.aggregate(neg, F.lit(0.0), lambda a, c: a + c["shap"])

    def side(found: Column, text: tuple[str, str, str], described: Column, total: Column) -> Column:
        return F.when(F.size(found) > 0, F.concat(F.lit(text[0]), described, F.lit(text[1]),
                                                  F.format_string("%.1f", F.bround(total, 1)), F.lit(text[2])))
    both = F.concat_ws(" ", side(pos, UP_TEXT, pdesc, psum), side(neg, DOWN_TEXT, ndesc, F.abs(nsum)))
    return F.when(both == "", F.lit(BALANCED_TEXT)).otherwise(both)


def mean_abs_attribution(df: DataFrame, features: Sequence[str], top: int = 8, shap_prefix: str = "shap_") -> DataFrame:
    """A17 — mean |attribution| per feature, largest first, top n (one aggregation, then a
    bounded k-row result)."""
    one = df.agg(*[F.avg(F.abs(F.col(shap_prefix + f))).alias(f) for f in features])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs"))
                                          for f in features])).alias("r")).select("r.*")
    return long.orderBy(F.col("mean_abs").desc(), F.col("feature")).limit(top)


# FIXED VALUES — narrative category labels
CATEGORY_LABELS = {"family_classic": "family-oriented classical", "adult_classic": "adult classical",
                   "contemporary": "contemporary", "holiday": "holiday-themed", "mixed_rep": "mixed repertoire"}


def _f1(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x.cast("double"), 1))


def narrative(title: Column, month: Column, category: Column, familiarity: Column, motivation: Column,
              signal: Column, ticket_index: Column, seasonality: Column, primary: Column, secondary: Column,
              city_tickets: Column, intent_ratio: Column | None = None, years_since: Column | None = None,
              drivers: Column | None = None) -> Column:
    """E11 — five conditional paragraphs as one string column (positioning, history/intent,
    season, drivers, demand tier with city tickets and audience), joined by spaces.
    ``city_tickets`` is array<struct(city, tickets)>; ``drivers`` an E10 sentence."""
    from stagecast.functions.columns import demand_tier, signal_level
    cat_label = F.coalesce(F.element_at(F.create_map(*[x for k, v in CATEGORY_LABELS.items()
                                                      for x in (F.lit(k), F.lit(v))]), F.lower(category)), category)
    strength = (F.when(signal > 100, F.lit("strong")).when(signal > 70, F.lit("moderate")).otherwise(F.lit("emerging")))
    p1 = F.concat(month, F.lit(" — "), title, F.lit(" ("), category, F.lit("). "),
                  F.when(familiarity.isNotNull() & motivation.isNotNull(), F.concat(
                      F.lit("Familiarity is "), _f1(familiarity), F.lit(" ("), signal_level(familiarity),
                      F.lit(") and Motivation is "), _f1(motivation), F.lit(" ("), signal_level(motivation),
                      F.lit("), a "), strength, F.lit(" level of public visibility across the four digital signals.")))
                  .otherwise(F.lit("The forecast rests on a combined interest signal benchmarked across digital platforms.")))
    intent = F.lit(None).cast("string")
    if intent_ratio is not None:
        pct = F.concat(_f1(intent_ratio * 100.0), F.lit("%"))
        intent = (F.when(intent_ratio.isNull(), F.lit(None).cast("string"))
                  .when(intent_ratio < 0.05, F.concat(F.lit("Only "), pct, F.lit(" of search interest looks like performance intent, so visibility may be inflated by unrelated references.")))
                  .when(intent_ratio > 0.30, F.concat(F.lit("An intent ratio of "), pct, F.lit(" shows search interest closely tied to ticket buying.")))
                  .otherwise(F.concat(F.lit("An intent ratio of "), pct, F.lit(" indicates mixed digital intent."))))
    ys = F.floor(years_since).cast("int") if years_since is not None else F.lit(None).cast("int")
    hist = (F.when(ys > 0, F.concat(F.lit("This is a return engagement, last staged about "), ys.cast("string"),
                                    F.when(ys == 1, F.lit(" year")).otherwise(F.lit(" years")), F.lit(" ago; "),
                                    cat_label, F.lit(" titles "),
                                    F.when(ys >= 3, F.lit("usually gain from recognition on return."))
                                    .otherwise(F.lit("often soften when remounted quickly."))))
            .when(ys.isNotNull(), F.concat(F.lit("This is a return engagement; familiarity effects follow earlier "),
                                           cat_label, F.lit(" remounts.")))
            .otherwise(F.concat(F.lit("Without local history the title is judged against comparable "), cat_label,
                                F.lit(" productions."))))
    p2 = F.concat_ws(" ", intent, hist)
    mname = F.split(month, " ")[0]
    p3 = (F.when(seasonality.isNull(), F.lit(None).cast("string"))
          .when(seasonality > 1.05, F.concat(F.lit("The "), mname, F.lit(" slot carries a favourable seasonal factor of "),
                                             F.format_string("%.2f", F.bround(seasonality, 2)), F.lit(".")))
          .when(seasonality < 0.95, F.concat(F.lit("The "), mname, F.lit(" slot applies a softer seasonal factor of "),
                                             F.format_string("%.2f", F.bround(seasonality, 2)), F.lit(".")))
          .otherwise(F.concat(F.lit("The "), mname, F.lit(" slot is close to seasonally neutral ("),
                              F.format_string("%.2f", F.bround(seasonality, 2)), F.lit(")."))))
    reasons = (familiarity > 110, motivation > 110, seasonality > 1.05, ys >= 3)
    fallback = F.filter(F.array(*[F.when(r, F.lit(x)) for r, x in zip(reasons, FALLBACK_PHRASES)]), lambda x: x.isNotNull())
    pos = F.when(ticket_index > 100, F.lit("above")).when(ticket_index >= 95, F.lit("at")).otherwise(F.lit("below"))
    p4_fb = F.when(F.size(fallback) > 0, F.concat(F.lit("The estimate is shaped mainly by "), _format_list(fallback),
                                                  F.lit(", placing the title "), pos, F.lit(" the benchmark."))) \
        .otherwise(F.concat(F.lit("The combined signal places the title at a Ticket Index of "), _f1(ticket_index), F.lit(".")))
    p4 = F.coalesce(drivers, p4_fb) if drivers is not None else p4_fb
    total = F.aggregate(city_tickets, F.lit(0.0), lambda a, c: a + F.coalesce(c["tickets"], F.lit(0.0)))
    cities = F.array_join(F.transform(city_tickets, lambda c: F.concat(F.format_number(c["tickets"], 0), F.lit(" in "), c["city"])), ", ")
    p5 = F.concat_ws(" ",
                     F.concat(F.lit("A Ticket Index of "), _f1(ticket_index), F.lit(" puts it in the "), demand_tier(ticket_index),
                              F.lit(" tier.")),
                     F.when(total > 0, F.concat(F.lit("Expected single tickets: "), cities, F.lit(" ("),
                                                F.format_number(total, 0), F.lit(" in total)."))),
                     F.when(F.length(F.trim(F.coalesce(primary, F.lit("")))) > 0,
                            F.concat(F.lit("The audience should lean toward "), primary,
                                     F.when(F.length(F.trim(F.coalesce(secondary, F.lit("")))) > 0,
                                            F.concat(F.lit(", with secondary appeal to "), secondary)).otherwise(F.lit("")),
                                     F.lit("."))))
    return F.concat_ws(" ", p1, p2, p3, p4, p5)
