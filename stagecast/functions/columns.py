"""Scalar column functions (P01–P17): every function returns a ``Column``.

All are built-in Spark SQL expressions (whole-stage codegen, no Python UDFs).
Rule tables (keywords, thresholds, labels) are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagecast import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# P01 -------------------------------------------------------------------------
DECIMAL = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(c, blank_as_zero: bool = True, commas: bool = True) -> Column:
    """'7,734' -> 7734.0 (with ``commas``); blank or anything but a decimal number -> 0.0 (history) or
    NULL (weights). Words such as nan or Infinity and Java suffixes (1d, 2f) are not numbers."""
    s = F.trim(_c(c).cast("string"))
    s = F.regexp_replace(s, ",", "") if commas else s
    v = F.when(s.rlike(DECIMAL), s.try_cast("double"))
    v = F.when(F.abs(v) < float("inf"), v)
    return F.coalesce(v, F.lit(0.0)) if blank_as_zero else v


# P02 -------------------------------------------------------------------------
def canon_city(c, patterns: Sequence[tuple[str, str]] = C.CITY_PATTERNS) -> Column:
    """Lower-case substring patterns -> canonical city; an exact canonical name is kept; else NULL."""
    raw = _c(c).cast("string")
    s = F.lower(F.trim(raw))
    canon = [name for _, name in patterns]
    out = F.when(raw.isin(*canon), raw)
    for pat, name in reversed(list(patterns)):
        out = F.when(s.contains(pat), F.lit(name)).otherwise(out)
    return out


# P03 -------------------------------------------------------------------------
def title_key(c, aliases: dict[str, str] | None = None) -> Column:
    """trim + alias map (default: curly -> straight apostrophe title alias)."""
    aliases = C.TITLE_ALIASES if aliases is None else aliases
    t = F.trim(_c(c).cast("string"))
    if not aliases:
        return t
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(m, t), t)


def _contains_any(s: Column, keys: Sequence[str]) -> Column:
    cond = F.lit(False)
    for k in keys:
        cond = cond | s.contains(k)
    return cond


def _contains_all(s: Column, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & s.contains(k)
    return cond


def infer_gender(c, rules=C.GENDER_RULES, default: str = C.GENDER_DEFAULT) -> Column:
    """Ordered rules (label, all_of, any_of) on the lower-cased title; first match wins."""
    s = F.lower(_c(c).cast("string"))
    out = F.lit(default)
    for label, all_of, any_of in reversed(list(rules)):
        cond = F.lit(True)
        if all_of:
            cond = cond & _contains_all(s, all_of)
        if any_of:
            cond = cond & _contains_any(s, any_of)
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def infer_category(c, rules=C.CATEGORY_RULES, default: str = C.CATEGORY_DEFAULT) -> Column:
    """Ordered (category, keywords) rules on the lower-cased title; first match wins."""
    s = F.lower(_c(c).cast("string"))
    out = F.lit(default)
    for label, keys in reversed(list(rules)):
        out = F.when(_contains_any(s, keys), F.lit(label)).otherwise(out)
    return out


# P06 -------------------------------------------------------------------------
def infer_show_type(title, category, rules=C.SHOW_TYPE_RULES, default: str = C.SHOW_TYPE_DEFAULT) -> Column:
    """Title keywords or category -> show type; rules in precedence order."""
    t = F.lower(F.trim(_c(title).cast("string")))
    cat = F.lower(F.trim(F.coalesce(_c(category).cast("string"), F.lit(""))))
    out = F.lit(default)
    for label, keys, cats in reversed(list(rules)):
        cond = _contains_any(t, keys) if keys else F.lit(False)
        if cats:
            cond = cond | cat.isin(*cats)
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


# P13 -------------------------------------------------------------------------
def band(c, thresholds: Sequence[float], labels: Sequence[str], null_label: str | None = None) -> Column:
    """Descending thresholds: value >= thresholds[i] -> labels[i]; below all, NULL and NaN -> labels[-1]."""
    assert len(labels) == len(thresholds) + 1
    v = F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))
    out = F.lit(labels[-1])
    for th, lab in reversed(list(zip(thresholds, labels[:-1]))):
        out = F.when(v >= th, F.lit(lab)).otherwise(out)
    if null_label is not None:
        out = F.when(v.isNull(), F.lit(null_label)).otherwise(out)
    return out


# FIXED VALUES — band thresholds and labels
LETTER_BANDS = ([90, 75, 60, 45], ["A", "B", "C", "D", "E"])
STAR_BANDS = ([100, 75, 50, 25], ["★★★★★", "★★★★☆", "★★★☆☆", "★★☆☆☆", "★☆☆☆☆"])
STAR_EMPTY = "☆☆☆☆☆"
SIGNAL_LEVEL_BANDS = ([120, 100, 80, 60, 40],
                      ["exceptionally high", "strong", "above average", "moderate", "emerging", "limited"])
DEMAND_TIER_BANDS = ([120, 105, 95, 80, 60],
                     ["exceptional demand", "strong demand", "benchmark demand", "moderate demand",
                      "developing demand", "emerging demand"])
INTENT_LOW, INTENT_HIGH = 0.05, 0.30


def letter_score(c) -> Column:
    return band(c, *LETTER_BANDS)


def star_rating(c) -> Column:
    return band(c, *STAR_BANDS, null_label=STAR_EMPTY)


def signal_level(c) -> Column:
    return band(c, *SIGNAL_LEVEL_BANDS)


def demand_tier(c) -> Column:
    return band(c, *DEMAND_TIER_BANDS)


def intent_clarity(c) -> Column:
    v = _c(c).cast("double")
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(v < INTENT_LOW, F.lit("high ambiguity"))
            .when(v > INTENT_HIGH, F.lit("high clarity"))
            .otherwise(F.lit("mixed signal")))


# P14 -------------------------------------------------------------------------
def first_nonblank(*cols, default: str = "General Population") -> Column:
    """First non-blank (trimmed) of the columns, else the default."""
    vals = [F.nullif(F.trim(_c(x).cast("string")), F.lit("")) for x in cols]
    return F.coalesce(*vals, F.lit(default))


# P16 / P17 -------------------------------------------------------------------
def mid_date(start, end) -> Column:
    s, e = _c(start).cast("date"), _c(end).cast("date")
    return F.date_add(s, F.floor(F.datediff(e, s) / 2).cast("int"))


def holiday_flag(month_col, months=C.HOLIDAY_MONTHS) -> Column:
    """Month in Nov/Dec/Jan; NULL month -> False."""
    return F.coalesce(_c(month_col).isin(*months), F.lit(False))


def month_name(month_col) -> Column:
    """1..12 -> 'January'..; NULL -> '' (empty RunMonth)."""
    m = _c(month_col).cast("int")
    return F.coalesce(F.date_format(F.make_date(F.lit(2000), m, F.lit(1)), "MMMM"), F.lit(""))


# P09 -------------------------------------------------------------------------
def tokens(c) -> Column:
    """Lower-case [a-z0-9]+ tokens, in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(_c(c).cast("string")), F.lit(r"([a-z0-9]+)"), 1)


def title_match(candidate, query, hints: Sequence[str] = C.TITLE_MATCH_HINTS) -> Column:
    """Token overlap >= max(1, floor(n_query/2)) and a hint token among the candidate's tokens.

    Overlap counts query tokens (duplicates included) present in the candidate. As a single
    Column the candidate is tokenised inside the lambda (once per query token); for long
    texts use ``add_title_match``, which tokenises once per row.
    """
    vt, qt = tokens(candidate), tokens(query)
    overlap = F.size(F.filter(qt, lambda t: F.array_contains(vt, t)))
    need = F.greatest(F.lit(1), F.floor(F.size(qt) / 2))
    hint = F.arrays_overlap(vt, F.array(*[F.lit(h) for h in hints])) if hints else F.lit(False)
    nonempty = (F.size(vt) > 0) & (F.size(qt) > 0)
    return nonempty & (overlap >= need) & F.coalesce(hint, F.lit(False))


def add_title_match(df, candidate: str, query: str, out: str = "matched",
                    hints: Sequence[str] = C.TITLE_MATCH_HINTS):
    """P09 as a DataFrame step: tokens become columns first (one regex pass per text per
    row), then the overlap test runs over the token columns."""
    d = df.withColumn("_vt", tokens(candidate)).withColumn("_qt", tokens(query))
    vt, qt = F.col("_vt"), F.col("_qt")
    overlap = F.size(F.filter(qt, lambda t: F.array_contains(vt, t)))
    need = F.greatest(F.lit(1), F.floor(F.size(qt) / 2))
    hint = F.arrays_overlap(vt, F.array(*[F.lit(h) for h in hints])) if hints else F.lit(False)
    m = (F.size(vt) > 0) & (F.size(qt) > 0) & (overlap >= need) & F.coalesce(hint, F.lit(False))
    return d.withColumn(out, m).drop("_vt", "_qt")
