"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written from the operator definitions, not from the Spark code. The binding
of driver tables to roles is expressed once here as SQL CTE text and reused
by every oracle.
"""

from __future__ import annotations

# ---------------------------------------------------------------- binding CTEs
B_SALES = """
sales AS (
  SELECT l.l_partkey AS title, CASE WHEN r.r_name IN ('AMERICA', 'AFRICA') THEN 'AMERICA' ELSE 'EUROPE' END AS city,
         c.c_mktsegment AS segment,
         CAST(l.l_shipdate AS DATE) AS start_date, l.l_quantity AS single_tickets,
         l.l_extendedprice * (1 - l.l_discount) AS revenue
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

B_HIST = B_SALES + """,
hist AS (SELECT * FROM sales)"""

# for F10 and J10 alone: every fifth title without history
B_HIST_HIDDEN = B_SALES + """,
hist AS (SELECT * FROM sales WHERE title % 5 <> 0)"""

B_TITLES = """
titles AS (
  SELECT p_partkey AS title, p_name AS name, p_type AS category,
         CASE p_size % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'co' ELSE 'na' END AS gender
  FROM part
)"""

B_SIGNALS = """
signals AS (
  SELECT l_partkey AS title,
         40 + least(110, 20 * ln(1 + count(*))) AS wiki,
         avg(l_quantity) AS trends,
         50 + least(90, 9 * ln(1 + avg(l_extendedprice) / 100)) AS youtube,
         1000 * avg(l_discount) AS chartmetric
  FROM lineitem GROUP BY l_partkey
)"""

B_BASE = B_TITLES + "," + B_SIGNALS + """,
base AS (SELECT t.*, s.wiki, s.trends, s.youtube, s.chartmetric FROM titles t JOIN signals s USING (title))"""

# anchored 60-day runs per title: next run starts at the first day more than 60 days after the current start
B_RUNS = """
hday AS (
  SELECT title, start_date AS d, sum(single_tickets) AS v
  FROM hist WHERE single_tickets > 0 AND start_date IS NOT NULL GROUP BY 1, 2
),
starts AS (
  SELECT title, min(d) AS s FROM hday GROUP BY title
  UNION ALL
  SELECT st.title, (SELECT min(h.d) FROM hday h WHERE h.title = st.title AND h.d - st.s > 60)
  FROM starts st WHERE st.s IS NOT NULL
),
runs AS (
  SELECT st.title, st.s AS run_start, max(h.d) AS run_end, sum(h.v) AS tickets, count(*) AS n_days,
         row_number() OVER (PARTITION BY st.title ORDER BY st.s) - 1 AS run_no
  FROM starts st JOIN hday h ON h.title = st.title AND h.d >= st.s AND h.d - st.s <= 60
  WHERE st.s IS NOT NULL
  GROUP BY st.title, st.s
)"""

B_PRIOR = """
prior AS (
  SELECT title, median(tickets) AS ticket_median, sum(tickets) AS prior_total_tickets,
         count(*) AS run_count_prior
  FROM runs GROUP BY title
)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


ORACLES: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


register("A01_anchored_runs", with_(B_HIST, B_RUNS) + """
SELECT title, CAST(run_no AS BIGINT) AS run_no, run_start, run_end, round(tickets, 6) AS tickets,
       CAST(n_days AS BIGINT) AS n_days
FROM runs""")

register("A02_prior_stats", with_(B_HIST, B_RUNS, B_PRIOR) + """
SELECT title, round(ticket_median, 6) AS ticket_median, round(prior_total_tickets, 6) AS prior_total_tickets,
       CAST(run_count_prior AS BIGINT) AS run_count_prior
FROM prior""")


# ---------------------------------------------------------------- scoring chain (proposed month = 3)
def _mult_values() -> str:
    """Gender j of segment i: 0.96, 1, 1.04 as (i + j) mod 3; category k: 0.9 to 1.1 by 0.05 as (i + 2k) mod 5."""
    return """mult AS (
  SELECT s AS segment, key, CAST(round(m, 4) AS DOUBLE) AS m FROM (
    SELECT s, ['female', 'male', 'co', 'na'][j + 1] AS key, [0.96, 1.0, 1.04][(i + j) % 3 + 1] AS m
    FROM segs0, range(4) t(j)
    UNION ALL
    SELECT s, ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][k + 1], [0.9, 0.95, 1.0, 1.05, 1.1][(i + 2 * k) % 5 + 1]
    FROM segs0, range(6) t(k)
  )
)"""


def _segments_values() -> str:
    return "segs AS (SELECT s AS segment, i AS pos FROM segs0)"


SCORING_SEGMENT = "AUTOMOBILE"
PROPOSED_MONTH = 3

B_SEASON = """
pr AS (
  SELECT r.title, r.run_no, r.run_start, t.category,
         CAST(month(r.run_start + CAST(floor(date_diff('day', r.run_start, r.run_end) / 2) AS INTEGER)) AS INTEGER) AS month,
         p.ticket_median AS tm
  FROM runs r JOIN titles t USING (title) JOIN prior p USING (title)
),
fence AS (
  SELECT category, quantile_cont(tm, 0.25) AS q1, quantile_cont(tm, 0.75) AS q3
  FROM pr WHERE tm IS NOT NULL GROUP BY category
),
kept AS (
  SELECT pr.* FROM pr JOIN fence USING (category)
  WHERE pr.tm >= q1 - 1.5 * (q3 - q1) AND pr.tm <= q3 + 1.5 * (q3 - q1)
),
catm AS (
  SELECT category, median(tm) AS cat_median, median(tm) FILTER (WHERE month IN (12, 1, 2)) AS winter_median
  FROM kept GROUP BY category HAVING median(tm) > 0
),
monm AS (SELECT category, month, count(*) AS n, median(tm) AS m FROM kept GROUP BY category, month),
season0 AS (
  SELECT c.category, g.month, CAST(coalesce(mm.n, 0) AS BIGINT) AS n,
         CASE WHEN coalesce(mm.n, 0) >= 1 THEN mm.m
              WHEN g.month IN (12, 1, 2) AND c.winter_median IS NOT NULL THEN c.winter_median
              ELSE c.cat_median END AS month_median,
         c.cat_median
  FROM catm c CROSS JOIN (SELECT CAST(range AS INTEGER) AS month FROM range(1, 13)) g
  LEFT JOIN monm mm ON mm.category = c.category AND mm.month = g.month
),
season AS (
  SELECT category, month, n, month_median, cat_median, month_median / cat_median AS raw_ratio,
         n / (n + 3.0) AS weight,
         least(1.15, greatest(0.90, 1 + n / (n + 3.0) * (month_median / cat_median - 1))) AS factor
  FROM season0 WHERE month_median > 0
),
lastmid AS (
  SELECT title, arg_max(run_start + CAST(floor(date_diff('day', run_start, run_end) / 2) AS INTEGER), run_start) AS mid_date
  FROM runs GROUP BY title
)"""

B_INDEX = """
est AS (
  SELECT t.*,
         least(120, greatest(30, (SELECT median(wiki) FROM signals))) AS wiki,
         least(120, greatest(30, (SELECT median(trends) FROM signals))) AS trends,
         least(140, greatest(40, (SELECT median(youtube) FROM signals))) AS youtube,
         least(120, greatest(35, (SELECT median(chartmetric) FROM signals))) AS chartmetric
  FROM titles t WHERE t.title NOT IN (SELECT title FROM signals)
),
rows0 AS (
  SELECT title, category, gender, wiki, trends, youtube, chartmetric, 'Baseline' AS "Source" FROM base
  UNION ALL
  SELECT title, category, gender, wiki, trends, youtube, chartmetric, 'Estimated' FROM est
),
raw AS (
  SELECT r.*,
         (0.55 * wiki + 0.30 * trends + 0.15 * chartmetric) * coalesce(mg.m, 1.0) * coalesce(mc.m, 1.0) AS "FamiliarityRaw",
         (0.45 * youtube + 0.25 * trends + 0.15 * chartmetric + 0.15 * wiki) * coalesce(mg.m, 1.0) * coalesce(mc.m, 1.0) AS "MotivationRaw"
  FROM rows0 r
  LEFT JOIN mult mg ON mg.segment = '__SEG__' AND mg.key = r.gender
  LEFT JOIN mult mc ON mc.segment = '__SEG__' AND mc.key = r.category
),
bench AS (
  SELECT r.*, p.ticket_median AS bench_median,
         coalesce(s.factor, 1.0) AS bench_hist_factor
  FROM raw r
  LEFT JOIN prior p USING (title)
  LEFT JOIN lastmid lm USING (title)
  LEFT JOIN season s ON s.category = r.category AND s.month = month(lm.mid_date)
  WHERE r.title = (SELECT min(title) FROM prior)
),
benchk AS (
  SELECT coalesce(nullif("FamiliarityRaw", 0), 1.0) AS bf, coalesce(nullif("MotivationRaw", 0), 1.0) AS bm,
         coalesce(nullif(bench_median, 0), 1.0) / coalesce(nullif(bench_hist_factor, 0), 1.0) AS bds,
         gender AS bgender, category AS bcategory,
         0.55 * wiki + 0.30 * trends + 0.15 * chartmetric AS bfam0,
         0.45 * youtube + 0.25 * trends + 0.15 * chartmetric + 0.15 * wiki AS bmot0
  FROM bench
),
indexed AS (
  SELECT r.*, r."FamiliarityRaw" / b.bf * 100 AS "Familiarity", r."MotivationRaw" / b.bm * 100 AS "Motivation",
         (r."FamiliarityRaw" / b.bf * 100 + r."MotivationRaw" / b.bm * 100) / 2 AS "SignalOnly",
         p.ticket_median AS "TicketMedian", p.prior_total_tickets, CAST(coalesce(p.run_count_prior, 0) AS BIGINT) AS run_count_prior,
         CASE WHEN p.ticket_median IS NOT NULL THEN coalesce(s.factor, 1.0) END AS "HistSeasonalityFactor",
         CASE WHEN p.ticket_median IS NOT NULL
              THEN (p.ticket_median / coalesce(nullif(coalesce(s.factor, 1.0), 0), 1.0)) / b.bds * 100 END AS "TicketIndex_DeSeason",
         b.bds AS "BenchMedianDeSeason"
  FROM raw r CROSS JOIN benchk b
  LEFT JOIN prior p USING (title)
  LEFT JOIN lastmid lm USING (title)
  LEFT JOIN season s ON s.category = r.category AND s.month = month(lm.mid_date)
)"""

B_MODELS = """
known AS (SELECT * FROM indexed WHERE "TicketIndex_DeSeason" IS NOT NULL),
kn AS (SELECT count(*) AS n FROM known),
ov_data AS (
  SELECT "SignalOnly" AS x, "TicketIndex_DeSeason" AS y FROM known
  UNION ALL SELECT 0.0, 25.0 FROM (SELECT unnest(range(greatest(3, n // 2))) FROM kn)
  UNION ALL SELECT 100.0, 100.0 FROM (SELECT unnest(range(greatest(3, n // 2))) FROM kn)
),
overall AS (
  SELECT (SELECT n FROM kn) AS n,
         regr_sxy(y, x) / (regr_sxx(y, x) + 5.0) AS slope,
         avg(y) - regr_sxy(y, x) / (regr_sxx(y, x) + 5.0) * avg(x) AS intercept
  FROM ov_data HAVING (SELECT n FROM kn) >= 5
),
catfit AS (
  SELECT category, count(*) AS n, avg("SignalOnly") AS mx, avg("TicketIndex_DeSeason") AS my,
         regr_sxx("TicketIndex_DeSeason", "SignalOnly") AS sxx, regr_sxy("TicketIndex_DeSeason", "SignalOnly") AS sxy
  FROM known GROUP BY category HAVING count(*) >= 3
),
catmod AS (
  SELECT category, CAST(n AS BIGINT) AS n,
         CASE WHEN sxx + (CASE WHEN n >= 5 THEN 1.0 ELSE 0.0 END) > 0
              THEN sxy / (sxx + (CASE WHEN n >= 5 THEN 1.0 ELSE 0.0 END)) ELSE 0.0 END AS slope
  FROM catfit
),
catmodel AS (SELECT m.category, m.n, m.slope, f.my - m.slope * f.mx AS intercept FROM catmod m JOIN catfit f USING (category)),
imputed0 AS (
  SELECT i.*,
         CASE WHEN i."TicketIndex_DeSeason" IS NOT NULL OR i."SignalOnly" IS NULL THEN NULL
              WHEN c.category IS NOT NULL THEN least(180, greatest(20, c.intercept + c.slope * i."SignalOnly"))
              WHEN o.slope IS NOT NULL THEN least(180, greatest(20, o.intercept + o.slope * i."SignalOnly")) END AS "TicketIndex_Predicted",
         CASE WHEN i."TicketIndex_DeSeason" IS NOT NULL THEN 'History'
              WHEN i."SignalOnly" IS NULL THEN 'Not enough data'
              WHEN c.category IS NOT NULL THEN 'ML Category'
              WHEN o.slope IS NOT NULL THEN 'ML Overall' ELSE 'Not enough data' END AS "TicketIndexSource"
  FROM indexed i LEFT JOIN catmodel c ON c.category = i.category LEFT JOIN overall o ON TRUE
),
imputed1 AS (
  SELECT i.*, coalesce(i."TicketIndex_DeSeason", i."TicketIndex_Predicted") AS "TicketIndex_DeSeason_Used",
         coalesce(s.factor, 1.0) AS "FutureSeasonalityFactor"
  FROM imputed0 i LEFT JOIN season s ON s.category = i.category AND s.month = __MONTH__
),
imputed AS (
  SELECT *, "TicketIndex_DeSeason_Used" * "FutureSeasonalityFactor" AS "EffectiveTicketIndex",
         0.5 * "SignalOnly" + 0.5 * CASE WHEN "TicketIndexSource" = 'Not enough data' THEN "SignalOnly"
                                         ELSE "TicketIndex_DeSeason_Used" * "FutureSeasonalityFactor" END AS "Composite",
         round_even("TicketIndex_DeSeason_Used" * "FutureSeasonalityFactor" / 100 * "BenchMedianDeSeason", 0) AS "EstimatedTickets",
         round_even(coalesce(round_even("TicketIndex_DeSeason_Used" * "FutureSeasonalityFactor" / 100 * "BenchMedianDeSeason", 0), 0) * 1.0, 0) AS "EstimatedTickets_Final"
  FROM imputed1
)"""

B_SEGMENTS = """
hcat AS (SELECT h.*, t.category FROM hist h JOIN titles t USING (title)),
prv AS (
  SELECT city AS region, category, segment, sum(revenue) AS rv FROM hcat GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'Province', category, segment, sum(revenue) FROM hcat GROUP BY 2, 3
),
priors AS (SELECT region, category, segment, rv / sum(rv) OVER (PARTITION BY region, category) * 5 AS weight FROM prv),
segrows AS (
  SELECT i.title, i.category, i.gender, s.segment, s.pos, i."EstimatedTickets",
         (0.55 * coalesce(i.wiki, 0) + 0.30 * coalesce(i.trends, 0) + 0.15 * coalesce(i.chartmetric, 0))
            * coalesce(mg.m, 1.0) * coalesce(mc.m, 1.0) AS fam,
         (0.45 * coalesce(i.youtube, 0) + 0.25 * coalesce(i.trends, 0) + 0.15 * coalesce(i.chartmetric, 0) + 0.15 * coalesce(i.wiki, 0))
            * coalesce(mg.m, 1.0) * coalesce(mc.m, 1.0) AS mot,
         b.bfam0 * coalesce(bg.m, 1.0) * coalesce(bc.m, 1.0) AS bfam,
         b.bmot0 * coalesce(bg.m, 1.0) * coalesce(bc.m, 1.0) AS bmot,
         coalesce(p.weight, 1.0) AS prior_w
  FROM imputed i CROSS JOIN segs s CROSS JOIN benchk b
  LEFT JOIN mult mg ON mg.segment = s.segment AND mg.key = i.gender
  LEFT JOIN mult mc ON mc.segment = s.segment AND mc.key = i.category
  LEFT JOIN mult bg ON bg.segment = s.segment AND bg.key = b.bgender
  LEFT JOIN mult bc ON bc.segment = s.segment AND bc.key = b.bcategory
  LEFT JOIN priors p ON p.region = 'Province' AND p.category = i.category AND p.segment = s.segment
),
segidx AS (
  SELECT *, (fam / coalesce(nullif(bfam, 0), 1.0) * 100 + mot / coalesce(nullif(bmot, 0), 1.0) * 100) / 2 AS idx
  FROM segrows
),
segc AS (SELECT *, greatest(1e-9, prior_w * idx) AS c FROM segidx),
segshare AS (
  SELECT title, segment, pos, c / coalesce(nullif(sum(c) OVER (PARTITION BY title), 0), 1.0) AS share,
         "EstimatedTickets", idx
  FROM segc
),
segmix AS (
  SELECT title, segment, pos, share, round_even(coalesce("EstimatedTickets", 0) * share, 0) AS tickets,
         row_number() OVER (PARTITION BY title ORDER BY share DESC, pos) AS rank, idx
  FROM segshare
),
ctot AS (SELECT title, city, sum(single_tickets) AS tickets FROM hist WHERE single_tickets >= 0 GROUP BY 1, 2),
cwide AS (
  SELECT title, coalesce(sum(tickets) FILTER (WHERE city = 'AMERICA'), 0) AS a,
         coalesce(sum(tickets) FILTER (WHERE city = 'EUROPE'), 0) AS e
  FROM ctot GROUP BY title
),
tshare AS (
  SELECT title, least(0.85, greatest(0.15, a / (a + e))) AS ca, least(0.85, greatest(0.15, e / (a + e))) AS ce, a + e AS total
  FROM cwide WHERE a + e > 0
),
catwide AS (SELECT t.category, sum(a) AS a, sum(e) AS e FROM cwide JOIN titles t USING (title) GROUP BY 1),
cshare AS (
  SELECT category, least(0.85, greatest(0.15, a / (a + e))) AS ca, least(0.85, greatest(0.15, e / (a + e))) AS ce
  FROM catwide WHERE a + e > 0
),
split AS (
  SELECT i.title,
         CASE WHEN ts.title IS NOT NULL THEN ts.ca / (ts.ca + ts.ce) WHEN cs.category IS NOT NULL THEN cs.ca / (cs.ca + cs.ce) ELSE 0.6 END AS sa,
         CASE WHEN ts.title IS NOT NULL THEN ts.ce / (ts.ca + ts.ce) WHEN cs.category IS NOT NULL THEN cs.ce / (cs.ca + cs.ce) ELSE 0.4 END AS se,
         CASE WHEN ts.title IS NOT NULL THEN 'title' WHEN cs.category IS NOT NULL THEN 'category' ELSE 'default' END AS split_source,
         i."EstimatedTickets_Final"
  FROM imputed i LEFT JOIN tshare ts USING (title) LEFT JOIN cshare cs ON cs.category = i.category
),
cityalloc AS (
  SELECT title, 'AMERICA' AS city, sa / (sa + se) AS share, round_even(coalesce("EstimatedTickets_Final", 0) * sa / (sa + se), 0) AS tickets, split_source FROM split
  UNION ALL
  SELECT title, 'EUROPE', se / (sa + se), round_even(coalesce("EstimatedTickets_Final", 0) * se / (sa + se), 0), split_source FROM split
)"""


def scoring_ctes(*names: str, hist: str = B_HIST) -> str:
    parts = {
        "hist": hist, "titles": B_TITLES, "base": B_SIGNALS + "," + """
base AS (SELECT t.*, s.wiki, s.trends, s.youtube, s.chartmetric FROM titles t JOIN signals s USING (title))""",
        "runs": B_RUNS, "prior": B_PRIOR, "season": B_SEASON,
        "mult": "segs0(s, i) AS (VALUES ('AUTOMOBILE', 0), ('BUILDING', 1), ('FURNITURE', 2), ('HOUSEHOLD', 3), ('MACHINERY', 4)),\n"
                + _mult_values(), "segs": _segments_values(),
        "index": B_INDEX.replace("__SEG__", SCORING_SEGMENT),
        "models": B_MODELS.replace("__MONTH__", str(PROPOSED_MONTH)),
        "segments": B_SEGMENTS,
    }
    order = ["hist", "titles", "base", "runs", "prior", "season", "mult", "segs", "index", "models", "segments"]
    upto = max(order.index(n) for n in names)
    return with_(*[parts[n] for n in order[:upto + 1]])


register("A05_iqr_filter", scoring_ctes("season") + """
SELECT title, CAST(run_no AS BIGINT) AS run_no, category, month, round(tm, 6) AS ticket_median FROM kept""")

register("A06_trimmed_median", scoring_ctes("season") + """
SELECT category, round(median(tm), 6) AS trimmed_median, count(*) AS n FROM kept GROUP BY category""")

register("A07_seasonality_table", scoring_ctes("season") + """
SELECT category, month, n, round(month_median, 6) AS month_median, round(cat_median, 6) AS cat_median,
       round(raw_ratio, 6) AS raw_ratio, round(weight, 6) AS weight, round(factor, 6) AS factor
FROM season""")

register("P16_mid_date", scoring_ctes("runs") + """
SELECT title, CAST(run_no AS BIGINT) AS run_no,
       run_start + CAST(floor(date_diff('day', run_start, run_end) / 2) AS INTEGER) AS mid_date,
       CAST(month(run_start + CAST(floor(date_diff('day', run_start, run_end) / 2) AS INTEGER)) AS INTEGER) AS month,
       CAST(year(run_start + CAST(floor(date_diff('day', run_start, run_end) / 2) AS INTEGER)) AS INTEGER) AS year
FROM runs""")

register("J14_last_mid_date", scoring_ctes("season") + """
SELECT title, mid_date FROM lastmid""")

register("J15_runs_with_category_and_median", scoring_ctes("season") + """
SELECT title, CAST(run_no AS BIGINT) AS run_no, category, round(tm, 6) AS ticket_median FROM pr""")

_BUMPED = """least(120, greatest(30, (SELECT median(wiki) FROM {0}) + CASE t.category WHEN 'PROMO' THEN 6.0 WHEN 'LARGE' THEN 40.0 ELSE 0.0 END)) AS wiki,
       least(120, greatest(30, (SELECT median(trends) FROM {0}) + CASE t.category WHEN 'SMALL' THEN 3.5 ELSE 0.0 END)) AS trends,
       least(140, greatest(40, (SELECT median(youtube) FROM {0}) + CASE t.category WHEN 'PROMO' THEN 4.0 ELSE 0.0 END)) AS youtube,
       least(120, greatest(35, (SELECT median(chartmetric) FROM {0}) + CASE t.category WHEN 'SMALL' THEN -2.0 ELSE 0.0 END)) AS chartmetric"""

register("J11_known_unknown", with_(B_BASE) + """,
ks AS (SELECT * FROM signals WHERE title % 7 <> 0),
u AS (SELECT title, 'Baseline' AS "Source", wiki, trends, youtube, chartmetric FROM base WHERE title % 7 <> 0
      UNION ALL SELECT t.title, 'Estimated', """ + _BUMPED.format("ks") + """ FROM titles t WHERE t.title NOT IN (SELECT title FROM ks))
SELECT title, "Source", round(wiki, 6) AS wiki, round(trends, 6) AS trends, round(youtube, 6) AS youtube,
       round(chartmetric, 6) AS chartmetric FROM u""")

register("P11_estimate_unknown", with_(B_BASE) + """,
u AS (SELECT t.title, """ + _BUMPED.format("signals") + """ FROM titles t)
SELECT title, round(wiki, 6) AS wiki, round(trends, 6) AS trends, round(youtube, 6) AS youtube, round(chartmetric, 6) AS chartmetric FROM u""")

register("F01_raw_scores", scoring_ctes("index") + """
SELECT title, round("FamiliarityRaw", 6) AS "FamiliarityRaw", round("MotivationRaw", 6) AS "MotivationRaw" FROM raw""")

register("J12_benchmark_cross", scoring_ctes("index") + """
SELECT r.title, b.title AS benchmark_title, round(r."FamiliarityRaw" / k.bf * 100, 6) AS "Familiarity"
FROM raw r CROSS JOIN bench b CROSS JOIN benchk k""")

register("F02_benchmark_index", scoring_ctes("index") + """
SELECT title, round("Familiarity", 6) AS "Familiarity", round("Motivation", 6) AS "Motivation" FROM indexed""")

register("F03_signal_only", scoring_ctes("index") + """
SELECT title, round("SignalOnly", 6) AS "SignalOnly" FROM indexed""")

register("J13_factor_lookup", scoring_ctes("index") + """
SELECT title, round("HistSeasonalityFactor", 6) AS "HistSeasonalityFactor" FROM indexed""")

register("F05_deseason_index", scoring_ctes("index") + """
SELECT title, round("TicketMedian", 6) AS "TicketMedian", round("HistSeasonalityFactor", 6) AS "HistSeasonalityFactor",
       round("TicketIndex_DeSeason", 6) AS "TicketIndex_DeSeason", round(prior_total_tickets, 6) AS prior_total_tickets,
       run_count_prior
FROM indexed""")

register("F06_anchored_ridge", scoring_ctes("models") + """
SELECT CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(intercept, 6) AS anchor_0, round(intercept + 100 * slope, 6) AS anchor_100 FROM overall""")

register("F07_group_fit", scoring_ctes("models") + """
SELECT category, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM catmodel""")

register("F09_fit_metrics", scoring_ctes("models") + """
SELECT count(*) AS n,
       round(avg(abs("TicketIndex_DeSeason" - (o.intercept + o.slope * "SignalOnly"))), 6) AS "MAE",
       round(sqrt(avg(("TicketIndex_DeSeason" - (o.intercept + o.slope * "SignalOnly")) ^ 2)), 6) AS "RMSE",
       round(1 - sum(("TicketIndex_DeSeason" - (o.intercept + o.slope * "SignalOnly")) ^ 2)
             / sum(("TicketIndex_DeSeason" - (SELECT avg("TicketIndex_DeSeason") FROM known)) ^ 2), 6) AS "R2"
FROM known CROSS JOIN overall o""")

register("F10_tiered_impute", scoring_ctes("models", hist=B_HIST_HIDDEN).replace("FROM indexed i LEFT JOIN catmodel", """FROM (
    SELECT * REPLACE (CASE WHEN title % 35 <> 0 THEN "SignalOnly" END AS "SignalOnly",
                      CASE WHEN title % 55 = 0 THEN 'UNSEEN' ELSE category END AS category) FROM indexed) i
  LEFT JOIN catmodel""") + """
SELECT title, round("TicketIndex_DeSeason_Used", 6) AS "TicketIndex_DeSeason_Used", "TicketIndexSource",
       round("TicketIndex_Predicted", 6) AS "TicketIndex_Predicted" FROM imputed""")

register("F11_apply_future_factor", scoring_ctes("models") + """
SELECT title, round("FutureSeasonalityFactor", 6) AS "FutureSeasonalityFactor",
       round("EffectiveTicketIndex", 6) AS "EffectiveTicketIndex" FROM imputed""")

register("F12_composite", scoring_ctes("models") + """
SELECT title, round("Composite", 6) AS "Composite" FROM imputed""")

register("F13_estimate", scoring_ctes("models") + """
SELECT title, round("EstimatedTickets", 6) AS "EstimatedTickets", round("EstimatedTickets_Final", 6) AS "EstimatedTickets_Final"
FROM imputed""")

register("F04_segment_index", scoring_ctes("segments") + """
SELECT title, segment, round(idx, 6) AS idx FROM segmix""")

register("F14_segment_shares", scoring_ctes("segments") + """
SELECT title, segment, round(share, 6) AS share, CAST(rank AS INTEGER) AS rank FROM segmix""")

register("F15_segment_tickets", scoring_ctes("segments") + """
SELECT title, segment, round(tickets, 6) AS tickets FROM segmix""")

register("A03_long_to_wide", scoring_ctes("segments") + """
SELECT title, round(a, 6) AS "AMERICA", round(e, 6) AS "EUROPE" FROM cwide""")

register("A04_title_city_shares", scoring_ctes("segments") + """
SELECT title, 'AMERICA' AS city, round(ca / (ca + ce), 6) AS share FROM tshare
UNION ALL SELECT title, 'EUROPE', round(ce / (ca + ce), 6) FROM tshare""")

register("A04_category_city_shares", scoring_ctes("segments") + """
SELECT category, 'AMERICA' AS city, round(ca / (ca + ce), 6) AS share FROM cshare
UNION ALL SELECT category, 'EUROPE', round(ce / (ca + ce), 6) FROM cshare""")

register("J10_share_fallback", scoring_ctes("segments", hist=B_HIST_HIDDEN) + """
SELECT title, city, round(share, 6) AS share, split_source FROM cityalloc""")

register("F17_city_allocation", scoring_ctes("segments") + """
SELECT title, city, round(share, 6) AS share, round(tickets, 6) AS tickets FROM cityalloc""")

register("X11_two_stage_split", scoring_ctes("segments") + """
SELECT s.title, s.segment, c.city, round(round_even(s.tickets * c.share, 0), 6) AS tickets
FROM segmix s JOIN cityalloc c USING (title)""")

register("FLAGSHIP_score_titles", scoring_ctes("segments") + """
SELECT i.title, i.category, i.gender, i."Source",
       round(i."FamiliarityRaw", 6) AS "FamiliarityRaw", round(i."MotivationRaw", 6) AS "MotivationRaw",
       round(i."Familiarity", 6) AS "Familiarity", round(i."Motivation", 6) AS "Motivation",
       round(i."SignalOnly", 6) AS "SignalOnly", round(i."TicketMedian", 6) AS "TicketMedian",
       round(i."HistSeasonalityFactor", 6) AS "HistSeasonalityFactor",
       round(i."TicketIndex_DeSeason", 6) AS "TicketIndex_DeSeason",
       round(i.prior_total_tickets, 6) AS prior_total_tickets, i.run_count_prior,
       round(i."TicketIndex_DeSeason_Used", 6) AS "TicketIndex_DeSeason_Used", i."TicketIndexSource",
       round(i."TicketIndex_Predicted", 6) AS "TicketIndex_Predicted",
       round(i."FutureSeasonalityFactor", 6) AS "FutureSeasonalityFactor",
       round(i."EffectiveTicketIndex", 6) AS "EffectiveTicketIndex", round(i."Composite", 6) AS "Composite",
       round(i."EstimatedTickets", 6) AS "EstimatedTickets", round(i."EstimatedTickets_Final", 6) AS "EstimatedTickets_Final",
       s1.segment AS "PredictedPrimarySegment", s2.segment AS "PredictedSecondarySegment",
       round(ca.tickets, 6) AS "tickets_AMERICA", round(ce.tickets, 6) AS "tickets_EUROPE"
FROM imputed i
JOIN segmix s1 ON s1.title = i.title AND s1.rank = 1
JOIN segmix s2 ON s2.title = i.title AND s2.rank = 2
JOIN cityalloc ca ON ca.title = i.title AND ca.city = 'AMERICA'
JOIN cityalloc ce ON ce.title = i.title AND ce.city = 'EUROPE'""")


# ---------------------------------------------------------------- scalar functions, text rules, sources
register("P01_parse_number", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 5 THEN 0.0 ELSE round(l_extendedprice, 6) END AS price FROM lineitem""")

register("P02_canon_city", """
SELECT CASE WHEN lower(trim(r.r_name)) LIKE '%amer%' THEN 'AMERICA'
            WHEN lower(trim(r.r_name)) LIKE '%eur%' THEN 'EUROPE'
            WHEN r.r_name IN ('AMERICA', 'EUROPE') THEN r.r_name END AS city,
       count(*) AS customers
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY 1""")

register("P03_title_key", """
SELECT p_partkey AS title,
       CASE trim(p_name) WHEN 'small ring' THEN 'ring (small)' WHEN 'red widget' THEN 'widget (red)' ELSE trim(p_name) END AS title_key
FROM part""")

_P05_CAT = """CASE WHEN lower(p_name) LIKE '%small%' OR lower(p_name) LIKE '%new%' THEN 'family_classic'
            WHEN lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%blue%' THEN 'classic_romance'
            WHEN lower(p_name) LIKE '%hot%' THEN 'romantic_tragedy'
            WHEN lower(p_name) LIKE '%cold%' THEN 'contemporary' ELSE 'dramatic' END"""

register("P05_infer_gender_and_category", f"""
SELECT p_partkey AS title,
       CASE WHEN lower(p_name) LIKE '%hot%' AND lower(p_name) LIKE '%rod%' THEN 'co'
            WHEN lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%plate%' OR lower(p_name) LIKE '%gizmo%' THEN 'female'
            WHEN lower(p_name) LIKE '%bolt%' OR lower(p_name) LIKE '%anvil%' OR lower(p_name) LIKE '%gear%' THEN 'male'
            ELSE 'na' END AS gender,
       {_P05_CAT} AS category
FROM part""")

register("P06_infer_show_type", f"""
SELECT title, CASE WHEN category = 'family_classic' THEN 'family_ballet'
                   WHEN category IN ('classic_romance', 'classic_comedy', 'romantic_tragedy') THEN 'classical_ballet'
                   WHEN category IN ('adult_literary_drama', 'contemporary', 'pop_ip', 'dramatic') THEN 'contemporary_show'
                   ELSE 'unknown' END AS show_type
FROM (SELECT p_partkey AS title, {_P05_CAT} AS category FROM part)""")

register("P07_log_index", """
SELECT l_partkey AS title, round(40 + least(110, 20 * ln(1 + count(*))), 6) AS wiki_index,
       round(50 + least(90, 9 * ln(1 + median(l_extendedprice / 100))), 6) AS video_index
FROM lineitem GROUP BY l_partkey""")

register("P08_median_percentile_signals", """
SELECT l_partkey AS title, round(median(l_quantity), 6) AS median_value,
       round(quantile_cont(l_quantity, 0.8), 6) AS p80_value, round(sum(l_quantity) / 365.0, 6) AS mean_daily
FROM lineitem GROUP BY l_partkey""")

register("P09_title_match", """
WITH q AS (SELECT conv_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS qt FROM conversations WHERE turn = 0),
c AS (
  SELECT c.conv_id, c.turn, regexp_extract_all(lower(c.text), '[a-z0-9]+') AS vt, q.qt
  FROM conversations c JOIN q USING (conv_id) WHERE c.turn > 0
),
m AS (
  SELECT conv_id, turn,
         len(vt) > 0 AND len(qt) > 0
         AND len(list_filter(qt, lambda t: list_contains(vt, t))) >= greatest(1, len(qt) // 2)
         AND len(list_intersect(vt, ['ballet', 'pas', 'variation', 'act', 'scene', 'solo', 'adagio', 'coda'])) > 0 AS matched
  FROM c
)
SELECT conv_id, turn, matched, matched OR count(*) FILTER (WHERE matched) OVER (PARTITION BY conv_id) < 5 AS used FROM m""")

register("P10_winsorize_by_group", with_(B_TITLES, B_SIGNALS) + """,
v AS (SELECT title, category, CASE WHEN title % 7 <> 0 THEN least(140, greatest(45, 55 + ((length(p_name) * 1.2::DOUBLE) % 45))) END AS y
      FROM titles JOIN part ON part.p_partkey = titles.title),
ref AS (SELECT t.category, s.youtube FROM titles t JOIN signals s USING (title)),
g AS (SELECT category, quantile_cont(youtube, 0.03) AS lo, quantile_cont(youtube, 0.97) AS hi FROM ref GROUP BY category),
a AS (SELECT quantile_cont(youtube, 0.03) AS lo, quantile_cont(youtube, 0.97) AS hi FROM ref)
SELECT v.title, round(CASE WHEN v.y IS NULL THEN NULL WHEN coalesce(g.lo, a.lo) IS NULL THEN v.y
                           ELSE least(coalesce(g.hi, a.hi), greatest(coalesce(g.lo, a.lo), v.y)) END, 6) AS youtube
FROM v LEFT JOIN g USING (category) CROSS JOIN a""")

register("P12_length_heuristics", """
SELECT p_partkey AS title, round(CAST(60 + length(p_name) % 40 AS DOUBLE), 6) AS trends,
       round(least(140, greatest(45, 55 + ((length(p_name) * 1.2::DOUBLE) % 45))), 6) AS youtube,
       round(50 + ((length(p_name) * 1.7::DOUBLE) % 40), 6) AS streaming
FROM part""")

register("P13_bands", scoring_ctes("models") + """
SELECT title,
       CASE WHEN "Composite" >= 90 THEN 'A' WHEN "Composite" >= 75 THEN 'B' WHEN "Composite" >= 60 THEN 'C'
            WHEN "Composite" >= 45 THEN 'D' ELSE 'E' END AS score,
       CASE WHEN "EffectiveTicketIndex" IS NULL OR isnan("EffectiveTicketIndex") THEN '☆☆☆☆☆'
            WHEN "EffectiveTicketIndex" >= 100 THEN '★★★★★' WHEN "EffectiveTicketIndex" >= 75 THEN '★★★★☆'
            WHEN "EffectiveTicketIndex" >= 50 THEN '★★★☆☆' WHEN "EffectiveTicketIndex" >= 25 THEN '★★☆☆☆'
            ELSE '★☆☆☆☆' END AS stars,
       CASE WHEN "SignalOnly" >= 120 THEN 'exceptionally high' WHEN "SignalOnly" >= 100 THEN 'strong'
            WHEN "SignalOnly" >= 80 THEN 'above average' WHEN "SignalOnly" >= 60 THEN 'moderate'
            WHEN "SignalOnly" >= 40 THEN 'emerging' ELSE 'limited' END AS signal_level,
       CASE WHEN "TicketIndex_DeSeason_Used" >= 120 THEN 'exceptional demand'
            WHEN "TicketIndex_DeSeason_Used" >= 105 THEN 'strong demand'
            WHEN "TicketIndex_DeSeason_Used" >= 95 THEN 'benchmark demand'
            WHEN "TicketIndex_DeSeason_Used" >= 80 THEN 'moderate demand'
            WHEN "TicketIndex_DeSeason_Used" >= 60 THEN 'developing demand' ELSE 'emerging demand' END AS demand_tier
FROM imputed""")

register("P14_segment_tilt", scoring_ctes("segments") + """
SELECT title, coalesce(nullif(trim(segment), ''), 'General Population') AS segment_tilt FROM segmix WHERE rank = 1""")

register("P17_temporal_flags", scoring_ctes("runs") + """
SELECT title, CAST(run_no AS BIGINT) AS run_no, CAST(month(run_start) AS INTEGER) AS month_of_opening,
       month(run_start) IN (11, 12, 1) AS holiday_flag, strftime(run_start, '%B') AS run_month
FROM runs""")

register("S01_normalize_columns", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")

register("S02_clean_frame", """
SELECT event_id, CASE WHEN event_type NOT IN ('signup', 'error') THEN round(value, 6) END AS value, props AS unnamed_props, event_type
FROM events""")

register("S03_read_sales_history", with_(B_HIST) + """
SELECT title, city, count(*) AS rows, round(sum(single_tickets), 6) AS tickets, min(start_date) AS first_date
FROM hist WHERE single_tickets IS NOT NULL AND single_tickets >= 0 GROUP BY title, city""")

register("S04_baselines_source_filter", with_(B_BASE) + """
SELECT title, 'historical' AS source FROM base WHERE category <> 'PROMO'""")

register("S05_baselines_keep_last", with_(B_BASE) + """
SELECT trim(name) AS title_name, arg_max(title, title) AS title, round(arg_max(wiki, title), 6) AS wiki,
       arg_max(category, title) AS category, round(arg_max(round(chartmetric / 1000.0, 4), title), 6) AS intentratio
FROM base WHERE length(trim(name)) > 0 GROUP BY trim(name)""")

register("S08_segment_priors_clean", scoring_ctes("segments") + """
SELECT region, category, segment, round(weight, 6) AS weight FROM priors
WHERE segment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')""")

register("S09_past_runs_parse", scoring_ctes("runs") + """
SELECT CAST(title AS VARCHAR) AS title, count(*) AS runs, count(run_start) AS parsed_start, CAST(0 AS BIGINT) AS parsed_end
FROM runs GROUP BY title""")

register("S15_weather_union", """
WITH w AS (
  SELECT event_type AS city, CAST(ts AS DATE) AS d, avg(value) / 5 AS snow FROM events GROUP BY 1, 2
)
SELECT city, count(*) AS days, round(avg(snow), 6) AS avg_snow FROM w GROUP BY city""")


# ---------------------------------------------------------------- joins and factors
B_CUBE = """
cube AS (
  SELECT title, city, segment, start_date, sum(single_tickets) AS single_tickets
  FROM hist WHERE single_tickets IS NOT NULL AND single_tickets >= 0 GROUP BY 1, 2, 3, 4
)"""

register("J01_left_enrich", with_(B_HIST, B_CUBE) + """,
ext AS (
  SELECT year(o.o_orderdate) AS year, r.r_name AS city, count(*) AS n_orders, avg(o.o_totalprice) AS avg_order_value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2
)
SELECT k.title, k.city, k.segment, k.start_date, CAST(year(k.start_date) AS INTEGER) AS year, e.n_orders,
       round(e.avg_order_value, 6) AS avg_order_value
FROM cube k LEFT JOIN ext e ON e.year = year(k.start_date) AND e.city = k.city""")

register("J02_left_enrich_events", with_(B_HIST, B_CUBE) + """,
evf AS (
  SELECT l.l_partkey AS show_title, r.r_name AS city, count(*) AS supplied_lines, avg(l.l_discount) AS avg_discount
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2
)
SELECT k.title, k.city, k.segment, k.start_date, e.supplied_lines, round(e.avg_discount, 6) AS avg_discount
FROM cube k LEFT JOIN evf e ON e.show_title = k.title AND e.city = k.city""")

B_WEATHER = """
weather AS (
  SELECT event_type AS city, CAST(ts AS DATE) AS date, 30 - max(value) / 5 AS min_temperature, avg(value) / 5 AS snow
  FROM events GROUP BY 1, 2
)"""

register("J03_weather_by_date_city", with_(B_WEATHER) + """
SELECT e.event_id, round(w.min_temperature, 6) AS weather_min_temperature, round(w.snow, 6) AS weather_snow
FROM events e LEFT JOIN weather w ON w.date = CAST(e.ts AS DATE)
  AND upper(substr(trim(w.city), 1, 1)) || lower(substr(trim(w.city), 2)) = upper(substr(trim(e.event_type), 1, 1)) || lower(substr(trim(e.event_type), 2))""")

register("J04_marketing_join", with_(B_HIST, B_CUBE) + """,
spend AS (SELECT l_partkey AS title, sum(l_extendedprice * l_discount) AS marketing_spend FROM lineitem GROUP BY 1)
SELECT k.title, k.city, k.segment, k.start_date, round(s.marketing_spend, 6) AS marketing_spend
FROM cube k LEFT JOIN spend s USING (title)""")

register("J05_chained_enrich_check", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")

B_ASOF = """
lft AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
rgt AS (SELECT user_id, ts, value AS view_value, event_id AS view_id FROM events WHERE event_type = 'view'),
cand AS (
  SELECT l.event_id, l.user_id, l.ts, l.value, r.view_value, r.view_id, r.ts AS matched_ts,
         row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC NULLS LAST, r.view_id DESC NULLS LAST) AS rn
  FROM lft l LEFT JOIN rgt r ON r.user_id = l.user_id AND r.ts <= l.ts
),
asofm AS (SELECT * EXCLUDE (rn) FROM cand WHERE rn = 1)"""

register("J06_asof_last", with_(B_ASOF) + """
SELECT event_id, user_id, epoch_us(ts) AS ts_us, round(value, 6) AS value, round(view_value, 6) AS view_value, view_id,
       epoch_us(matched_ts) AS matched_ts_us FROM asofm""")

B_EXACT = B_WEATHER + """,
lastw AS (SELECT city, arg_max(min_temperature, date) AS lmt, arg_max(snow, date) AS ls FROM weather GROUP BY city),
el AS (
  SELECT e.event_id,
         CASE WHEN w.city IS NOT NULL THEN w.min_temperature ELSE lw.lmt END AS min_temperature,
         CASE WHEN w.city IS NOT NULL THEN w.snow ELSE lw.ls END AS snow,
         CASE WHEN w.city IS NOT NULL THEN 'exact' WHEN lw.city IS NOT NULL THEN 'latest' ELSE 'none' END AS match
  FROM events e
  LEFT JOIN weather w ON w.city = e.event_type AND w.date = CAST(e.ts AS DATE) + 15
  LEFT JOIN lastw lw ON lw.city = e.event_type
)"""

register("J07_exact_else_latest", with_(B_EXACT) + """
SELECT event_id, round(min_temperature, 6) AS min_temperature, round(snow, 6) AS snow, match FROM el""")

register("F21_weather_factor", with_(B_EXACT) + """
SELECT event_id, round(CASE WHEN min_temperature IS NULL AND snow IS NULL THEN 1.0
  ELSE least(1.05, greatest(0.85, (CASE WHEN min_temperature < -20 THEN 0.90 ELSE 1.0 END)
                                  * (CASE WHEN snow > 10 THEN 0.95 ELSE 1.0 END))) END::DOUBLE, 6) AS weather_factor
FROM el""")

register("F20_economic_factor", with_(B_ASOF) + """,
sg AS (SELECT user_id, ts, value / 10.0 AS rate, event_id AS signup_id FROM events WHERE event_type = 'signup'),
c2 AS (
  SELECT a.event_id, a.view_value, s.rate,
         row_number() OVER (PARTITION BY a.event_id ORDER BY s.ts DESC NULLS LAST, s.signup_id DESC NULLS LAST) AS rn
  FROM asofm a LEFT JOIN sg s ON s.user_id = a.user_id AND s.ts <= a.ts
),
f AS (
  SELECT event_id,
         CASE WHEN view_value > 0 THEN 0.8 + 0.4 * least(1.5, greatest(0.5, view_value / 60.0)) ELSE 1.0 END AS oil_f,
         CASE WHEN rate > 0 THEN 0.8 + 0.4 * least(1.5, greatest(0.5, 6.0 / rate)) ELSE 1.0 END AS un_f
  FROM c2 WHERE rn = 1
)
SELECT event_id, round(least(1.10, greatest(0.85, 0.4 * oil_f + 0.6 * un_f)), 6) AS economic_factor FROM f""")

B_LOOKUP = """
allsales AS (
  SELECT DISTINCT r.r_name AS region, p.p_type AS category, c.c_mktsegment AS segment
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON p.p_partkey = l.l_partkey
)"""

register("J08_hierarchical_lookup", scoring_ctes("segments") + "," + B_LOOKUP + """
SELECT k.region, k.category, k.segment, round(coalesce(p.weight, f.weight, 1.0), 6) AS weight,
       CASE WHEN p.weight IS NOT NULL THEN 'region' WHEN f.weight IS NOT NULL THEN 'fallback' ELSE 'default' END AS weight_source
FROM allsales k
LEFT JOIN priors p ON lower(trim(p.region)) = lower(trim(k.region)) AND lower(trim(p.category)) = lower(trim(k.category))
                  AND lower(trim(p.segment)) = lower(trim(k.segment))
LEFT JOIN priors f ON lower(f.region) = 'province' AND lower(trim(f.category)) = lower(trim(k.category))
                  AND lower(trim(f.segment)) = lower(trim(k.segment))""")

register("J09_hierarchical_lookup_set", scoring_ctes("segments") + "," + B_LOOKUP + """,
keys AS (SELECT DISTINCT region, category FROM allsales)
SELECT k.region, k.category, p.segment, round(p.weight, 6) AS weight, 'region' AS weight_source
FROM keys k JOIN priors p ON p.region = k.region AND p.category = k.category
UNION ALL
SELECT k.region, k.category, f.segment, round(f.weight, 6), 'fallback'
FROM keys k JOIN priors f ON f.region = 'Province' AND f.category = k.category
WHERE NOT EXISTS (SELECT 1 FROM priors p WHERE p.region = k.region AND p.category = k.category)""")


# ---------------------------------------------------------------- profiling and summaries
register("A08_monthly_weather_summary", """
WITH w AS (
  SELECT event_type AS city, CAST(ts AS DATE) AS date, 30 - max(value) / 5 AS min_temperature, avg(value) / 5 AS snow,
         30 - avg(value) / 5 AS avg_temperature, sum(value) / 100 AS precipitation
  FROM events GROUP BY 1, 2
)
SELECT CAST(month(date) AS INTEGER) AS month, city, round(avg(avg_temperature), 6) AS avg_temperature,
       round(avg(min_temperature), 6) AS avg_min_temperature, round(avg(snow), 6) AS avg_snow,
       round(avg(precipitation), 6) AS avg_precipitation,
       count(*) FILTER (WHERE min_temperature < -20) AS extreme_cold_days, count(*) AS days
FROM w GROUP BY 1, 2""")

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_A09_OUT = "\nUNION ALL\n".join(f"""SELECT 'outliers', '{c}', CAST(count(*) FILTER (
    WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS DOUBLE)
  FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS nn FROM lineitem)
  WHERE nn > 10""" for c in _LI_NUM)

register("A09_profile_source", f"""
WITH rows_ AS (
  SELECT 'row_count' AS metric, CAST(NULL AS VARCHAR) AS "column", CAST(count(*) AS DOUBLE) AS value FROM lineitem
  UNION ALL SELECT 'column_count', NULL, 11.0
  UNION ALL SELECT 'missing_expected', 'l_comment', 1.0
  UNION ALL SELECT 'required_nulls', 'l_quantity', CAST(count(*) FILTER (WHERE l_quantity IS NULL) AS DOUBLE) FROM lineitem
  UNION ALL SELECT 'date_min', 'l_shipdate', CAST(strftime(min(CAST(l_shipdate AS DATE)), '%Y%m%d') AS DOUBLE) FROM lineitem
  UNION ALL SELECT 'date_max', 'l_shipdate', CAST(strftime(max(CAST(l_shipdate AS DATE)), '%Y%m%d') AS DOUBLE) FROM lineitem
  UNION ALL {_A09_OUT}
)
SELECT 'lineitem' AS source, metric, "column", round(value, 6) AS value FROM rows_
WHERE metric NOT IN ('null_count', 'outliers') OR value > 0""")

register("A11_source_mix", """
WITH labels(label, pos) AS (VALUES ('History', 0), ('Category model', 1), ('Overall model', 2), ('ML Category', 3),
                                   ('ML Overall', 4), ('kNN Fallback', 5), ('Not enough data', 6))
SELECT l.label, l.pos, count(i.title) AS n FROM labels l LEFT JOIN (""" + ORACLES["F10_tiered_impute"] + """) i ON i."TicketIndexSource" = l.label
GROUP BY l.label, l.pos HAVING count(i.title) > 0""")

register("A12_intent_summary", """
WITH t AS (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS r FROM lineitem GROUP BY 1)
SELECT round(median(r), 6) AS intent_ratio,
       CASE WHEN median(r) IS NULL THEN NULL WHEN median(r) < 0.05 THEN 'high ambiguity'
            WHEN median(r) > 0.30 THEN 'high clarity' ELSE 'mixed signal' END AS clarity
FROM t""")

B_PLAN = """
implied AS (
  SELECT median("EstimatedTickets" / ("TicketIndex_DeSeason_Used" * "FutureSeasonalityFactor") * 100) AS b
  FROM imputed WHERE "TicketIndex_DeSeason_Used" * "FutureSeasonalityFactor" > 0 AND "EstimatedTickets" IS NOT NULL
),
assign AS (SELECT title, CAST(CASE WHEN month(mid_date) IN (9, 10, 1, 2, 3, 5) THEN month(mid_date)
                                   ELSE [9, 10, 1, 2, 3, 5][title % 6 + 1] END AS INTEGER) AS m FROM lastmid),
plan0 AS (
  SELECT a.m, i.title, i.category, i."Familiarity", i."Motivation", i."Composite", i."PredictedPrimarySegment",
         make_date(CASE WHEN a.m IN (9, 10, 12) THEN 2026 ELSE 2027 END, a.m, 15) AS run_date,
         coalesce(i."TicketIndex_DeSeason_Used", i."SignalOnly") AS idx,
         CASE a.m WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 1 THEN 'January' WHEN 2 THEN 'February'
                  WHEN 3 THEN 'March' WHEN 5 THEN 'May' END || ' 2027' AS "Month"
  FROM assign a JOIN (
    SELECT im.*, s1.segment AS "PredictedPrimarySegment" FROM imputed im JOIN segmix s1 ON s1.title = im.title AND s1.rank = 1
  ) i USING (title)
),
plan1 AS (
  SELECT p.*, coalesce(s.factor, 1.0) AS ff, p.idx * coalesce(s.factor, 1.0) AS used,
         round_even(p.idx * coalesce(s.factor, 1.0) / 100 * (SELECT b FROM implied), 0) AS est
  FROM plan0 p LEFT JOIN season s ON s.category = p.category AND s.month = p.m
),
plan AS (
  SELECT p.*, round_even(coalesce(est, 0) * 1.0 * 1.0, 0) AS fin, sp.sa, sp.se,
         round_even(round_even(coalesce(est, 0), 0) * sp.sa / (sp.sa + sp.se), 0) AS sgl_a,
         round_even(round_even(coalesce(est, 0), 0) * sp.se / (sp.sa + sp.se), 0) AS sgl_e
  FROM plan1 p JOIN split sp USING (title)
)"""


def plan_ctes() -> str:
    return scoring_ctes("segments") + "," + B_PLAN


register("A13_implied_benchmark", scoring_ctes("models") + """,
implied AS (
  SELECT median("EstimatedTickets" / ("TicketIndex_DeSeason_Used" * "FutureSeasonalityFactor") * 100) AS b
  FROM imputed WHERE "TicketIndex_DeSeason_Used" * "FutureSeasonalityFactor" > 0 AND "EstimatedTickets" IS NOT NULL
)
SELECT round(b, 6) AS bench_med_deseason_est FROM implied""")

register("R01_season_plan", plan_ctes() + """
SELECT "Month", title, round(ff, 6) AS "FutureSeasonalityFactor", round(used, 6) AS "TicketIndex_used",
       round(est, 6) AS "EstimatedTickets", round(fin, 6) AS "EstimatedTickets_Final",
       round(sgl_a, 6) AS "Singles_AMERICA", round(sgl_e, 6) AS "Singles_EUROPE",
       round(sa / (sa + se), 6) AS "CityShare_AMERICA",
       CASE WHEN "Composite" >= 90 THEN 'A' WHEN "Composite" >= 75 THEN 'B' WHEN "Composite" >= 60 THEN 'C'
            WHEN "Composite" >= 45 THEN 'D' ELSE 'E' END AS "Score",
       m IN (11, 12, 1) AS holiday_flag
FROM plan""")

register("R02_board_summary", plan_ctes() + """
SELECT split_part("Month", ' ', 1) AS month_name,
       CASE split_part("Month", ' ', 1) WHEN 'September' THEN 0 WHEN 'October' THEN 1 WHEN 'November' THEN 2
            WHEN 'December' THEN 3 WHEN 'January' THEN 4 WHEN 'February' THEN 5 WHEN 'March' THEN 6
            WHEN 'April' THEN 7 WHEN 'May' THEN 8 WHEN 'June' THEN 9 ELSE 99 END AS month_rank,
       title, category, CAST(fin AS BIGINT) AS estimated_tickets,
       CAST(sgl_a AS BIGINT) AS "singles_AMERICA", CAST(sgl_e AS BIGINT) AS "singles_EUROPE",
       coalesce(nullif(trim("PredictedPrimarySegment"), ''), 'General Population') AS segment_tilt,
       CASE WHEN used IS NULL OR isnan(used) THEN '☆☆☆☆☆' WHEN used >= 100 THEN '★★★★★' WHEN used >= 75 THEN '★★★★☆'
            WHEN used >= 50 THEN '★★★☆☆' WHEN used >= 25 THEN '★★☆☆☆' ELSE '★☆☆☆☆' END AS index_strength
FROM plan""")

register("R03_financial_summary", plan_ctes() + """,
lng AS (
  SELECT title, upper(split_part("Month", ' ', 1)) AS mm, 'title' AS metric, CAST(title AS VARCHAR) AS value FROM plan
  UNION ALL SELECT title, upper(split_part("Month", ' ', 1)), 'EstimatedTickets_Final', CAST(CAST(fin AS BIGINT) AS VARCHAR) FROM plan
  UNION ALL SELECT title, upper(split_part("Month", ' ', 1)), 'Singles_AMERICA', CAST(CAST(sgl_a AS BIGINT) AS VARCHAR) FROM plan
  UNION ALL SELECT title, upper(split_part("Month", ' ', 1)), 'Singles_EUROPE', CAST(CAST(sgl_e AS BIGINT) AS VARCHAR) FROM plan
)
SELECT title, metric,
       max(value) FILTER (WHERE mm = 'SEPTEMBER') AS "SEPTEMBER", max(value) FILTER (WHERE mm = 'OCTOBER') AS "OCTOBER",
       max(value) FILTER (WHERE mm = 'JANUARY') AS "JANUARY", max(value) FILTER (WHERE mm = 'FEBRUARY') AS "FEBRUARY",
       max(value) FILTER (WHERE mm = 'MARCH') AS "MARCH", max(value) FILTER (WHERE mm = 'MAY') AS "MAY"
FROM lng GROUP BY title, metric""")

register("R04_wide_plan", plan_ctes() + """,
sw AS (SELECT title, '{' || string_agg('"' || segment || '":' || CAST(round(share, 4) AS VARCHAR), ',' ORDER BY pos) || '}' AS j FROM segmix GROUP BY 1),
d AS (
  SELECT p.*, i.gender, i."TicketIndexSource" AS src, i.wiki, i.trends, i.youtube, i.chartmetric, i."SignalOnly" AS so, i."TicketMedian" AS tmed,
         i."TicketIndex_DeSeason_Used" AS du, i."HistSeasonalityFactor" AS hf, i.prior_total_tickets, i.run_count_prior,
         i."TicketIndex_Predicted" AS pred, i."FutureSeasonalityFactor" AS csf, s1.segment AS seg1, s2.segment AS seg2, sw.j
  FROM plan p JOIN imputed i USING (title) JOIN sw USING (title)
  JOIN segmix s1 ON s1.title = p.title AND s1.rank = 1 JOIN segmix s2 ON s2.title = p.title AND s2.rank = 2
),
n AS (SELECT title, "Month", unnest([
""" + ",\n".join(f"  {{'metric': '{m}', 'number': CAST({e} AS DOUBLE), 'text': CAST(NULL AS VARCHAR)}}" for m, e in (
    ("wiki", "wiki"), ("trends", "trends"), ("youtube", "youtube"), ("chartmetric", "chartmetric"), ("Familiarity", '"Familiarity"'),
    ("Motivation", '"Motivation"'), ("SignalOnly", "so"), ("TicketMedian", "tmed"), ("TicketIndex_DeSeason_Used", "du"),
    ("TicketIndex_used", "used"), ("FutureSeasonalityFactor", "ff"), ("HistSeasonalityFactor", "hf"), ("Composite", '"Composite"'),
    ("EstimatedTickets", "est"), ("EstimatedTickets_Final", "fin"), ("ticket_median_prior", "tmed"),
    ("prior_total_tickets", "prior_total_tickets"), ("run_count_prior", "run_count_prior"), ("TicketIndex_Predicted", "pred"),
    ("month_of_opening", "m"), ("category_seasonality_factor", "csf"), ("Singles_AMERICA", "sgl_a"), ("Singles_EUROPE", "sgl_e"),
    ("CityShare_AMERICA", "sa / (sa + se)"), ("CityShare_EUROPE", "se / (sa + se)"))) + ",\n" + ",\n".join(
    f"  {{'metric': '{m}', 'number': CAST(NULL AS DOUBLE), 'text': CAST({e} AS VARCHAR)}}" for m, e in (
    ("title", "title"), ("category", "category"), ("PredictedPrimarySegment", "seg1"), ("PredictedSecondarySegment", "seg2"),
    ("TicketIndexSource", "src"), ("Score", """CASE WHEN "Composite" >= 90 THEN 'A' WHEN "Composite" >= 75 THEN 'B'
      WHEN "Composite" >= 60 THEN 'C' WHEN "Composite" >= 45 THEN 'D' ELSE 'E' END"""), ("gender", "gender"),
    ("dominant_audience_segment", "seg1"), ("segment_weights", "j"), ("holiday_flag", "m IN (11, 12, 1)"))) + """
]) AS e FROM d)
SELECT title, "Month", e.metric AS metric, round(e.number, 6) AS number, e.text AS text FROM n""")

register("R05_rank_plan", plan_ctes() + """
SELECT rank() OVER (ORDER BY round("Composite", 6) DESC NULLS LAST, fin DESC NULLS LAST) AS rank, "Month", title,
       round("Composite", 6) AS "Composite", round(fin, 6) AS "EstimatedTickets_Final" FROM plan""")

register("A14_plan_totals", plan_ctes() + """
SELECT 'season' AS scope, round(coalesce(sum(fin), 0), 6) AS tickets, 1.0 AS share FROM plan
UNION ALL SELECT 'AMERICA', round(coalesce(sum(sgl_a), 0), 6), round(coalesce(sum(sgl_a), 0) / coalesce(nullif(sum(fin), 0), 1.0), 6) FROM plan
UNION ALL SELECT 'EUROPE', round(coalesce(sum(sgl_e), 0), 6), round(coalesce(sum(sgl_e), 0) / coalesce(nullif(sum(fin), 0), 1.0), 6) FROM plan""")

register("A15_city_by_month", plan_ctes() + """
SELECT "Month", round(sum(sgl_a), 6) AS "singles_AMERICA", round(sum(sgl_e), 6) AS "singles_EUROPE" FROM plan GROUP BY 1""")

register("A16_scatter_quadrants", plan_ctes() + """,
md AS (SELECT median("Familiarity") AS mx, median("Motivation") AS my FROM plan
       WHERE "Familiarity" IS NOT NULL AND "Motivation" IS NOT NULL AND fin IS NOT NULL)
SELECT "Month", title, round("Familiarity", 6) AS "Familiarity", round("Motivation", 6) AS "Motivation",
       round(sqrt(CASE WHEN greatest(fin, 0) = 0 THEN 1.0 ELSE greatest(fin, 0) END) * 3, 6) AS bubble_size,
       (CASE WHEN "Familiarity" >= mx THEN 'high_' ELSE 'low_' END) || 'familiarity/' ||
       (CASE WHEN "Motivation" >= my THEN 'high_' ELSE 'low_' END) || 'motivation' AS quadrant
FROM plan CROSS JOIN md WHERE "Familiarity" IS NOT NULL AND "Motivation" IS NOT NULL AND fin IS NOT NULL""")

register("A18_sort_topk", scoring_ctes("models") + """
SELECT title, round("EstimatedTickets", 6) AS "EstimatedTickets", round("Composite", 6) AS "Composite" FROM imputed
ORDER BY "EstimatedTickets" DESC NULLS LAST, "Composite" DESC, "Motivation" DESC, "Familiarity" DESC, title LIMIT 25""")

register("A19_union_all", """
SELECT event_type AS city, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1""")


# ---------------------------------------------------------------- attribution (4 signals, ridge 5, anchors)
_F = ["wiki", "trends", "youtube", "chartmetric"]


def _det(m: list[list[str]]) -> str:
    """Determinant of a square matrix of SQL expressions (Laplace expansion on the first row)."""
    n = len(m)
    if n == 1:
        return m[0][0]
    if n == 2:
        return f"(({m[0][0]}) * ({m[1][1]}) - ({m[0][1]}) * ({m[1][0]}))"
    terms = []
    for j in range(n):
        minor = [row[:j] + row[j + 1:] for row in m[1:]]
        sign = "+" if j % 2 == 0 else "-"
        terms.append(f"{sign} ({m[0][j]}) * {_det(minor)}")
    return "(" + " ".join(terms) + ")"


def _coef_sql() -> str:
    k = len(_F)
    A = [[f"(c{a}{b}{' + 5.0' if a == b else ''})" for b in range(k)] for a in range(k)]
    bvec = [f"c{a}y" for a in range(k)]
    d = _det(A)
    cols = []
    for j in range(k):
        Aj = [[bvec[a] if b == j else A[a][b] for b in range(k)] for a in range(k)]
        cols.append(f"{_det(Aj)} / {d} AS b{j}")
    return ", ".join(cols)


B_ATTR = """
trn AS (SELECT """ + ", ".join(f"coalesce({f}, 0) AS x{i}" for i, f in enumerate(_F)) + """, "TicketIndex_DeSeason" AS y FROM known),
tst AS (SELECT """ + ", ".join(f"{f} AS m{i}" for i, f in enumerate(_F)) + """, count(*) AS n FROM (SELECT """ + \
    ", ".join(f"avg(x{i}) AS {f}" for i, f in enumerate(_F)) + """, count(*) AS c FROM trn) JOIN trn ON TRUE GROUP BY ALL),
anc AS (
  SELECT 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS x3, 25.0::DOUBLE AS y FROM (SELECT unnest(range(greatest(3, n // 2))) FROM tst)
  UNION ALL
  SELECT m0, m1, m2, m3, 100.0 FROM tst, (SELECT unnest(range(greatest(3, n // 2))) FROM tst)
),
alld AS (SELECT * FROM trn UNION ALL SELECT * FROM anc),
mom AS (
  SELECT avg(y) AS ay, """ + ", ".join(f"avg(x{i}) AS a{i}" for i in range(4)) + ", " + \
    ", ".join(f"covar_pop(x{a}, x{b}) * count(*) AS c{a}{b}" for a in range(4) for b in range(4)) + ", " + \
    ", ".join(f"covar_pop(x{a}, y) * count(*) AS c{a}y" for a in range(4)) + """
  FROM alld
),
coef0 AS (SELECT *, """ + _coef_sql() + """ FROM mom),
coef AS (SELECT b0, b1, b2, b3, ay - (b0 * a0 + b1 * a1 + b2 * a2 + b3 * a3) AS intercept FROM coef0),
attr AS (
  SELECT i.title, c.intercept + c.b0 * coalesce(i.wiki, 0) + c.b1 * coalesce(i.trends, 0) + c.b2 * coalesce(i.youtube, 0)
           + c.b3 * coalesce(i.chartmetric, 0) AS prediction,
         c.intercept + c.b0 * t.m0 + c.b1 * t.m1 + c.b2 * t.m2 + c.b3 * t.m3 AS base_value,
         c.b0 * (coalesce(i.wiki, 0) - t.m0) AS shap_wiki, c.b1 * (coalesce(i.trends, 0) - t.m1) AS shap_trends,
         c.b2 * (coalesce(i.youtube, 0) - t.m2) AS shap_youtube, c.b3 * (coalesce(i.chartmetric, 0) - t.m3) AS shap_chartmetric
  FROM indexed i CROSS JOIN coef c CROSS JOIN tst t
),
contrib AS (
  SELECT title, name, shap, CASE WHEN shap > 0 THEN 'up' ELSE 'down' END AS direction, abs(shap) AS abs_impact, pos,
         row_number() OVER (PARTITION BY title ORDER BY abs(shap) DESC, pos) AS rank
  FROM (
    SELECT title, 'wiki' AS name, shap_wiki AS shap, 0 AS pos FROM attr
    UNION ALL SELECT title, 'trends', shap_trends, 1 FROM attr
    UNION ALL SELECT title, 'youtube', shap_youtube, 2 FROM attr
    UNION ALL SELECT title, 'chartmetric', shap_chartmetric, 3 FROM attr
  )
)"""


def attr_ctes() -> str:
    return scoring_ctes("models") + "," + B_ATTR


register("E01_sanitize_features", """
SELECT event_id, round(CASE WHEN event_type = 'error' THEN 1e10 WHEN event_type = 'signup' THEN 0.0
                            ELSE least(1e10, greatest(-1e10, coalesce(value, 0.0))) END, 6) AS value FROM events""")

register("E02_multi_ridge", attr_ctes() + """
SELECT round(intercept, 6) AS intercept, round(b0, 6) AS beta_wiki, round(b1, 6) AS beta_trends,
       round(b2, 6) AS beta_youtube, round(b3, 6) AS beta_chartmetric, (SELECT n FROM tst) AS n FROM coef""")

register("E03_linear_attribution", attr_ctes() + """
SELECT title, round(prediction, 6) AS prediction, round(base_value, 6) AS base_value, round(shap_wiki, 6) AS shap_wiki,
       round(shap_trends, 6) AS shap_trends, round(shap_youtube, 6) AS shap_youtube,
       round(shap_chartmetric, 6) AS shap_chartmetric FROM attr""")

register("E04_contributions", attr_ctes() + """
SELECT title, CAST(rank AS INTEGER) AS rank, name, round(shap, 6) AS shap, direction FROM contrib""")

register("E05_top_drivers", attr_ctes() + """
SELECT title, CAST(row_number() OVER (PARTITION BY title ORDER BY rank) AS INTEGER) AS rank, name, round(shap, 6) AS shap
FROM contrib WHERE abs_impact >= 0.5 QUALIFY row_number() OVER (PARTITION BY title ORDER BY rank) <= 3""")

register("E07_attribution_table", attr_ctes() + """,
vals AS (
  SELECT title, 'wiki' AS name, coalesce(wiki, 0) AS value FROM indexed
  UNION ALL SELECT title, 'trends', coalesce(trends, 0) FROM indexed
  UNION ALL SELECT title, 'youtube', coalesce(youtube, 0) FROM indexed
  UNION ALL SELECT title, 'chartmetric', coalesce(chartmetric, 0) FROM indexed
)
SELECT c.title, CAST(c.rank AS INTEGER) AS rank, upper(substr(c.name, 1, 1)) || substr(c.name, 2) AS feature,
       round(v.value, 6) AS value, round(c.shap, 6) AS contribution, upper(c.direction) AS direction
FROM contrib c JOIN vals v USING (title, name) WHERE c.rank <= 3""")

register("E08_batch_attribution", attr_ctes() + """
SELECT title, round(prediction, 6) AS prediction,
       round(abs(base_value + shap_wiki + shap_trends + shap_youtube + shap_chartmetric - prediction), 6) + 0.0 AS additivity_gap
FROM attr""")

register("E09_push_pull", attr_ctes() + """,
d AS (SELECT * FROM contrib WHERE abs_impact >= 0.5 QUALIFY row_number() OVER (PARTITION BY title ORDER BY rank) <= 5)
SELECT a.title, round(coalesce(sum(d.shap) FILTER (WHERE d.shap > 0), 0), 6) AS total_positive,
       round(coalesce(sum(d.shap) FILTER (WHERE d.shap < 0), 0), 6) AS total_negative,
       CAST(count(*) FILTER (WHERE d.shap > 0) AS INTEGER) AS n_positive,
       CAST(count(*) FILTER (WHERE d.shap < 0) AS INTEGER) AS n_negative
FROM attr a LEFT JOIN d USING (title) GROUP BY a.title""")

register("A17_mean_abs_attribution", attr_ctes() + """,
m AS (
  SELECT 'wiki' AS feature, avg(abs(shap_wiki)) AS mean_abs FROM attr
  UNION ALL SELECT 'trends', avg(abs(shap_trends)) FROM attr
  UNION ALL SELECT 'youtube', avg(abs(shap_youtube)) FROM attr
  UNION ALL SELECT 'chartmetric', avg(abs(shap_chartmetric)) FROM attr
)
SELECT feature, round(mean_abs, 6) AS mean_abs FROM m ORDER BY mean_abs DESC, feature LIMIT 8""")


# ---------------------------------------------------------------- fallback fits, priors, tier-2 operators
register("F08_anchored_ols", scoring_ctes("models") + """,
od AS (
  SELECT "SignalOnly" AS x, "TicketIndex_DeSeason" AS y FROM known
  UNION ALL SELECT 0.0, 25.0 FROM (SELECT unnest(range(greatest(2, n // 3))) FROM kn)
  UNION ALL SELECT 100.0, 100.0 FROM (SELECT unnest(range(greatest(2, n // 3))) FROM kn)
),
cn AS (SELECT category, count(*) AS n FROM known GROUP BY category HAVING count(*) >= 3),
cd AS (
  SELECT category, "SignalOnly" AS x, "TicketIndex_DeSeason" AS y FROM known WHERE category IN (SELECT category FROM cn)
  UNION ALL SELECT category, 0.0, 25.0 FROM (SELECT category, unnest(range(greatest(1, n // 3))) FROM cn)
  UNION ALL SELECT category, 100.0, 100.0 FROM (SELECT category, unnest(range(greatest(1, n // 3))) FROM cn)
)
SELECT '__overall__' AS category, (SELECT n FROM kn) AS n, round(regr_slope(y, x), 6) AS slope,
       round(regr_intercept(y, x), 6) AS intercept FROM od HAVING (SELECT n FROM kn) >= 5
UNION ALL
SELECT cd.category, cn.n, round(regr_slope(y, x), 6), round(regr_intercept(y, x), 6)
FROM cd JOIN cn USING (category) GROUP BY cd.category, cn.n""")

register("F18_tempered_prior", scoring_ctes("segments") + """
SELECT region, category, segment, round(CASE WHEN weight > 0 THEN pow(weight, 0.5) ELSE 1.0 END, 6) AS weight FROM priors""")

register("F19_softmax_like", scoring_ctes("segments") + """,
lg AS (SELECT *, ln(greatest(weight, 1e-9)) / 0.5 AS l FROM priors),
ex AS (SELECT *, exp(l - max(l) OVER (PARTITION BY region, category)) AS e FROM lg)
SELECT region, category, segment, round(e / sum(e) OVER (PARTITION BY region, category), 6) AS mix FROM ex""")

register("X02_calibrate", attr_ctes() + """,
d AS (SELECT a.title, a.prediction, k.category, k."TicketIndex_DeSeason" AS y FROM attr a JOIN known k USING (title))
SELECT category, count(*) AS n, round(regr_slope(y, prediction), 6) AS slope, round(regr_intercept(y, prediction), 6) AS intercept
FROM d GROUP BY category
UNION ALL
SELECT '__overall__', count(*), round(regr_slope(y, prediction), 6), round(regr_intercept(y, prediction), 6) FROM d""")

register("X03_backtest", scoring_ctes("models") + """,
fr AS (SELECT title, min(run_start) AS first_run FROM runs GROUP BY title),
d AS (SELECT k.title, k.category, k."SignalOnly" AS x, k."TicketIndex_DeSeason" AS y, fr.first_run FROM known k JOIN fr USING (title)),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY category) AS u, y - avg(y) OVER (PARTITION BY category) AS v FROM d),
w AS (
  SELECT *, count(v) OVER p AS n, sum(u) OVER p AS su, sum(v) OVER p AS sv, sum(u * u) OVER p AS suu, sum(u * v) OVER p AS suv
  FROM c WINDOW p AS (PARTITION BY category ORDER BY first_run, title ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
f AS (
  SELECT *, CASE WHEN suu - su * su / n > 1e-12 THEN (suv - su * sv / n) / (suu - su * su / n) ELSE 0.0 END AS b FROM w WHERE n >= 2
),
bterr AS (SELECT category, v - ((sv / n - b * su / n) + b * u) AS e FROM f)
SELECT category, count(*) AS n, round(avg(abs(e)), 6) AS "MAE", round(sqrt(avg(e * e)), 6) AS "RMSE" FROM bterr GROUP BY category""")

register("X04_modelling_dataset", scoring_ctes("runs") + """,
w AS (
  SELECT title, run_no, run_start, run_end, tickets,
         count(tickets) OVER p AS prior_run_count, sum(tickets) OVER p AS prior_total,
         list_sort(list(tickets) OVER p) AS earlier,
         lag(run_start) OVER (PARTITION BY title ORDER BY run_start, run_no) AS prev_start
  FROM runs WINDOW p AS (PARTITION BY title ORDER BY run_start, run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT title, CAST(run_no AS BIGINT) AS run_no, run_start, run_end, prior_run_count,
       round(prior_total, 6) AS prior_total,
       round(CASE WHEN len(earlier) = 0 THEN NULL ELSE list_median(earlier) END, 6) AS prior_median,
       round(date_diff('day', prev_start, run_start) / 365.25, 6) AS years_since_last,
       round(tickets, 6) AS target
FROM w""")

register("X06_ticketing_normalize", """
WITH t AS (
  SELECT l.l_partkey AS id, p.p_name, CASE WHEN r.r_name IN ('AMERICA', 'AFRICA') THEN 'AMERICA' ELSE 'EUROPE' END AS city,
         p.p_brand, p.p_size * 10 AS cap, CAST(l.l_shipdate AS DATE) AS perf, CAST(o.o_orderdate AS DATE) AS sold, l.l_quantity AS q,
         l.l_extendedprice / l.l_quantity AS price, substr(o.o_orderpriority, 1, 1) AS tier, l.l_discount, l.l_returnflag AS ch
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON p.p_partkey = l.l_partkey
),
bc AS (SELECT id, city, sum(q) AS s, count(DISTINCT perf) AS np FROM t GROUP BY 1, 2),
pc AS (SELECT * FROM bc QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, city DESC) = 1),
dy AS (SELECT id, sold, sum(sum(q)) OVER (PARTITION BY id ORDER BY sold) AS upto, sum(sum(q)) OVER (PARTITION BY id) AS s FROM t GROUP BY 1, 2),
wk AS (SELECT id, date_diff('day', min(sold), min(sold) FILTER (WHERE upto >= 0.8 * s)) / 7.0 AS w FROM dy GROUP BY 1),
chm AS (SELECT id, string_agg(ch || ':' || (CAST(floor((s / a) * 10000 + 0.5) AS BIGINT) // 10000) || '.' || lpad(CAST(CAST(floor((s / a) * 10000 + 0.5) AS BIGINT) % 10000 AS VARCHAR), 4, '0'), ';' ORDER BY ch) AS m
        FROM (SELECT id, ch, sum(q) AS s, sum(sum(q)) OVER (PARTITION BY id) AS a FROM t GROUP BY 1, 2) GROUP BY 1),
trm AS (SELECT id, string_agg(tier || ':' || (CAST(floor((s / a) * 10000 + 0.5) AS BIGINT) // 10000) || '.' || lpad(CAST(CAST(floor((s / a) * 10000 + 0.5) AS BIGINT) % 10000 AS VARCHAR), 4, '0'), ';' ORDER BY tier) AS m
        FROM (SELECT id, tier, sum(q) AS s, sum(sum(q)) OVER (PARTITION BY id) AS a FROM t GROUP BY 1, 2) GROUP BY 1),
g AS (
  SELECT id, min(p_name) AS show_title, year(min(perf) - INTERVAL 7 MONTH) AS y0, min(p_brand) AS venue_name, max(cap) AS cap,
         count(DISTINCT perf) AS np,
         coalesce(sum(q) FILTER (WHERE city = 'AMERICA' AND tier <> '1'), 0) AS sa, coalesce(sum(q) FILTER (WHERE city = 'EUROPE' AND tier <> '1'), 0) AS se,
         coalesce(sum(q) FILTER (WHERE city = 'AMERICA' AND tier = '1'), 0) AS ua, coalesce(sum(q) FILTER (WHERE city = 'EUROPE' AND tier = '1'), 0) AS ue,
         coalesce(sum(q) FILTER (WHERE tier <> '1'), 0) AS st, coalesce(sum(q) FILTER (WHERE tier = '1'), 0) AS ut, sum(q) AS q,
         coalesce(sum(q) FILTER (WHERE date_diff('day', sold, perf) <= 7), 0) / sum(q) AS late,
         coalesce(sum(q) FILTER (WHERE q >= 30), 0) / sum(q) AS grp, coalesce(sum(q) FILTER (WHERE l_discount = 0), 0) / sum(q) AS comp,
         count(*) FILTER (WHERE ch = 'R') / count(*) AS refund, sum(price * q) / sum(q) AS price, min(perf) AS o, max(perf) AS c,
         coalesce(sum(q) FILTER (WHERE dayofweek(perf) NOT IN (0, 6)), 0) / sum(q) AS wd, coalesce(sum(q) FILTER (WHERE dayofweek(perf) IN (0, 6)), 0) / sum(q) AS we
  FROM t GROUP BY id
)
SELECT show_title, g.id AS show_title_id, y0 || '-' || lpad(CAST((y0 + 1) % 100 AS VARCHAR), 2, '0') AS production_season, pc.city, venue_name,
       cap AS venue_capacity, pc.np AS performance_count_city, g.np AS performance_count_total,
       sa AS "single_tickets_america", se AS "single_tickets_europe", ua AS "subscription_tickets_america", ue AS "subscription_tickets_europe",
       st AS total_single_tickets, ut AS total_subscription_tickets, q AS total_tickets_all, round(q / g.np, 6) AS avg_tickets_per_performance,
       round(q / (cap * g.np), 6) AS load_factor, round(wk.w, 6) AS weeks_to_80pct_sold, round(late, 6) AS late_sales_share,
       chm.m AS channel_mix_distribution, round(grp, 6) AS group_sales_share, round(comp, 6) AS comp_ticket_share,
       round(refund, 6) AS refund_cancellation_rate, trm.m AS pricing_tier_structure, round(price, 6) AS average_base_ticket_price,
       o AS opening_date, c AS closing_date, 'weekday:' || (CAST(floor(wd * 10000 + 0.5) AS BIGINT) // 10000) || '.' || lpad(CAST(CAST(floor(wd * 10000 + 0.5) AS BIGINT) % 10000 AS VARCHAR), 4, '0') || ';weekend:' || (CAST(floor(we * 10000 + 0.5) AS BIGINT) // 10000) || '.' || lpad(CAST(CAST(floor(we * 10000 + 0.5) AS BIGINT) % 10000 AS VARCHAR), 4, '0') AS weekday_vs_weekend_mix
FROM g JOIN pc ON pc.id = g.id JOIN wk ON wk.id = g.id JOIN chm ON chm.id = g.id JOIN trm ON trm.id = g.id""")

register("X07_event_window_features", scoring_ctes("runs") + """,
ev AS (
  SELECT l.l_partkey AS title, CAST(o.o_orderdate AS DATE) AS a, CAST(l.l_shipdate AS DATE) AS b, l.l_quantity AS q,
         CAST(floor(l.l_extendedprice % 101) AS INTEGER) AS rank,
         CASE WHEN o.o_orderpriority LIKE '1%' THEN 'sports' WHEN o.o_orderpriority LIKE '2%' THEN 'concerts'
              WHEN o.o_orderkey % 7 = 0 THEN 'holidays' WHEN o.o_orderkey % 11 = 0 THEN 'severe-weather' END AS kind
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)
SELECT r.title, CAST(r.run_no AS BIGINT) AS run_no, count(e.title) AS n_events,
       round(coalesce(sum(q), 0.0), 6) AS attendance_sum,
       round(coalesce(sum(q) FILTER (WHERE kind = 'sports'), 0.0), 6) AS attendance_sports,
       round(coalesce(sum(q) FILTER (WHERE kind = 'concerts'), 0.0), 6) AS attendance_concerts,
       count(*) FILTER (WHERE rank >= 30) AS event_count, max(rank) AS rank_max,
       round(avg(rank) FILTER (WHERE rank >= 30), 6) AS rank_avg,
       CAST(coalesce(max(CASE WHEN kind = 'holidays' THEN 1 ELSE 0 END), 0) AS INTEGER) AS holidays_flag,
       CAST(coalesce(max(CASE WHEN kind = 'severe-weather' THEN 1 ELSE 0 END), 0) AS INTEGER) AS severe_weather_flag
FROM runs r LEFT JOIN ev e ON e.title = r.title AND e.a <= e.b AND e.a <= r.run_end AND e.b >= r.run_start
GROUP BY r.title, r.run_no""")

register("X01_knn_impute", scoring_ctes("models", hist=B_HIST_HIDDEN) + """,
st AS (
  SELECT avg(wiki) AS m1, stddev_pop(wiki) AS s1, avg(trends) AS m2, stddev_pop(trends) AS s2, avg(youtube) AS m3,
         stddev_pop(youtube) AS s3, avg(chartmetric) AS m4, stddev_pop(chartmetric) AS s4, count(*) AS n FROM known
),
zs AS (
  SELECT i.title, i."TicketIndex_DeSeason" AS y, (wiki - m1) / s1 AS z1, (trends - m2) / s2 AS z2, (youtube - m3) / s3 AS z3,
         (chartmetric - m4) / s4 AS z4, n
  FROM indexed i CROSS JOIN st WHERE wiki IS NOT NULL AND trends IS NOT NULL AND youtube IS NOT NULL AND chartmetric IS NOT NULL
),
us AS (SELECT title, y, n, z1 / l AS u1, z2 / l AS u2, z3 / l AS u3, z4 / l AS u4
       FROM (SELECT *, sqrt(z1 * z1 + z2 * z2 + z3 * z3 + z4 * z4) AS l FROM zs)),
sims AS (
  SELECT q.title, k.title AS near, k.y, round(q.u1 * k.u1 + q.u2 * k.u2 + q.u3 * k.u3 + q.u4 * k.u4, 12) AS sim,
         date_diff('day', lm.mid_date, (SELECT max(run_end) FROM runs)) / 365.25 AS years
  FROM us q JOIN us k ON q.y IS NULL AND k.y IS NOT NULL AND k.n >= 3 LEFT JOIN lastmid lm ON lm.title = k.title
),
best AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY sim DESC, near) AS r,
                sim * (0.5 * exp(-0.1 * years) + 0.5) AS w FROM sims QUALIFY r <= 5)
SELECT i.title, count(b.near) AS "kNN_neighbors", min(b.near) FILTER (WHERE r = 1) AS "kNN_nearest",
       round(max(b.sim), 6) AS "kNN_similarity", round(sum(w * b.y) / nullif(sum(w), 0), 6) AS "kNN_prediction"
FROM indexed i LEFT JOIN best b ON b.title = i.title WHERE i."TicketIndex_DeSeason" IS NULL GROUP BY i.title""")

register("X08_batch_rescale", with_(B_BASE) + """,
ctrl AS (SELECT category, arg_min(wiki, title) AS cw FROM base GROUP BY category)
SELECT b.title, round(b.wiki * 100 / nullif(c.cw, 0), 6) AS wiki_rescaled FROM base b JOIN ctrl c USING (category)""")

register("X08_rank_and_views", scoring_ctes("index") + """
SELECT b.title, round(100 * (1 - b.trends / max(b.trends) OVER (PARTITION BY b.category)), 6) AS rank_index,
       round(b.wiki * 100 / (SELECT wiki FROM bench), 6) AS views_index FROM base b""")

register("X09_batch_history_dedupe", """
WITH u AS (SELECT trim(p_name) AS t, count(*) AS n, max(CASE WHEN p_size = 1 THEN 1 ELSE 0 END) AS bad FROM part GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_input, count(*) AS n_unique, CAST(sum(n) - count(*) AS BIGINT) AS n_duplicates_skipped,
       CAST(count(*) - sum(bad) AS BIGINT) AS n_succeeded, CAST(sum(bad) AS BIGINT) AS n_failed FROM u""")

register("A18_first_row_per_title", with_(B_HIST) + """
SELECT title, start_date, city, segment, single_tickets FROM hist
QUALIFY row_number() OVER (PARTITION BY title ORDER BY start_date, city, segment, single_tickets) = 1""")

register("A18_sorted_unique_titles", """
SELECT DISTINCT trim(p_name) AS p_name FROM part WHERE length(trim(p_name)) > 0""")

register("J05_chained_enrich", with_(B_HIST) + """,
w1 AS (SELECT event_type, CAST(ts AS DATE) AS d, avg(value) / 5 AS snow FROM events GROUP BY 1, 2),
w AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'AMERICA' ELSE 'EUROPE' END AS city, d, avg(snow) AS snow FROM w1 GROUP BY 1, 2),
sp AS (SELECT l_partkey AS title, sum(l_extendedprice * l_discount) AS spend FROM lineitem GROUP BY 1)
SELECT h.title, h.city, count(*) AS rows, count(w.snow) AS with_weather, round(sum(w.snow), 6) AS snow, round(max(sp.spend), 6) AS spend
FROM hist h LEFT JOIN w ON w.city = h.city AND w.d = h.start_date LEFT JOIN sp ON sp.title = h.title GROUP BY 1, 2""")

register("J03_weather_no_city", """
WITH w AS (SELECT event_type, CAST(ts AS DATE) AS d, avg(value) / 5 AS snow FROM events GROUP BY 1, 2),
a AS (SELECT d, avg(snow) AS snow FROM w GROUP BY 1)
SELECT event_id, round(a.snow, 6) AS weather_snow FROM events e LEFT JOIN a ON a.d = CAST(e.ts AS DATE)""")

register("J04_marketing_by_date", with_(B_HIST) + """,
sp AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS spend FROM orders GROUP BY 1)
SELECT start_date AS date_key, count(*) AS rows, round(max(spend), 6) AS spend FROM hist LEFT JOIN sp ON sp.d = start_date GROUP BY 1""")

register("F09_fit_metrics_by_category", scoring_ctes("models") + """
SELECT k.category, count(*) AS n,
       round(avg(abs("TicketIndex_DeSeason" - (m.intercept + m.slope * "SignalOnly"))), 6) AS "MAE",
       round(sqrt(avg(("TicketIndex_DeSeason" - (m.intercept + m.slope * "SignalOnly")) ^ 2)), 6) AS "RMSE",
       round(1 - sum(("TicketIndex_DeSeason" - (m.intercept + m.slope * "SignalOnly")) ^ 2) / (var_pop("TicketIndex_DeSeason") * count(*)), 6) AS "R2"
FROM known k JOIN catmodel m ON m.category = k.category GROUP BY 1""")

register("S06_external_factors", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, r.r_name AS city, CAST(count(*) AS DOUBLE) AS population_city,
       round(avg(o_totalprice), 6) AS median_household_income_city, CAST(NULL AS DOUBLE) AS alberta_real_gdp_growth_rate,
       'extra' AS source_page
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""")

register("S07_dated_series", """
SELECT CAST(ts AS DATE) AS date, event_type AS series, round(avg(value), 6) AS value FROM events GROUP BY 1, 2""")

register("S10_event_features", ORACLES["X07_event_window_features"].replace(
    "SELECT r.title, CAST(r.run_no AS BIGINT) AS run_no, count(e.title) AS n_events,",
    """SELECT CAST(r.title AS VARCHAR) AS show_title, 'all' AS city, min(r.run_start) AS phq_start_date,
       CASE WHEN r.run_no > 0 THEN min(r.run_end) END AS phq_end_date, CAST(NULL AS DOUBLE) AS phq_demand_impact_score,""")
    .replace("AS attendance_", "AS phq_attendance_").replace("count(*) FILTER (WHERE rank >= 30) AS event_count",
    "CAST(count(*) FILTER (WHERE rank >= 30) AS DOUBLE) AS phq_event_count")
    .replace("max(rank) AS rank_max", "CAST(max(rank) AS DOUBLE) AS phq_rank_max").replace("AS rank_avg", "AS phq_rank_avg")
    .replace("AS INTEGER) AS holidays_flag", "AS DOUBLE) AS phq_holidays_flag")
    .replace("AS INTEGER) AS severe_weather_flag", "AS DOUBLE) AS phq_severe_weather_flag"))

register("S11_survey", """
SELECT c_mktsegment AS category, 'all' AS subcategory, 'balance' AS metric,
       CASE WHEN c_nationkey % 5 = 0 THEN 'Q1' ELSE CAST(c_nationkey + 2000 AS VARCHAR) END AS year_or_period,
       round(avg(c_acctbal), 6) AS value, 'dollars, all' AS unit FROM customer GROUP BY c_mktsegment, c_nationkey""")

register("S13_index_series", """
SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 6) AS bcpi, CAST(count(*) AS DOUBLE) AS ener, CAST(NULL AS DOUBLE) AS fish
FROM orders GROUP BY 1""")

register("S14_census", """
SELECT r.r_name AS region, c_mktsegment AS segment, count(*) AS customers_all
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""")

register("S17_csv_quirks", """
SELECT p_partkey AS id, '"' || p_name || '", in short, é' AS name, p_type AS type FROM part""")

register("S19_markdown_rows", """
SELECT '| ' || c_custkey || ' | ' || c_name || ' | ' || c_nationkey || ' |' AS line FROM customer""")

register("S20_missing_source", """
SELECT c_mktsegment AS region, count(*) AS rows, CAST(1 AS INTEGER) AS found FROM customer GROUP BY 1""")

register("S12_tidy_slice", """
SELECT CAST(day(ts) AS INTEGER) AS year, count(*) AS n, round(sum(value), 6) AS value
FROM events WHERE event_type = 'purchase' GROUP BY 1""")

register("S16_marketing_spend_file", """
SELECT CAST(l_partkey AS VARCHAR) AS show_title,
       DATE '2020-01-01' + CAST(l_partkey % 300 AS INTEGER) + CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 1 END AS date_key,
       round(sum(l_extendedprice * l_discount), 6) AS marketing_spend_calgary, CAST(NULL AS DOUBLE) AS marketing_spend_edmonton
FROM lineitem GROUP BY l_partkey""")

register("S16_first_date_column", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 1 END AS date_key
FROM orders""")


register("F16_segment_weights_json", scoring_ctes("segments") + """
SELECT title, '{' || string_agg('"' || segment || '":' || CAST(round(share, 4) AS VARCHAR), ',' ORDER BY pos) || '}'
       AS segment_weights
FROM segmix GROUP BY title""")

register("E06_attribution_text", attr_ctes() + """,
drv AS (
  SELECT title, name, shap, row_number() OVER (PARTITION BY title ORDER BY rank) AS k
  FROM contrib WHERE abs_impact >= 1.0
),
txt AS (
  SELECT title, string_agg(upper(substr(name, 1, 1)) || lower(substr(name, 2)) || ' '
                           || CASE WHEN shap > 0 THEN '+' ELSE '' END || printf('%.0f', round_even(shap, 0)), ' ' ORDER BY k) AS t
  FROM drv WHERE k <= 5 GROUP BY title
)
SELECT a.title,
       CASE WHEN t.t IS NULL THEN printf('%.0f', round_even(a.prediction, 0)) || ' tickets (insufficient signal to decompose)'
            ELSE printf('%.0f', round_even(a.prediction, 0)) || ' tickets (base ' || printf('%.0f', round_even(a.base_value, 0))
                 || ' ' || t.t || ')' END AS narrative
FROM attr a LEFT JOIN txt t USING (title)""")

_PHRASE_SQL = """CASE WHEN lower(name) LIKE '%familiarity%' OR lower(name) LIKE '%wiki%' THEN 'strong public recognition signals'
            WHEN lower(name) LIKE '%motivation%' OR lower(name) LIKE '%youtube%' THEN 'elevated engagement indicators'
            WHEN lower(name) LIKE '%season%' OR lower(name) LIKE '%month%' THEN 'favorable seasonal positioning'
            WHEN lower(name) LIKE '%remount%' OR lower(name) LIKE '%years_since%' THEN 'remount timing dynamics'
            WHEN lower(name) LIKE '%category%' THEN 'category-specific historical patterns'
            WHEN lower(name) LIKE '%prior%' OR lower(name) LIKE '%median%' THEN 'strong historical precedent'
            ELSE lower(replace(name, '_', ' ')) END"""


def _side_sql(cond: str, tag: str) -> str:
    return f"""
{tag}_ph AS (SELECT title, {_PHRASE_SQL} AS phrase, min(rank) AS r FROM contrib WHERE rank <= 5 AND {cond} GROUP BY 1, 2),
{tag}_l AS (
  SELECT title, list(phrase ORDER BY r) AS l FROM (
    SELECT *, row_number() OVER (PARTITION BY title ORDER BY r) AS k FROM {tag}_ph) WHERE k <= 3 GROUP BY title
),
{tag}_s AS (SELECT title, sum(shap) AS s FROM contrib WHERE rank <= 5 AND {cond} GROUP BY title),
{tag}_t AS (
  SELECT l.title, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2]
                  ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END AS descr, s.s
  FROM {tag}_l l JOIN {tag}_s s USING (title)
)"""


register("E10_driver_sentence", attr_ctes() + "," + _side_sql("shap > 0", "up") + "," + _side_sql("shap < 0", "dn") + """
SELECT a.title,
       coalesce(nullif(concat_ws(' ',
         CASE WHEN u.title IS NOT NULL THEN 'Key upward drivers include ' || u.descr
              || ', which collectively elevate the forecast by approximately ' || printf('%.1f', round_even(u.s, 1))
              || ' index points.' END,
         CASE WHEN d.title IS NOT NULL THEN 'Offsetting factors include ' || d.descr
              || ', which moderate expectations by roughly ' || printf('%.1f', round_even(abs(d.s), 1))
              || ' index points.' END), ''),
         'Feature contributions are relatively balanced, with no single factor dominating the prediction.') AS drivers
FROM attr a LEFT JOIN up_t u USING (title) LEFT JOIN dn_t d USING (title)""")

_A10_SOURCES = [
    ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                  "l_tax"], "l_shipdate", ["l_returnflag", "l_linestatus", "l_shipdate"]),
    ("orders", ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderdate", ["o_orderstatus", "o_orderdate", "o_orderpriority"]),
    ("events", ["event_id", "user_id", "value"], "ts", ["ts", "event_type", "props"]),
    ("customer", ["c_custkey", "c_nationkey", "c_acctbal"], None, ["c_name", "c_mktsegment"]),
]


def _a10_sql() -> str:
    parts = []
    for t, num, dcol, other in _A10_SOURCES:
        allc = num + other
        ncols = len(allc)
        nulls = " + ".join(f"CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END" for c in allc)
        outl = " + ".join(
            f"(SELECT CASE WHEN count({c}) > 10 AND count(*) FILTER (WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) > 0 "
            f"THEN 1 ELSE 0 END FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))"
            for c in num)
        miss, det = (1, "missing_expected:o_comment") if t == "orders" else (0, "")
        dmin = f"CAST(strftime(min(CAST({dcol} AS DATE)), '%Y%m%d') AS BIGINT)" if dcol else "CAST(NULL AS BIGINT)"
        dmax = f"CAST(strftime(max(CAST({dcol} AS DATE)), '%Y%m%d') AS BIGINT)" if dcol else "CAST(NULL AS BIGINT)"
        parts.append(f"""SELECT '{t}' AS source, count(*) AS row_count, CAST({ncols} AS BIGINT) AS column_count,
       CAST({nulls} AS BIGINT) AS columns_with_nulls, CAST(({outl}) AS BIGINT) AS columns_with_outliers,
       {dmin} AS date_min, {dmax} AS date_max, CAST({miss} AS BIGINT) AS errors, CAST({nulls} + ({outl}) AS BIGINT) AS warnings,
       '{det}' AS details FROM {t}""")
    return "\nUNION ALL\n".join(parts)


register("A10_registry_report", _a10_sql())

register("A10_registry_totals", "WITH r AS (" + _a10_sql() + """)
SELECT count(*) AS sources, count(*) FILTER (WHERE errors > 0) AS with_errors, count(*) FILTER (WHERE warnings > 0) AS with_warnings,
       CAST(sum(row_count) AS BIGINT) AS rows FROM r""")


def _levels(x: str, bands: list[tuple[int, str]], lowest: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {t} THEN '{label}'" for t, label in bands) + f" ELSE '{lowest}' END"


_SIGNAL = [(120, "exceptionally high"), (100, "strong"), (80, "above average"), (60, "moderate"), (40, "emerging")]
_TIER = [(120, "exceptional demand"), (105, "strong demand"), (95, "benchmark demand"), (80, "moderate demand"), (60, "developing demand")]

# the five paragraphs, sentence by sentence, with the season plan, the intent share and the driver sentence
register("E11_narrative", plan_ctes() + "," + B_ATTR + "," + _side_sql("shap > 0", "up") + "," + _side_sql("shap < 0", "dn") + f""",
it AS (SELECT l_partkey AS title, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS r FROM lineitem GROUP BY 1),
le AS (SELECT title, max(run_end) AS last_end FROM runs GROUP BY 1),
x AS (
  SELECT p.title, p."Month" AS mo, split_part(p."Month", ' ', 1) AS mn, p.category AS cat, p."Familiarity" AS fam, p."Motivation" AS mot,
         i."SignalOnly" AS sig, p.used, p.ff, s1.segment AS seg1, s2.segment AS seg2, p.sgl_a, p.sgl_e, it.r,
         CAST(floor(date_diff('day', le.last_end, p.run_date) / 365.25) AS INTEGER) AS ys,
         coalesce(nullif(concat_ws(' ',
           CASE WHEN u.title IS NOT NULL THEN 'Key upward drivers include ' || u.descr
                || ', which collectively elevate the forecast by approximately ' || printf('%.1f', round_even(u.s, 1)) || ' index points.' END,
           CASE WHEN n.title IS NOT NULL THEN 'Offsetting factors include ' || n.descr
                || ', which moderate expectations by roughly ' || printf('%.1f', round_even(abs(n.s), 1)) || ' index points.' END), ''),
           'Feature contributions are relatively balanced, with no single factor dominating the prediction.') AS drv
  FROM plan p JOIN imputed i USING (title) JOIN segmix s1 ON s1.title = p.title AND s1.rank = 1
  JOIN segmix s2 ON s2.title = p.title AND s2.rank = 2 LEFT JOIN it ON it.title = p.title LEFT JOIN le ON le.title = p.title
  LEFT JOIN up_t u ON u.title = p.title LEFT JOIN dn_t n ON n.title = p.title
)
SELECT title, mo AS "Month", concat_ws(' ',
  mo || ' — ' || CAST(title AS VARCHAR) || ' (' || cat || '). ' || CASE WHEN fam IS NOT NULL AND mot IS NOT NULL
    THEN 'Familiarity is ' || printf('%.1f', round_even(fam, 1)) || ' (' || {_levels("fam", _SIGNAL, "limited")} || ') and Motivation is '
         || printf('%.1f', round_even(mot, 1)) || ' (' || {_levels("mot", _SIGNAL, "limited")} || '), a '
         || CASE WHEN sig > 100 THEN 'strong' WHEN sig > 70 THEN 'moderate' ELSE 'emerging' END
         || ' level of public visibility across the four digital signals.'
    ELSE 'The forecast rests on a combined interest signal benchmarked across digital platforms.' END,
  CASE WHEN r IS NULL THEN NULL
       WHEN r < 0.05 THEN 'Only ' || printf('%.1f', round_even(r * 100, 1)) || '% of search interest looks like performance intent, so visibility may be inflated by unrelated references.'
       WHEN r > 0.30 THEN 'An intent ratio of ' || printf('%.1f', round_even(r * 100, 1)) || '% shows search interest closely tied to ticket buying.'
       ELSE 'An intent ratio of ' || printf('%.1f', round_even(r * 100, 1)) || '% indicates mixed digital intent.' END,
  CASE WHEN ys > 0 THEN 'This is a return engagement, last staged about ' || CAST(ys AS VARCHAR) || CASE WHEN ys = 1 THEN ' year' ELSE ' years' END
            || ' ago; ' || cat || ' titles ' || CASE WHEN ys >= 3 THEN 'usually gain from recognition on return.' ELSE 'often soften when remounted quickly.' END
       WHEN ys IS NOT NULL THEN 'This is a return engagement; familiarity effects follow earlier ' || cat || ' remounts.'
       ELSE 'Without local history the title is judged against comparable ' || cat || ' productions.' END,
  CASE WHEN ff > 1.05 THEN 'The ' || mn || ' slot carries a favourable seasonal factor of ' || printf('%.2f', round_even(ff, 2)) || '.'
       WHEN ff < 0.95 THEN 'The ' || mn || ' slot applies a softer seasonal factor of ' || printf('%.2f', round_even(ff, 2)) || '.'
       ELSE 'The ' || mn || ' slot is close to seasonally neutral (' || printf('%.2f', round_even(ff, 2)) || ').' END,
  drv,
  'A Ticket Index of ' || printf('%.1f', round_even(used, 1)) || ' puts it in the ' || {_levels("used", _TIER, "emerging demand")} || ' tier.',
  CASE WHEN sgl_a + sgl_e > 0 THEN 'Expected single tickets: ' || format('{{:,}}', CAST(sgl_a AS BIGINT)) || ' in AMERICA, '
       || format('{{:,}}', CAST(sgl_e AS BIGINT)) || ' in EUROPE (' || format('{{:,}}', CAST(sgl_a + sgl_e AS BIGINT)) || ' in total).' END,
  'The audience should lean toward ' || seg1 || ', with secondary appeal to ' || seg2 || '.') AS narrative
FROM x""")

# reports are written and read back: the tables themselves
for _report, _table in (("S19_board_report", "R02_board_summary"), ("S19_financial_report", "R03_financial_summary"),
                        ("S19_registry_report", "A10_registry_report"), ("S19_wide_plan_csv", "R04_wide_plan")):
    register(_report, ORACLES[_table])
