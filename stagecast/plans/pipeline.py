"""Flagship: score titles — indices, de-seasoned history, tiered imputation, segments, cities.

``ScoringPlan`` wires the operators into one lazy plan. Every stage is a
DataFrame attribute so queries and tests can look at any intermediate table;
nothing is collected. Small results the driver would otherwise hold as
scalars (benchmark row, model coefficients) stay 1-row / per-category
DataFrames joined back in (broadcast only when the row count is bounded by
construction: 1-row tables and configuration tables).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast import config as C
from stagecast.functions import columns as P
from stagecast.functions import signals as SG
from stagecast.operators import allocate as AL
from stagecast.operators import models as M
from stagecast.operators import robust as RB
from stagecast.operators import runs as R
from stagecast.operators import scoring as SC
from stagecast.session import cut, ensure_checkpoint_dir
from stagecast.sources import binding as B

SIGNALS = ("wiki", "trends", "youtube", "chartmetric")


class ScoringPlan:
    """Lazy scoring plan over (titles, baselines, history, segment priors).

    titles:    title, category, gender [, name]          — every title to score
    baselines: title, wiki, trends, youtube, chartmetric  — titles with known signals
    history:   title, city, start_date, single_tickets    — dated sales (line or pre-aggregated)
    priors:    region, category, segment, weight          — segment priors
    """

    def __init__(self, titles: DataFrame, baselines: DataFrame, history: DataFrame, priors: DataFrame,
                 cfg: C.ScoringConfig | None = None, segments: Sequence[str] | None = None,
                 mult: dict | None = None, cities: Sequence[str] = ("Calgary", "Edmonton"),
                 benchmark_title=None, materialize: str = "checkpoint"):
        self.cfg = cfg or C.ScoringConfig()
        self.titles = titles
        self.baselines = baselines
        self.history = history
        self.priors = priors
        self.segments = list(segments or C.SEGMENT_KEYS_IN_ORDER)
        self.mult = C.SEGMENT_MULT if mult is None else mult
        self.cities = list(cities)
        self.benchmark_title = benchmark_title
        self.spark = titles.sparkSession
        self.materialize = materialize

    def _mat(self, df: DataFrame, ends: bool = False) -> DataFrame:
        """Keep a stage that several later stages read.

        With ``ends`` it ends a long lineage (history cube, runs, title statistics, indexed table): 'checkpoint'
        writes it to the shared ``spark.checkpoint.dir`` as Parquet. The others (past runs, seasonality, signal base, scored table)
        are persisted: computed with the first job that reads them, recomputed from the last cut if an
        executor is lost. Small derived tables (priors, benchmark, city shares) stay lazy. 'persist' never
        checkpoints, 'none' leaves the plan inlined.
        """
        if self.materialize == "checkpoint" and ends:
            return cut(df)
        if self.materialize in ("checkpoint", "persist"):
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        return df

    # ---------------------------------------------------------------- history
    def run_history(self) -> DataFrame:
        """Title, day and tickets of the history: all that the runs read."""
        return self.history

    @cached_property
    def runs(self) -> DataFrame:
        """A01 production runs with mid date."""
        return self._mat(R.mid_dates(R.anchored_runs(self.run_history(), "title", "start_date", "single_tickets",
                                                     self.cfg.run_gap_days)), ends=True)

    @cached_property
    def title_stats(self) -> DataFrame:
        """A02 and J14 of every title, one row each: read by the past runs, the benchmark and the index."""
        return self._mat(R.prior_stats(self.runs, "title", "tickets").join(
            R.last_mid_date(self.runs).withColumnRenamed("title", "_t"), F.col("title").eqNullSafe(F.col("_t"))).drop("_t"), ends=True)

    @cached_property
    def prior(self) -> DataFrame:
        """A02 per-title median / total / count of run totals."""
        return self.title_stats.drop("mid_date")

    @cached_property
    def last_mid(self) -> DataFrame:
        """J14 title -> mid date of the latest run."""
        return self.title_stats.select("title", "mid_date")

    @cached_property
    def past_runs(self) -> DataFrame:
        """J15 runs with category (baseline/title table) and the title's ticket median."""
        cat = self.titles.select("title", "category")
        return self._mat(self.runs.join(cat, "title", "left")
                         .join(self.prior.select("title", "ticket_median"), "title", "left"))

    @cached_property
    def seasonality(self) -> DataFrame:
        """A07 category x month factors."""
        return self._mat(RB.seasonality_table(self.past_runs, "category", "month", "ticket_median",
                                              self.cfg.k_shrink, self.cfg.season_clip, self.cfg.winter_pool))

    # ---------------------------------------------------------------- signals
    @cached_property
    def base(self) -> DataFrame:
        """J11 + P11 + F01: known titles take baseline signals (Source=Baseline), others are
        estimated (Source=Estimated); raw familiarity / motivation for the scoring segment."""
        t = self.titles
        b = self.baselines.select("title", *SIGNALS)
        known = t.join(b, "title", "left_semi").join(b, "title")
        unknown = t.join(b, "title", "left_anti")
        est = SG.estimate_unknown(unknown, b, "category")
        rows = (known.withColumn("Source", F.lit("Baseline"))
                .unionByName(est.withColumn("Source", F.lit("Estimated"))))
        seg = self.cfg.scoring_segment or self.segments[0]
        return self._mat(SC.raw_scores(rows, seg, self.cfg.region_key, self.mult))

    @cached_property
    def benchmark(self) -> DataFrame:
        """One row: the benchmark title's base row plus its ticket median and hist factor.
        Default benchmark = smallest title key with ticket history."""
        if self.benchmark_title is not None:
            key = self.spark.createDataFrame([(self.benchmark_title,)], "title " +
                                             dict(self.titles.dtypes)["title"])
        else:
            key = self.prior.agg(F.min("title").alias("title"))
        row = (self.base.join(F.broadcast(key), "title")
               .join(self.prior.select("title", F.col("ticket_median").alias("bench_median")), "title", "left")
               .join(self.last_mid.select("title", F.col("mid_date").alias("_bmid")), "title", "left"))
        if self.cfg.proposed_month is not None:
            row = RB.attach_factor(row, self.seasonality, "category", "_bmid", "bench_hist_factor")
        else:
            row = row.withColumn("bench_hist_factor", F.lit(1.0))
        n = row.count()   # one small action: the benchmark must be exactly one title (D21)
        if n != 1:
            raise ValueError(f"benchmark must match exactly one scored title with signals, found {n}")
        return row

    @cached_property
    def indexed(self) -> DataFrame:
        """F02/F03 + F05: benchmark indices, SignalOnly, de-seasoned ticket index."""
        d = SC.benchmark_index(self.base, self.benchmark)
        d = (d.join(self.prior, "title", "left")
             .withColumnRenamed("ticket_median", "TicketMedian")
             .join(self.last_mid, "title", "left"))
        if self.cfg.proposed_month is not None:
            d = RB.attach_factor(d, self.seasonality, "category", "mid_date", "_hf")
        else:
            d = d.withColumn("_hf", F.lit(1.0))
        d = d.withColumn("HistSeasonalityFactor", F.when(F.col("TicketMedian").isNotNull(), F.col("_hf"))).drop("_hf")
        d = SC.deseason_index(d, self.benchmark)
        return self._mat(d.withColumn("ticket_median_prior", F.col("TicketMedian"))
                         .withColumn("run_count_prior", F.coalesce(F.col("run_count_prior"), F.lit(0)).cast("bigint")), ends=True)

    # ---------------------------------------------------------------- models
    @cached_property
    def known(self) -> DataFrame:
        return self.indexed.where(F.col("TicketIndex_DeSeason").isNotNull())

    @cached_property
    def overall_model(self) -> DataFrame:
        """F06 anchored ridge (n >= 5)."""
        return M.anchored_ridge(self.known, "SignalOnly", "TicketIndex_DeSeason", self.cfg.overall_alpha)

    @cached_property
    def category_models(self) -> DataFrame:
        """F07 per-category ridge / OLS (n >= 3)."""
        return M.group_fit(self.known, "category", "SignalOnly", "TicketIndex_DeSeason", self.cfg.category_alpha)

    @cached_property
    def imputed(self) -> DataFrame:
        """F10 tiered imputation, F11 future factor, F12 composite, F13 estimates."""
        d = M.tiered_impute(self.indexed, self.overall_model, self.category_models, "category",
                            clip=self.cfg.prediction_clip)
        if self.cfg.proposed_month is not None:
            d = RB.attach_factor(d, self.seasonality, "category", F.lit(self.cfg.proposed_month),
                                 "FutureSeasonalityFactor", is_month=True)
        else:
            d = d.withColumn("FutureSeasonalityFactor", F.lit(1.0))
        d = d.withColumn("EffectiveTicketIndex", F.col("TicketIndex_DeSeason_Used") * F.col("FutureSeasonalityFactor"))
        d = d.withColumn("Composite", SC.composite(weight=self.cfg.blend_weight))
        d = d.withColumn("EstimatedTickets", SC.estimated_tickets())
        return d.withColumn("EstimatedTickets_Final", SC.final_tickets(factor=self.cfg.postcovid_factor))

    # ---------------------------------------------------------------- allocation
    @cached_property
    def city_shares(self) -> tuple[DataFrame, DataFrame]:
        ts, cs = AL.learn_city_shares(self.history, self.titles.select("title", "category"), self.cities,
                                      "title", "city", "single_tickets", "category", self.cfg.city_clip)
        return ts, cs

    def segment_index(self, rows: DataFrame) -> DataFrame:
        """F04 — ``rows`` plus ``_seg_idx``: per segment, the signal index against the benchmark title's."""
        safe = {s: F.coalesce(F.nanvl(F.col(s), F.lit(0.0)), F.lit(0.0)) for s in SIGNALS}
        fam0 = safe["wiki"] * 0.55 + safe["trends"] * 0.30 + safe["chartmetric"] * 0.15
        mot0 = safe["youtube"] * 0.45 + safe["trends"] * 0.25 + safe["chartmetric"] * 0.15 + safe["wiki"] * 0.15
        raw = SC.segment_raw_pair(F.col("gender"), F.col("category"), fam0, mot0, self.segments, self.mult)
        bench = F.broadcast(self.benchmark.select(raw.alias("_braw")))       # one row
        d = rows.crossJoin(bench).withColumn("_raw", raw)
        return d.withColumn("_seg_idx", SC.segment_signal_index(F.col("_raw"), F.col("_braw"))).drop("_raw", "_braw")

    @cached_property
    def scored(self) -> DataFrame:
        """Segment mix and tickets, city split and tickets, plus flags."""
        pri = AL.prior_weights(self.priors, self.cfg.region_key, self.segments, self.cfg.segment_prior_strength)
        d = self.segment_index(self.imputed).join(pri, F.col("category") == F.col("_prior_cat"), "left")
        d = AL.add_segment_mix(d, "_seg_idx", "prior_weights", "EstimatedTickets", "segment_mix")
        ts, cs = self.city_shares
        d = AL.city_split(d, ts, cs, self.cfg.default_city_split, "title", "category")
        m = self.cfg.proposed_month
        mcol = F.lit(m).cast("int")
        d = d.select(
            "*",
            F.col("segment_mix")[0]["segment"].alias("PredictedPrimarySegment"),
            F.col("segment_mix")[1]["segment"].alias("PredictedSecondarySegment"),
            F.col("segment_mix")[0]["segment"].alias("dominant_audience_segment"),
            AL.segment_weights_json(F.col("segment_mix")).alias("segment_weights"),
            AL.city_allocation(F.col("city_split"), F.col("EstimatedTickets_Final"), self.cities).alias("city_alloc"),
            mcol.alias("month_of_opening"),
            P.holiday_flag(mcol).alias("holiday_flag"),
            F.col("FutureSeasonalityFactor").alias("category_seasonality_factor"),
            F.lit(0.0).alias("ReturnDecayPct"),
            F.lit(C.REMOUNT_FACTOR).alias("ReturnDecayFactor"),
            F.lit(m is not None).alias("SeasonalityApplied"),
            mcol.alias("SeasonalityMonthUsed"),
            P.month_name(mcol).alias("RunMonth"))
        return self._mat(d.drop("_prior_cat", "prior_weights", "_seg_idx"))

    def wide(self) -> DataFrame:
        """The scored table with one column per segment/city (pivot only for the final table)."""
        d = self.scored
        for i, s in enumerate(self.segments):
            el = F.filter(F.col("segment_mix"), lambda e, _i=i: e["pos"] == _i)[0]
            d = d.withColumn(f"Mix_{i}", el["share"]).withColumn(f"Seg_{i}_Tickets", el["tickets"])
        for i, c in enumerate(self.cities):
            d = (d.withColumn(f"CityShare_{c}", F.col("city_alloc")[i]["share"])
                 .withColumn(f"{c}_Total", F.col("city_alloc")[i]["tickets"]))
        return d


# ------------------------------------------------------------------ driver-table binding
# FIXED VALUES (binding) — audience segments of the driver tables, in reporting order
BINDING_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BINDING_GENDERS = ["female", "male", "co", "na"]
BINDING_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def binding_multipliers() -> dict:
    """Segment multipliers for the driver tables, generated by a rule:
    gender j: 1 + 0.04 * ((i + j) % 3 - 1); category k: 1 + 0.05 * ((i + 2k) % 5 - 2)."""
    out = {}
    for i, s in enumerate(BINDING_SEGMENTS):
        d = {g: round(1 + 0.04 * ((i + j) % 3 - 1), 4) for j, g in enumerate(BINDING_GENDERS)}
        d.update({c: round(1 + 0.05 * ((i + 2 * k) % 5 - 2), 4) for k, c in enumerate(BINDING_CATEGORIES)})
        out[s] = d
    return out


def binding_priors(cube: DataFrame) -> DataFrame:
    """Segment priors from history revenue: weight = segment share of (region, category) revenue x
    number of segments; regions = each city plus 'Province' (all cities)."""
    n_seg = float(len(BINDING_SEGMENTS))
    by_city = cube.groupBy(F.col("city").alias("region"), F.col("category"), "segment").agg(F.sum("revenue").alias("rv"))
    prov = cube.groupBy(F.lit("Province").alias("region"), F.col("category"), "segment").agg(F.sum("revenue").alias("rv"))
    u = by_city.unionByName(prov)
    tot = u.groupBy("region", "category").agg(F.sum("rv").alias("_t"))
    return (u.join(tot, ["region", "category"])
            .select("region", "category", "segment", (F.col("rv") / F.col("_t") * n_seg).alias("weight")))


class TablePlan(ScoringPlan):
    """Plan over the driver tables: the history cube and the priors are made when a stage first reads them.

    Stages that read the runs alone (no city, no segment, no revenue) take them from the sales lines: of these
    only key, title, day and quantity are shuffled, and no cube is aggregated and written for them.
    """

    def __init__(self, sf_dir: str, hidden_every: int, titles: DataFrame, baselines: DataFrame, cfg: C.ScoringConfig, materialize: str):
        super().__init__(titles, baselines, None, None, cfg, BINDING_SEGMENTS, binding_multipliers(), B.CITIES, materialize=materialize)
        del self.history, self.priors
        self.sf_dir, self.hidden_every = sf_dir, hidden_every

    @cached_property
    def history(self) -> DataFrame:
        return self._mat(B.history_cube(self.spark, self.sf_dir, self.hidden_every), ends=True)

    @cached_property
    def priors(self) -> DataFrame:
        return binding_priors(self.history.join(self.titles.select("title", "category"), "title"))

    def run_history(self) -> DataFrame:
        """The cube if a stage has read it already (``scored`` does), else the sales lines with the cube's filter."""
        if "history" in self.__dict__:
            return self.history
        tickets = F.col("single_tickets")
        return B.history(self.spark, self.sf_dir, self.hidden_every).where(tickets.isNotNull() & (tickets >= 0)).select(
            "title", "start_date", "single_tickets")

    @cached_property
    def scored(self) -> DataFrame:
        self.history        # read here anyway: made first, so that the runs need no scan of the lines of their own
        return super().scored


_PLANS: dict = {}


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """Paths, sizes and times of the files in a folder: a changed table is another plan."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))


def plan_from_tables(spark: SparkSession, sf_dir: str, proposed_month: int | None = 3,
                     materialize: str = "checkpoint", hidden_every: int = 0) -> ScoringPlan:
    """Bind the driver tables (see ``stagecast.sources.binding``) and build the plan.

    One plan per (application, files of the folder, month, mode, hidden titles) is kept so that queries
    reading different stages of the same plan share its checkpointed stages.
    """
    ensure_checkpoint_dir(spark)
    memo = (spark.sparkContext.applicationId, _files(spark, sf_dir), proposed_month, materialize, hidden_every)
    if memo in _PLANS:
        return _PLANS[memo]
    titles = B.titles(spark, sf_dir)
    base = B.baselines(spark, sf_dir)
    if materialize != "none":
        base = base.persist(StorageLevel.MEMORY_AND_DISK)      # per-title signals: read by the base rows and the medians
    cfg = replace(C.ScoringConfig(), proposed_month=proposed_month, region_key="Province",
                  default_city_split=dict(B.DEFAULT_SPLIT))
    plan = TablePlan(sf_dir, hidden_every, titles, base, cfg, materialize)
    _PLANS[memo] = plan
    return plan


FLAGSHIP_COLUMNS = [
    "title", "category", "gender", "Source", "FamiliarityRaw", "MotivationRaw", "Familiarity", "Motivation",
    "SignalOnly", "TicketMedian", "HistSeasonalityFactor", "TicketIndex_DeSeason", "prior_total_tickets",
    "run_count_prior", "TicketIndex_DeSeason_Used", "TicketIndexSource", "TicketIndex_Predicted",
    "FutureSeasonalityFactor", "EffectiveTicketIndex", "Composite", "EstimatedTickets", "EstimatedTickets_Final",
    "PredictedPrimarySegment", "PredictedSecondarySegment",
]


def score_titles_from_tables(spark: SparkSession, sf_dir: str, proposed_month: int | None = 3) -> DataFrame:
    """Flagship query: scored table for every title, with per-city tickets as columns."""
    plan = plan_from_tables(spark, sf_dir, proposed_month)
    d = plan.scored
    cols = [F.col(c) for c in FLAGSHIP_COLUMNS]
    for i, c in enumerate(plan.cities):
        cols.append(F.col("city_alloc")[i]["tickets"].alias(f"tickets_{c}"))
    return d.select(*cols)
