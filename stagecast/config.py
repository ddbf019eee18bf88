"""Model constants and rule tables.

Values in the blocks marked FIXED VALUES must equal the ones the original
planning tool uses, so that results agree; they are written out plainly in
their natural order. Everything else in the library takes these as default
parameters and can be overridden per call.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# FIXED VALUES — scoring weights, tunables, clip ranges, defaults
# --------------------------------------------------------------------------
FAMILIARITY_WEIGHTS = {"wiki": 0.55, "trends": 0.30, "chartmetric": 0.15}
MOTIVATION_WEIGHTS = {"youtube": 0.45, "trends": 0.25, "chartmetric": 0.15, "wiki": 0.15}

RUN_GAP_DAYS = 60                 # anchored run window, days from the run's first date
K_SHRINK = 3.0                    # seasonality shrinkage w = n / (n + K)
SEASON_MIN_FACTOR, SEASON_MAX_FACTOR = 0.90, 1.15
WINTER_POOL = (12, 1, 2)
TICKET_BLEND_WEIGHT = 0.50        # composite = (1-w)*signal + w*ticket index
CITY_CLIP_RANGE = (0.15, 0.85)
PREDICTION_CLIP = (20.0, 180.0)
OVERALL_RIDGE_ALPHA = 5.0
CATEGORY_RIDGE_ALPHA = 1.0
OVERALL_MIN_ROWS = 5
CATEGORY_MIN_ROWS = 3
CATEGORY_RIDGE_MIN_ROWS = 5
ANCHOR_LOW = (0.0, 25.0)          # SignalOnly 0   -> index 25
ANCHOR_HIGH = (100.0, 100.0)      # SignalOnly 100 -> index 100
SEGMENT_SHARE_FLOOR = 1e-9
POSTCOVID_FACTOR = 1.0
REMOUNT_FACTOR = 1.0
HOLIDAY_MONTHS = (11, 12, 1)
SEASON_MONTH_ORDER = (9, 10, 11, 12, 1, 2, 3, 4, 5, 6)   # board summary month order, unknown last
PLAN_START_YEAR_MONTHS = (9, 10, 12)                    # run year = season start year for these

# Unknown-title estimate: fallback medians and clip bounds per signal
UNKNOWN_FALLBACK_MEDIANS = {"wiki": 60.0, "trends": 55.0, "youtube": 60.0, "chartmetric": 58.0}
UNKNOWN_CLIP = {"wiki": (30.0, 120.0), "trends": (30.0, 120.0),
                "youtube": (40.0, 140.0), "chartmetric": (35.0, 120.0)}

# Economic / weather factors
ECON_WEIGHTS = {"oil": 0.4, "unemployment": 0.6}
ECON_OIL_REF, ECON_UNEMP_REF = 60.0, 6.0
ECON_CLIP = (0.85, 1.10)
WEATHER_COLD_LIMIT, WEATHER_COLD_MULT = -20.0, 0.90
WEATHER_SNOW_LIMIT, WEATHER_SNOW_MULT = 10.0, 0.95
WEATHER_CLIP = (0.85, 1.05)

# --------------------------------------------------------------------------
# FIXED VALUES — audience segments, in their reporting order
# --------------------------------------------------------------------------
SEGMENT_KEYS_IN_ORDER = [
    "General Population",
    "Core Classical (F35–64)",
    "Family (Parents w/ kids)",
    "Emerging Adults (18–34)",
]

# FIXED VALUES — segment multipliers by lead gender and by category
SEGMENT_MULT = {
    "General Population": {
        "female": 1.00, "male": 1.00, "co": 1.00, "na": 1.00,
        "family_classic": 1.00, "classic_romance": 1.00, "romantic_tragedy": 1.00,
        "classic_comedy": 1.00, "contemporary": 1.00, "pop_ip": 1.00, "dramatic": 1.00,
        "adult_literary_drama": 1.00, "contemporary_mixed_bill": 1.00,
        "touring_contemporary_company": 1.00,
    },
    "Core Classical (F35–64)": {
        "female": 1.12, "male": 0.95, "co": 1.05, "na": 1.00,
        "family_classic": 1.10, "classic_romance": 1.08, "romantic_tragedy": 1.05,
        "classic_comedy": 1.02, "contemporary": 0.90, "pop_ip": 1.00, "dramatic": 1.00,
        "adult_literary_drama": 1.00, "contemporary_mixed_bill": 0.90,
        "touring_contemporary_company": 0.90,
    },
    "Family (Parents w/ kids)": {
        "female": 1.10, "male": 0.92, "co": 1.06, "na": 1.00,
        "family_classic": 1.18, "classic_romance": 0.95, "romantic_tragedy": 0.85,
        "classic_comedy": 1.05, "contemporary": 0.82, "pop_ip": 1.20, "dramatic": 0.90,
        "adult_literary_drama": 0.90, "contemporary_mixed_bill": 0.82,
        "touring_contemporary_company": 0.82,
    },
    "Emerging Adults (18–34)": {
        "female": 1.02, "male": 1.02, "co": 1.00, "na": 1.00,
        "family_classic": 0.95, "classic_romance": 0.92, "romantic_tragedy": 0.90,
        "classic_comedy": 0.98, "contemporary": 1.25, "pop_ip": 1.15, "dramatic": 1.05,
        "adult_literary_drama": 1.05, "contemporary_mixed_bill": 1.25,
        "touring_contemporary_company": 1.25,
    },
}

# FIXED VALUES — region multipliers
REGION_MULT = {"Province": 1.00, "Calgary": 1.05, "Edmonton": 0.95}

# FIXED VALUES — default city split
DEFAULT_CITY_SPLIT = {"Calgary": 0.60, "Edmonton": 0.40}

# FIXED VALUES — city name patterns (lower-case substring -> canonical city)
CITY_PATTERNS = [("calg", "Calgary"), ("edm", "Edmonton")]

# FIXED VALUES — title alias (curly apostrophe -> straight)
TITLE_ALIASES = {"Handmaid’s Tale": "Handmaid's Tale"}

# FIXED VALUES — category bumps for titles without signals
UNKNOWN_CATEGORY_BUMPS = {
    "family_classic": {"wiki": 6, "trends": 3, "chartmetric": 2},
    "classic_romance": {"wiki": 4, "trends": 2},
    "contemporary": {"youtube": 6, "trends": 2},
    "pop_ip": {"chartmetric": 10, "trends": 5, "youtube": 4},
    "romantic_tragedy": {"wiki": 3},
    "classic_comedy": {"trends": 2},
    "dramatic": {},
    "adult_literary_drama": {"wiki": 3, "trends": 3},
    "contemporary_mixed_bill": {"youtube": 4, "trends": 2},
    "touring_contemporary_company": {"youtube": 5, "trends": 3, "chartmetric": 2},
}

# --------------------------------------------------------------------------
# FIXED VALUES — title text rules (lower-case substring match, first rule wins)
# --------------------------------------------------------------------------
GENDER_RULES = [
    # (gender, all_of, any_of)
    ("co", ["romeo", "juliet"], []),
    ("female", [], ["cinderella", "sleeping", "beauty and the beast", "beauty", "giselle", "swan",
                    "widow", "alice", "juliet", "sylphide", "carmina burana"]),
    ("male", [], ["pinocchio", "peter pan", "don quixote", "hunchback", "hamlet", "frankenstein",
                  "romeo", "nijinsky"]),
]
GENDER_DEFAULT = "na"

CATEGORY_RULES = [
    ("family_classic", ["wizard", "peter pan", "pinocchio", "hansel", "frozen", "beauty", "alice",
                        "die fledermaus"]),
    ("classic_romance", ["swan", "sleeping", "cinderella", "giselle", "sylphide"]),
    ("romantic_tragedy", ["romeo", "hunchback", "notre dame", "hamlet", "frankenstein"]),
    ("classic_comedy", ["don quixote", "merry widow"]),
    ("contemporary", ["contemporary", "boyz", "ballet boyz", "momix", "complexions", "grimm",
                      "nijinsky", "shadowland", "deviate", "phi", "der wolf", "rite of spring",
                      "beethoven"]),
    ("pop_ip", ["taj", "tango", "harlem", "tragically hip", "l cohen", "leonard cohen"]),
]
CATEGORY_DEFAULT = "dramatic"

# Show type: (show_type, title keywords, categories); first rule wins, else by category map
SHOW_TYPE_RULES = [
    ("guest_company", ["trockadero", "ballet bc", "shaping sound", "dance theatre of harlem",
                       "complexions", "bjm", "momix", "ballet boyz", "diavolo"],
     ["touring_contemporary_company"]),
    ("mixed_bill", ["mixed bill", "unleashed", "deviate"], ["contemporary_mixed_bill"]),
    ("contemporary_show", ["nijinsky", "der wolf", "rite of spring", "grimm"], []),
    ("family_ballet", ["wizard of oz", "hansel", "cinderella", "peter pan", "pinocchio",
                       "once upon a time", "jungle book", "addams family"], ["family_classic"]),
    ("classical_ballet", ["sleeping beauty", "romeo and juliet", "swan lake", "giselle",
                          "don quixote", "la sylphide", "coppelia", "la bayadere",
                          "la fille mal gardée", "die fledermaus"],
     ["classic_romance", "classic_comedy", "romantic_tragedy"]),
    ("contemporary_show", [], ["adult_literary_drama", "contemporary", "pop_ip", "dramatic"]),
]
SHOW_TYPE_DEFAULT = "unknown"

# FIXED VALUES — title-match hint tokens for video titles
TITLE_MATCH_HINTS = ["ballet", "pas", "variation", "act", "scene", "solo", "adagio", "coda"]


@dataclass(frozen=True)
class ScoringConfig:
    """Per-call parameters of the scoring pipeline (defaults = the fixed values)."""

    run_gap_days: int = RUN_GAP_DAYS
    k_shrink: float = K_SHRINK
    season_clip: tuple[float, float] = (SEASON_MIN_FACTOR, SEASON_MAX_FACTOR)
    winter_pool: tuple[int, ...] = WINTER_POOL
    blend_weight: float = TICKET_BLEND_WEIGHT
    city_clip: tuple[float, float] = CITY_CLIP_RANGE
    prediction_clip: tuple[float, float] = PREDICTION_CLIP
    overall_alpha: float = OVERALL_RIDGE_ALPHA
    category_alpha: float = CATEGORY_RIDGE_ALPHA
    region_key: str = "Province"
    scoring_segment: str | None = None
    proposed_month: int | None = None
    segment_prior_strength: float = 1.0
    postcovid_factor: float = POSTCOVID_FACTOR
    default_city_split: dict = field(default_factory=lambda: dict(DEFAULT_CITY_SPLIT))
