"""Catalog schema and the fixed values of the pricing application.

Every constant below is a value the reproduced application fixes (defaults,
thresholds, weights, labels).  They are stated plainly, in their natural order,
and every operator takes them as overridable parameters.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Raw catalog schema (dirty columns are read as strings and cleaned later)
# --------------------------------------------------------------------------
CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("productDisplayName", T.StringType(), True),
    T.StructField("articleType", T.StringType(), True),
    T.StructField("baseColour", T.StringType(), True),
    T.StructField("season", T.StringType(), True),
    T.StructField("material", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("demand", T.DoubleType(), True),
    T.StructField("inventory", T.DoubleType(), True),
    T.StructField("clicks", T.DoubleType(), True),
    T.StructField("search_volume", T.DoubleType(), True),
    T.StructField("reviews_count", T.DoubleType(), True),
    T.StructField("ratings", T.DoubleType(), True),
    T.StructField("discount_percentage", T.DoubleType(), True),
    T.StructField("freight_price", T.DoubleType(), True),
    T.StructField("competitor_prices", T.StringType(), True),
    T.StructField("holiday", T.StringType(), True),
    T.StructField("weekend", T.StringType(), True),
    T.StructField("weekday", T.StringType(), True),
    T.StructField("customer_segment", T.IntegerType(), True),
    T.StructField("optimal_price", T.StringType(), True),
])

# Cell texts that count as missing in a CSV file.
NA_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

CATEGORICAL_COLUMNS = ["articleType", "baseColour", "season", "material", "location"]
SIGNAL_COLUMNS = ["demand", "inventory", "clicks", "search_volume"]
FLAG_COLUMNS = ["holiday", "weekday", "weekend"]
NUMERIC_FEATURES = [
    "demand", "inventory", "clicks", "search_volume", "reviews_count", "ratings",
    "discount_percentage", "freight_price", "competitor_price_mean",
    "holiday", "weekday", "weekend", "customer_segment",
]

# --------------------------------------------------------------------------
# cleaning
# --------------------------------------------------------------------------
DEFAULT_PRODUCT_NAME = "Generic Product"
INVALID_PRICE_LIST_MEAN = 500.0
MISSING_PRICE = 500.0
CURRENT_PRICE_FLOOR = 50.0
FEATURE_FILL = 0.0
LABEL_FILL = 500.0
REVIEWS_DEFAULT = 0.5

# Widget ranges: (signal, low, high).  Competitor price differs by edition.
DOMAINS_OPTIMIZER = [
    ("demand", 0.0, 1.0),
    ("inventory", 0.0, 1.0),
    ("clicks", 0.0, 1.0),
    ("search_volume", 0.0, 1.0),
    ("competitor_price_mean", 200.0, 1000.0),
    ("discount_percentage", 0.0, 0.5),
    ("freight_price", 0.0, 100.0),
]
DOMAINS_PLAYGROUND = [
    ("demand", 0.0, 1.0),
    ("inventory", 0.0, 1.0),
    ("clicks", 0.0, 1.0),
    ("search_volume", 0.0, 1.0),
    ("competitor_price_mean", 100.0, 1500.0),
    ("ratings", 1.0, 5.0),
]

# --------------------------------------------------------------------------
# Search and signal thresholds
# --------------------------------------------------------------------------
NAME_LIST_SIZE = 50          # first distinct names (optimizer app)
POPULAR_LIST_SIZE = 25       # popular / first names (playground app)
HIGH_DEMAND = 0.8
LOW_INVENTORY = 0.2
HIGH_RATING = 4.0
OPPORTUNITY_DEMAND = 0.7
OPPORTUNITY_INVENTORY = 0.3
DISCOUNT_INVENTORY = 0.7
DISCOUNT_DEMAND = 0.3
PREMIUM_RATING = 4.0
PREMIUM_COMPETITOR = 400.0
EXAMPLES_SHOWN = 3

# --------------------------------------------------------------------------
# Features, weights, timing
# --------------------------------------------------------------------------
CLIP_LOW, CLIP_HIGH = -5.0, 5.0
SEASON_WEIGHT_FALLBACK = 3.0
HOLIDAY_WEIGHT_FALLBACK = 9.0
WEEKEND_WEIGHT_FALLBACK = 6.0
DEFAULT_SEASON = "Summer"

CALIBRATED_WEIGHTS = {
    "demand": 15.0,
    "inventory": 12.0,
    "clicks": 8.0,
    "search_volume": 8.0,
    "competitor_price_mean": 10.0,
    "holiday": 9.0,
    "ratings": 4.0,
    "reviews_count": 3.5,
    "weekend": 6.0,
    "month": 2.5,
    "weekday": 2.0,
    "customer_segment": 0.8,
}

# (label, holiday, weekend)
TIMING_OPTIONS = [
    ("Normal Day", 0.0, 0.0),
    ("Holiday/Event", 1.0, 0.0),
    ("Weekend Effect", 0.0, 1.0),
]

# --------------------------------------------------------------------------
# Importances and impacts
# --------------------------------------------------------------------------
SIGNAL_IMPORTANCE = {
    "demand": 0.15,
    "inventory": 0.12,
    "competitor_price_mean": 0.10,
    "holiday": 0.09,
    "clicks": 0.08,
    "search_volume": 0.08,
    "ratings": 0.04,
}
IMPORTANCE_FALLBACK = 0.05
IMPACT_BASE = 0.5
IMPACT_SCALE = 150.0
IMPACT_DAMPING_LIMIT = 2.0
LINEAR_IMPACT_SCALE = 100.0
LINEAR_COMPETITOR_BASE = 500.0
LINEAR_COMPETITOR_SCALE = 0.8

# --------------------------------------------------------------------------
# Model outputs and KPIs
# --------------------------------------------------------------------------
FOREST_TREES = 50
PREDICTION_FLOOR = 100.0
PREDICTION_CLAMP = (50.0, 2000.0)
SAMPLE_SIZE = 500
SAMPLE_SEED = 42
COST_RATE = 0.7
VOLUME_FACTOR = 6000.0
VOLUME_CLAMP = (1000.0, 5000.0)
PRICE_TIERS = [(700.0, "PREMIUM"), (400.0, "COMPETITIVE")]
PRICE_TIER_ELSE = "OPPORTUNITY"
SCORE_LEVELS = [(2.5, "ELITE"), (1.5, "PREMIUM")]
SCORE_LEVEL_ELSE = "OPTIMAL"
SCARCITY_FLOOR = 0.01
HOLIDAY_TIMING = 2.5
WEEKEND_TIMING = 1.8
SCORE_WEIGHTS = {"scarcity": 0.3, "engagement": 0.25, "timing": 0.2, "quality": 0.25}

# (signal, high, medium, inverted)
SIGNAL_RULES = [
    ("demand", 0.7, 0.4, False),
    ("inventory", 0.3, 0.7, True),
    ("clicks", 0.6, 0.3, False),
    ("search_volume", 0.6, 0.3, False),
    ("ratings", 4.0, 3.5, False),
]
COMPETITOR_BAND = (0.9, 1.1)
LEGACY_COMPETITOR_DIVISOR = 500.0

CONFIDENCE_LEVELS = [(20.0, "High"), (50.0, "Medium")]
CONFIDENCE_ELSE = "Low"
STRATEGY_PREMIUM = ("Premium Positioning", 0.7, 4.0)
STRATEGY_COMPETITIVE = ("Competitive Pricing", 400.0)
STRATEGY_ELSE = "Market Standard"
RECOMMENDATION_LABELS = ("Price Increase Recommended", "Price Reduction Recommended", "Price Stable")
DIRECTION_LABELS = ("INCREASE", "DECREASE", "ADJUSTMENT")

MODEL_FIT_LEVELS = [(0.7, "Excellent Model Fit"), (0.5, "Good Model Fit")]
MODEL_FIT_ELSE = "Fair Model Fit"
MODEL_ACCURACY_MAE = 100.0
MODEL_ACCURACY_LABELS = ("High Accuracy", "Moderate Accuracy")
QUALITY_LEVELS = [(5.0, "Excellent Data Quality"), (15.0, "Good Data Quality")]
QUALITY_ELSE = "Data Quality Concern"
CORR_BANDS = [(0.3, "Strong Positive Relationship"), (0.0, "Moderate Positive Relationship")]
CORR_ELSE = "Weak/No Relationship"

CORRELATION_COLUMNS = [
    "demand", "clicks", "search_volume", "inventory", "ratings",
    "discount_percentage", "freight_price", "optimal_price",
]
CORRELATION_MIN_COLUMNS = 3
PRICE_BINS = 50
SIGNAL_BINS = 20
RESIDUAL_BINS = 30
TOP_CATEGORIES = 10
MISSING_SHOWN = 20
MISSING_TOP = 10
TOP_DRIVERS = 5
