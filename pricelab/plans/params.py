"""Parameters of the registered queries (shared by the Spark side and the SQL twins)."""

SEARCH_TERM = "ring"
SEARCH_REGEX = "^(RED|blue) r.ng$"
SEARCH_LITERAL = "g (V1.5)"
#: More expressions for the name index: without a trigram, with a group, a class, something optional, an alternative.
INDEX_TERMS = ["ri", "s(mal|hin).* widget", "[rb].. ring", "cold? w+idget$", "ring|bolt", "^SMALL .*"]
NO_MATCH_TERM = "zzz-no-such-product"

# A model's feature list (an artifact of training): numeric signals, one signal
# absent from the catalog (lag_price), and one-hot names including a category
# the data lacks.  search_volume is deliberately not a model feature.
FEATURES_FIXED = [
    "demand", "inventory", "clicks", "competitor_price_mean", "discount_percentage",
    "freight_price", "ratings", "reviews_count", "holiday", "weekday", "weekend",
    "customer_segment", "lag_price",
    "articleType_ECONOMY", "articleType_PROMO", "articleType_SMALL", "articleType_UNSEEN",
    "baseColour_blue", "baseColour_red", "season_Fall", "season_Spring", "season_Summer",
    "season_Winter", "material_Brand#1", "material_Brand#2", "location_AMERICA",
    "location_EUROPE", "location_MIDDLE EAST",
]

WEIGHTED_SIGNALS = ["demand", "inventory", "clicks", "search_volume", "competitor_price_mean",
                    "ratings", "reviews_count", "holiday", "weekend", "weekday",
                    "customer_segment"]

LINEAR_SIGNALS = ["demand", "inventory", "clicks", "search_volume", "competitor_price_mean",
                  "ratings", "discount_percentage"]

ENCODED_LOOKUP_COLUMNS = ["competitor_price_mean", "demand", "articleType_SMALL"]

# Per-signal weights that are not one.
SIGNAL_WEIGHTS = {"demand": 1.5, "inventory": 0.5, "clicks": 2.0, "search_volume": 1.2,
                  "competitor_price_mean": 0.8, "discount_percentage": 0.1, "freight_price": 3.0}

# Missing cells of a CSV catalog, written as the markers that such files carry.
NA_CELLS = {"productDisplayName": "NA", "ratings": "NaN", "competitor_prices": "n/a",
            "holiday": "None", "demand": "null", "location": "N/A"}
