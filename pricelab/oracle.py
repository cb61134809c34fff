"""DuckDB-runnable SQL twins of the registered queries (the correctness gate).

``CATALOG_CTES`` rebuilds the raw catalog from the pre-registered tables, and
``CLEAN_CTES`` applies the cleaning rules.  Each oracle query is written
independently of the Spark code, from the operator's specification.
"""

from __future__ import annotations

import re

# The SQL side's own rule of a numeric list: the whole text at once (DuckDB's regular
# expressions run in linear time without recursion).
_NUMBER = (r"[+-]?(0+|[1-9][0-9]*(_[0-9]+)*"
           r"|([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
           r"|[0-9]+[eE][+-]?[0-9]+)")
LIST_PATTERN = (r"^[ \t]*\[\s*(" + _NUMBER + r"(\s*,\s*" + _NUMBER + r")*\s*,?)?\s*\]\s*$")

CATALOG_CTES = r"""
li AS (
  SELECT l_partkey,
         count(*) AS n_lines,
         sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty,
         CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS disc,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE)
           / CAST(count(*) AS DOUBLE) / 100.0e0 AS freight,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_ret,
         min(l_suppkey) AS sk,
         sum(month(l_shipdate)) AS mm,
         '[' || array_to_string(list_sort(list_distinct(list(
             CAST(CAST(round(l_extendedprice / l_quantity / 10.0e0, 0) AS BIGINT) AS VARCHAR)))), ', ')
           || ']' AS comp
  FROM lineitem GROUP BY l_partkey
),
ev AS (
  SELECT event_id % (SELECT count(*) FROM part) AS ek,
         count(*) FILTER (WHERE event_type = 'click') AS c,
         count(*) FILTER (WHERE event_type = 'view') AS v
  FROM events GROUP BY 1
),
base AS (
  SELECT * FROM part
  LEFT JOIN li ON p_partkey = l_partkey
  LEFT JOIN ev ON p_partkey = ek
  LEFT JOIN supplier ON sk = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
),
mx AS (
  SELECT max(qty) AS mq, max(c) AS mc, max(v) AS mv, max(n_lines) AS mn FROM base
),
base2 AS (
  SELECT base.*,
         CAST(qty AS DOUBLE) / CAST(mq AS DOUBLE) AS demand0,
         (p_size - 1) / 49.0e0 AS inventory0,
         CAST(c AS DOUBLE) / CAST(mc AS DOUBLE) AS clicks0,
         CAST(v AS DOUBLE) / CAST(mv AS DOUBLE) AS search0,
         CAST(n_lines AS DOUBLE) / CAST(mn AS DOUBLE) AS reviews0
  FROM base, mx
),
raw_catalog AS (
  SELECT p_partkey AS id,
         CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE p_name END AS productDisplayName,
         p_type AS articleType,
         split_part(p_name, ' ', 1) AS baseColour,
         CASE mm % 4 WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer'
                     WHEN 3 THEN 'Fall' END AS season,
         p_brand AS material,
         r_name AS location,
         demand0 AS demand,
         inventory0 AS inventory,
         clicks0 AS clicks,
         search0 AS search_volume,
         reviews0 AS reviews_count,
         CASE WHEN p_partkey % 41 = 3 THEN NULL
              ELSE CAST((101 * n_lines - 80 * n_ret) // (2 * n_lines) AS DOUBLE) / 10.0e0 END AS ratings,
         disc AS discount_percentage,
         freight AS freight_price,
         CASE WHEN p_partkey % 97 = 11 THEN 'unknown'
              WHEN p_partkey % 89 = 13 THEN '[]'
              WHEN p_partkey % 83 = 17 THEN NULL
              ELSE comp END AS competitor_prices,
         CASE WHEN p_partkey % 61 = 5 THEN NULL
              WHEN mm % 12 = 0 THEN '1' ELSE '0' END AS holiday,
         CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE '0' END AS weekend,
         CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE '1' END AS weekday,
         CAST(p_partkey % 2 AS INTEGER) AS customer_segment,
         CASE WHEN p_partkey % 101 = 1 THEN 'bad'
              ELSE CAST(CAST(round((p_retailprice - 880.0e0) * 5.0e0 + 300.0e0 * demand0
                                   + 100.0e0 * (1.0e0 - inventory0), 0) AS BIGINT) AS VARCHAR)
         END AS optimal_price
  FROM base2
)"""

RAW_COLUMNS = ["id", "productDisplayName", "articleType", "baseColour", "season", "material",
               "location", "demand", "inventory", "clicks", "search_volume", "reviews_count",
               "ratings", "discount_percentage", "freight_price", "competitor_prices",
               "holiday", "weekend", "weekday", "customer_segment", "optimal_price"]
CLEAN_COLUMNS = RAW_COLUMNS + ["competitor_price_mean"]
NUMERIC_CLEAN = ["id", "demand", "inventory", "clicks", "search_volume", "reviews_count",
                 "ratings", "discount_percentage", "freight_price", "holiday", "weekend",
                 "weekday", "customer_segment", "optimal_price", "competitor_price_mean"]
TEXT_CLEAN = ["productDisplayName", "articleType", "baseColour", "season", "material",
              "location", "competitor_prices"]

LIST_MEAN_SQL = (
    "CASE WHEN coalesce(regexp_full_match({c}, '" + LIST_PATTERN + "'), false) THEN "
    "(CASE WHEN len(list_filter(string_split(regexp_replace({c}, '[\\[\\]\\s_]', '', 'g'), ','), "
    "lambda s: s <> '')) = 0 THEN NULL ELSE "
    "list_sum(list_transform(list_filter(string_split(regexp_replace({c}, '[\\[\\]\\s_]', '', 'g'), ','), "
    "lambda s: s <> ''), lambda s: TRY_CAST(s AS DOUBLE))) / "
    "CAST(len(list_filter(string_split(regexp_replace({c}, '[\\[\\]\\s_]', '', 'g'), ','), "
    "lambda s: s <> '')) AS DOUBLE) END) ELSE 500.0e0 END")


def _strict(c):
    return (f"greatest(0, least(1, CAST(trunc(CAST(coalesce({c}, '0') AS DOUBLE)) AS INTEGER)))"
            f" AS {c}")


CLEAN_CTES = f""",
cm AS (
  SELECT *, {LIST_MEAN_SQL.format(c="competitor_prices")} AS cpm0 FROM raw_catalog
),
clean AS (
  SELECT id, coalesce(productDisplayName, 'Generic Product') AS productDisplayName,
         articleType, baseColour, season, material, location, demand, inventory, clicks,
         search_volume, reviews_count, ratings, discount_percentage, freight_price,
         competitor_prices, {_strict('holiday')}, {_strict('weekend')}, {_strict('weekday')},
         customer_segment,
         coalesce(TRY_CAST(optimal_price AS DOUBLE), 500.0e0) AS optimal_price,
         coalesce(cpm0, (SELECT median(cpm0) FROM cm)) AS competitor_price_mean
  FROM cm
),
prof AS (
  SELECT * EXCLUDE (raw_price) REPLACE (TRY_CAST(raw_price AS DOUBLE) AS optimal_price) FROM
  (SELECT clean.*, cm.optimal_price AS raw_price FROM clean JOIN cm USING (id))
),
fit AS (
  SELECT round(regr_intercept(optimal_price, demand) * 1000000.0e0, 0) / 1000000.0e0 AS a,
         round(regr_slope(optimal_price, demand) * 1000000.0e0, 0) / 1000000.0e0 AS b
  FROM clean
)"""


def q(body: str, ctes: str = "") -> str:
    """Full oracle statement: catalog + cleaning CTEs, extra CTEs, then ``body``."""
    return "WITH " + CATALOG_CTES + CLEAN_CTES + ctes + "\n" + body


def r6(x: str) -> str:
    """6 places, half away from zero on the exactly scaled value (as ``round_to``)."""
    return f"(round(({x}) * 1000000.0e0, 0) / 1000000.0e0)"


def r2(x: str) -> str:
    return f"(round(({x}) * 100.0e0, 0) / 100.0e0)"


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- sources, cleaning
SQL["catalog_scan"] = q("SELECT * FROM raw_catalog")
SQL["catalog_scan_parquet"] = q("SELECT * FROM raw_catalog")
SQL["clean_names"] = q("SELECT id, coalesce(productDisplayName, 'Generic Product') "
                       "AS productDisplayName FROM raw_catalog")
SQL["competitor_mean"] = q("SELECT id, competitor_prices, cpm0 AS competitor_price_mean FROM cm")
SQL["competitor_mean_imputed"] = q(
    f"SELECT id, {r6('competitor_price_mean')} AS competitor_price_mean FROM clean")
SQL["clean_flags_clipped"] = q(
    f"SELECT id, {_strict('holiday')}, {_strict('weekday')}, {_strict('weekend')} FROM raw_catalog")
SQL["clean_flags_lenient"] = q(
    "SELECT id, " + ", ".join(f"coalesce(TRY_CAST({c} AS DOUBLE), 0.0e0) AS {c}"
                              for c in ["holiday", "weekday", "weekend"]) + " FROM raw_catalog")
SQL["clean_price"] = q("SELECT id, coalesce(TRY_CAST(optimal_price AS DOUBLE), 500.0e0) "
                       "AS optimal_price FROM raw_catalog")
SQL["current_price"] = q("SELECT id, greatest(50.0e0, coalesce(TRY_CAST(optimal_price AS DOUBLE),"
                         " 500.0e0)) AS current_price FROM raw_catalog")
_MATRIX = ["demand", "inventory", "clicks", "search_volume", "reviews_count", "ratings",
           "discount_percentage", "freight_price", "competitor_price_mean", "holiday",
           "weekday", "weekend"]
SQL["model_matrix_fill"] = q(
    "SELECT id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0e0) AS {c}" for c in _MATRIX)
    + ", coalesce(TRY_CAST(optimal_price AS DOUBLE), 500.0e0) AS optimal_price FROM ("
    "SELECT cm.* REPLACE (coalesce(TRY_CAST(holiday AS DOUBLE), 0.0e0) AS holiday, "
    "coalesce(TRY_CAST(weekday AS DOUBLE), 0.0e0) AS weekday, "
    "coalesce(TRY_CAST(weekend AS DOUBLE), 0.0e0) AS weekend), cpm0 AS competitor_price_mean FROM cm)")
_DOMAINS = [("demand", 0.0, 1.0), ("inventory", 0.0, 1.0), ("clicks", 0.0, 1.0),
            ("search_volume", 0.0, 1.0), ("competitor_price_mean", 200.0, 1000.0),
            ("discount_percentage", 0.0, 0.5), ("freight_price", 0.0, 100.0)]
SQL["domain_violations"] = q(" UNION ALL ".join(
    f"SELECT '{s}' AS signal, {lo}e0 AS lo, {hi}e0 AS hi, count(*) AS n_rows, "
    f"count(*) FILTER (WHERE {s} < {lo}e0 OR {s} > {hi}e0) AS n_outside, "
    f"count(*) FILTER (WHERE {s} IS NULL) AS n_null FROM clean" for s, lo, hi in _DOMAINS))

# ---------------------------------------------------------------- profile
SQL["dataset_shape"] = q(f"SELECT count(*) AS n_rows, {len(CLEAN_COLUMNS)} AS n_columns FROM clean")
SQL["dataset_overview"] = q(
    f"SELECT count(*) AS n_rows, {r6('avg(optimal_price)')} AS mean_price, "
    f"count(DISTINCT articleType) AS n_categories, {r6('avg(ratings)')} AS mean_rating FROM clean")
_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,"
    f" count(*) AS n FROM clean" for i, c in enumerate(CLEAN_COLUMNS))
_MISS_CTE = f""",
miss AS (SELECT "column", ordinal, missing_count,
         {r6('CAST(missing_count AS DOUBLE) / CAST(n AS DOUBLE) * 100.0e0')} AS missing_percent
         FROM ({_MISSING}))"""
SQL["missing_by_column"] = q("SELECT * FROM miss WHERE missing_count > 0", _MISS_CTE)
SQL["missing_top20_in_order"] = q(
    "SELECT * FROM miss WHERE missing_count > 0 ORDER BY ordinal LIMIT 20", _MISS_CTE)
SQL["missing_top10"] = q(
    "SELECT * FROM miss ORDER BY missing_percent DESC, ordinal LIMIT 10", _MISS_CTE)
_NULLS = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in CLEAN_COLUMNS)
_OVERALL_CTE = f""",
overall AS (SELECT count(*) AS n_rows, {len(CLEAN_COLUMNS)} AS n_columns,
            CAST(coalesce(sum({_NULLS}), 0) AS BIGINT) AS n_null_cells FROM clean)"""
SQL["missing_overall"] = q(
    "SELECT n_rows, n_columns, n_null_cells, "
    + r6("CAST(n_null_cells AS DOUBLE) / CAST(n_rows * n_columns AS DOUBLE) * 100.0e0")
    + " AS missing_percent FROM overall", _OVERALL_CTE)
SQL["quality_verdict"] = q(
    "SELECT missing_percent, CASE WHEN missing_percent < 5.0 THEN 'Excellent Data Quality' "
    "WHEN missing_percent < 15.0 THEN 'Good Data Quality' ELSE 'Data Quality Concern' END AS verdict"
    " FROM (SELECT "
    + r6("CAST(n_null_cells AS DOUBLE) / CAST(n_rows * n_columns AS DOUBLE) * 100.0e0")
    + " AS missing_percent FROM overall)", _OVERALL_CTE)
SQL["numeric_summary"] = q(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count({c}) AS count, "
    f"{r6(f'avg(CAST({c} AS DOUBLE))')} AS mean, {r6(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, "
    f"{r6(f'min(CAST({c} AS DOUBLE))')} AS min, "
    f"{r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS q25, "
    f"{r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS q50, "
    f"{r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS q75, "
    f"{r6(f'max(CAST({c} AS DOUBLE))')} AS max FROM clean" for i, c in enumerate(NUMERIC_CLEAN)))
SQL["categorical_summary"] = q(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, (SELECT count(DISTINCT {c}) FROM clean) AS unique_values,"
    f" coalesce((SELECT {c} FROM clean WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY count(*) DESC, {c} LIMIT 1), 'N/A') AS most_common"
    for i, c in enumerate(TEXT_CLEAN)))
SQL["price_by_category_top10"] = q(
    f"SELECT articleType, {r6('avg(optimal_price)')} AS mean_price FROM clean "
    "WHERE articleType IS NOT NULL GROUP BY articleType ORDER BY mean_price DESC, articleType LIMIT 10")
SQL["price_stats_by_category"] = q(
    f"SELECT articleType, {r6('avg(optimal_price)')} AS mean_price, count(optimal_price) AS n_products,"
    f" {r6('stddev_samp(optimal_price)')} AS std_price FROM clean WHERE articleType IS NOT NULL "
    "GROUP BY articleType")
SQL["price_range"] = q("SELECT min(optimal_price) AS min_price, max(optimal_price) AS max_price, "
                       "max(optimal_price) - min(optimal_price) AS price_span FROM clean")


def _corr(y: str, x: str) -> str:
    r = (f"CASE WHEN regr_sxx({y}, {x}) * regr_syy({y}, {x}) > 0 THEN regr_sxy({y}, {x}) / "
         f"sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})) END")
    return f"CASE WHEN ({r}) IS NOT NULL THEN greatest(-1.0e0, least(1.0e0, {r})) END"


_CORR = ["demand", "clicks", "search_volume", "inventory", "ratings", "discount_percentage",
         "freight_price", "optimal_price"]
_cells = []
for _i, _a in enumerate(_CORR):
    for _j, _b in enumerate(_CORR):
        _x, _y = (_a, _b) if _i <= _j else (_b, _a)
        _cells.append(f"SELECT '{_a}' AS a, '{_b}' AS b, "
                      f"{r6(_corr(f'CAST({_y} AS DOUBLE)', f'CAST({_x} AS DOUBLE)'))} AS r FROM clean")
SQL["correlation_matrix"] = q(" UNION ALL ".join(_cells))
SQL["demand_price_corr"] = q(
    "SELECT correlation, CASE WHEN correlation > 0.3 THEN 'Strong Positive Relationship' "
    "WHEN correlation > 0.0 THEN 'Moderate Positive Relationship' ELSE 'Weak/No Relationship' END "
    f"AS band FROM (SELECT {r6(_corr('optimal_price', 'demand'))} AS correlation FROM clean)")
SQL["demand_price_trend"] = q(
    f"SELECT {r6('regr_slope(optimal_price, demand)')} AS slope, "
    f"{r6('regr_intercept(optimal_price, demand)')} AS intercept, "
    f"{r6('regr_r2(optimal_price, demand)')} AS r2, regr_count(optimal_price, demand) AS n_pairs "
    "FROM clean")


def histogram_sql(source: str, column: str, nbins: int) -> str:
    return f"""
SELECT g.bin, {r6(f'lo + (hi - lo) * g.bin / {nbins}.0e0')} AS bin_lo,
       {r6(f'lo + (hi - lo) * (g.bin + 1) / {nbins}.0e0')} AS bin_hi,
       coalesce(cnt, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({nbins})) g
CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM
            (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL)) b
LEFT JOIN (
  SELECT CAST(least({nbins - 1}, coalesce(floor((x - lo) / nullif(hi - lo, 0) * {nbins}.0e0), 0))
              AS INTEGER) AS bin, count(*) AS cnt
  FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL) v,
       (SELECT min(CAST({column} AS DOUBLE)) AS lo, max(CAST({column} AS DOUBLE)) AS hi
        FROM {source}) bb
  GROUP BY 1) c ON c.bin = g.bin
WHERE b.lo IS NOT NULL"""


SQL["price_histogram"] = q(histogram_sql("clean", "optimal_price", 50))
SQL["demand_histogram"] = q(histogram_sql("clean", "demand", 20))
SQL["inventory_histogram"] = q(histogram_sql("clean", "inventory", 20))
SQL["season_summary"] = q(
    f"SELECT season, {r2('avg(optimal_price)')} AS mean_optimal_price, "
    f"{r2('avg(demand)')} AS mean_demand, {r2('avg(inventory)')} AS mean_inventory "
    "FROM clean WHERE season IS NOT NULL GROUP BY season")
SQL["location_summary"] = q(
    f"SELECT location, {r2('avg(optimal_price)')} AS mean_optimal_price, "
    f"{r2('avg(demand)')} AS mean_demand FROM clean WHERE location IS NOT NULL GROUP BY location")
SQL["top_season"] = q(
    f"SELECT season, {r6('mean_price')} AS mean_price FROM (SELECT season, avg(optimal_price) AS "
    "mean_price FROM clean WHERE season IS NOT NULL GROUP BY season) ORDER BY mean_price DESC, season "
    "LIMIT 1")
SQL["category_distribution"] = q(
    "SELECT articleType, n_products, "
    + r6("CAST(n_products AS DOUBLE) / CAST((SELECT count(*) FROM clean) AS DOUBLE) * 100.0e0")
    + " AS share_percent FROM (SELECT articleType, count(*) AS n_products, min(id) AS first_seen "
    "FROM clean WHERE articleType IS NOT NULL GROUP BY articleType) "
    "ORDER BY n_products DESC, first_seen LIMIT 10")
_NUM_NN = " + ".join(f"CAST({c} IS NOT NULL AS BIGINT)" for c in NUMERIC_CLEAN)
_TXT_NN = " + ".join(f"CAST({c} IS NOT NULL AS BIGINT)" for c in TEXT_CLEAN)
_TEXT_SET = set(TEXT_CLEAN)
_KIND_ORDER = []
for _c in CLEAN_COLUMNS:
    _k = "text" if _c in _TEXT_SET else "numeric"
    if _k not in _KIND_ORDER:
        _KIND_ORDER.append(_k)
SQL["dtype_counts"] = q(
    f"SELECT 'numeric' AS kind, {len(NUMERIC_CLEAN)} AS n_columns, count(*) * {len(NUMERIC_CLEAN)} "
    f"AS n_cells, CAST(coalesce(sum({_NUM_NN}), 0) AS BIGINT) AS n_non_null FROM clean UNION ALL "
    f"SELECT 'text', {len(TEXT_CLEAN)}, count(*) * {len(TEXT_CLEAN)}, "
    f"CAST(coalesce(sum({_TXT_NN}), 0) AS BIGINT) FROM clean")
_WIDTH = {"id": 8, "holiday": 4, "weekend": 4, "weekday": 4, "customer_segment": 4}
SQL["column_bytes"] = q(" UNION ALL ".join(
    (f"SELECT '{c}' AS \"column\", {i} AS ordinal, CAST(coalesce(sum(strlen({c})), 0) AS BIGINT)"
     f" AS bytes FROM clean") if c in _TEXT_SET else
    (f"SELECT '{c}' AS \"column\", {i} AS ordinal, CAST(count({c}) * {_WIDTH.get(c, 8)} AS BIGINT) "
     f"AS bytes FROM clean")
    for i, c in enumerate(CLEAN_COLUMNS)))
SQL["threshold_counts"] = q(
    "SELECT count(*) AS n_rows, "
    "count(*) FILTER (WHERE demand > 0.8) AS high_demand, "
    + r6("CAST(count(*) FILTER (WHERE demand > 0.8) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0e0")
    + " AS high_demand_percent, count(*) FILTER (WHERE inventory < 0.2) AS low_inventory, "
    + r6("CAST(count(*) FILTER (WHERE inventory < 0.2) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0e0")
    + " AS low_inventory_percent, count(*) FILTER (WHERE ratings >= 4.0) AS high_rating, "
    + r6("CAST(count(*) FILTER (WHERE ratings >= 4.0) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0e0")
    + " AS high_rating_percent, count(DISTINCT articleType) AS n_categories FROM clean")

# Profile reports see the label as loaded: unparsable is missing.
_PREFIX = "WITH " + CATALOG_CTES + CLEAN_CTES
for _key in ["dataset_shape", "dataset_overview", "missing_by_column", "missing_overall",
             "missing_top20_in_order", "missing_top10", "quality_verdict", "numeric_summary",
             "categorical_summary", "price_by_category_top10", "price_stats_by_category",
             "price_range", "correlation_matrix", "demand_price_corr", "demand_price_trend",
             "season_summary", "location_summary", "top_season", "category_distribution",
             "dtype_counts", "column_bytes", "threshold_counts", "price_histogram"]:
    SQL[_key] = _PREFIX + SQL[_key][len(_PREFIX):].replace("FROM clean", "FROM prof")

# ---------------------------------------------------------------- editions / frames
from .plans.params import (ENCODED_LOOKUP_COLUMNS, FEATURES_FIXED, INDEX_TERMS, LINEAR_SIGNALS,  # noqa: E402
                           NO_MATCH_TERM, SEARCH_LITERAL, SEARCH_REGEX, SEARCH_TERM,
                           SIGNAL_WEIGHTS, WEIGHTED_SIGNALS)

_CLOSED = "((SELECT a FROM fit) + (SELECT b FROM fit) * demand)"
FRAME_CTES = f""",
clean_l AS (
  SELECT id, coalesce(productDisplayName, 'Generic Product') AS productDisplayName,
         articleType, baseColour, season, material, location, demand, inventory, clicks,
         search_volume, reviews_count, ratings, discount_percentage, freight_price,
         competitor_prices,
         coalesce(TRY_CAST(holiday AS DOUBLE), 0.0e0) AS holiday,
         coalesce(TRY_CAST(weekend AS DOUBLE), 0.0e0) AS weekend,
         coalesce(TRY_CAST(weekday AS DOUBLE), 0.0e0) AS weekday,
         customer_segment,
         coalesce(TRY_CAST(optimal_price AS DOUBLE), 500.0e0) AS optimal_price,
         coalesce(cpm0, (SELECT median(cpm0) FROM cm)) AS competitor_price_mean
  FROM cm
),
pg AS (
  SELECT * REPLACE (0.0e0 AS holiday, 0.0e0 AS weekend),
         greatest(50.0e0, optimal_price) AS current_price,
         {_CLOSED} AS prediction,
         CASE WHEN {_CLOSED} IS NOT NULL THEN greatest(50.0e0, least(2000.0e0, {_CLOSED})) END
           AS predicted_price
  FROM clean_l
),
op AS (
  SELECT *, optimal_price AS current_price, {_CLOSED} AS prediction,
         CASE WHEN {_CLOSED} IS NOT NULL THEN greatest(100.0e0, {_CLOSED}) END AS predicted_price
  FROM clean
)"""


def qf(body: str, ctes: str = "") -> str:
    return q(body, FRAME_CTES + ctes)


def _match(term: str) -> str:
    return f"coalesce(regexp_matches(productDisplayName, '{term}', 'i'), false)"


# ---------------------------------------------------------------- search
SQL["search_products"] = q(f"SELECT id, productDisplayName FROM clean WHERE {_match(SEARCH_TERM)}")
SQL["search_products_regex"] = q(
    f"SELECT id, productDisplayName FROM clean WHERE {_match(SEARCH_REGEX)}")
_FIRST = ("SELECT productDisplayName, min(id) AS first_id FROM {src} WHERE productDisplayName "
          "IS NOT NULL {extra} GROUP BY productDisplayName ORDER BY first_id LIMIT {n}")
SQL["distinct_names_first_n"] = q(_FIRST.format(src="clean", extra="", n=50))


def _fallback_first(term: str, n: int) -> str:
    ctes = f""",
m AS (SELECT *, {_match(term)} AS matched FROM clean),
f AS (SELECT coalesce(max(CAST(matched AS INTEGER)), 0) = 1 AS found FROM m)"""
    body = (f"SELECT productDisplayName, min(id) AS first_id, (SELECT found FROM f) AS from_search "
            f"FROM m WHERE (matched OR NOT (SELECT found FROM f)) AND productDisplayName IS NOT NULL "
            f"GROUP BY productDisplayName ORDER BY first_id LIMIT {n}")
    return q(body, ctes)


SQL["search_with_fallback"] = _fallback_first(SEARCH_TERM, 50)
SQL["search_fallback_first"] = _fallback_first(NO_MATCH_TERM, 50)
_POPULAR = ("SELECT productDisplayName, count(*) AS n_products, min(id) AS first_id FROM clean "
            "WHERE productDisplayName IS NOT NULL GROUP BY productDisplayName "
            "ORDER BY n_products DESC, first_id LIMIT {n}")
SQL["search_fallback_popular"] = q(
    f"""SELECT productDisplayName, first_id, true AS from_search FROM (
          SELECT productDisplayName, min(id) AS first_id FROM m WHERE matched
          AND productDisplayName IS NOT NULL GROUP BY 1 ORDER BY first_id LIMIT 25)
        WHERE (SELECT found FROM f)
        UNION ALL
        SELECT productDisplayName, first_id, false FROM ({_POPULAR.format(n=25)})
        WHERE NOT (SELECT found FROM f)""",
    f""",
m AS (SELECT *, {_match(NO_MATCH_TERM)} AS matched FROM clean),
f AS (SELECT coalesce(max(CAST(matched AS INTEGER)), 0) = 1 AS found FROM m)""")
SQL["popular_products"] = q(_POPULAR.format(n=25))
SQL["first_row_per_name"] = q(
    "SELECT * FROM clean WHERE id IN (SELECT min(id) FROM clean WHERE productDisplayName "
    "IS NOT NULL GROUP BY productDisplayName)")
SQL["product_card"] = q(
    "SELECT id, productDisplayName, articleType, baseColour, season, material, location, demand,"
    " inventory, ratings, greatest(50.0e0, coalesce(optimal_price, 500.0e0)) AS current_price "
    "FROM clean")


def _flagged(pred: str) -> str:
    return q(f"SELECT id, productDisplayName, (SELECT count(*) FROM clean WHERE {pred}) "
             f"AS n_matching FROM clean WHERE {pred} ORDER BY id LIMIT 3")


SQL["opportunity_products"] = _flagged("demand > 0.7 AND inventory < 0.3")
SQL["discount_candidates"] = _flagged("inventory > 0.7 AND demand < 0.3")
SQL["premium_candidates"] = _flagged("ratings >= 4.0 AND competitor_price_mean < 400.0")

# ---------------------------------------------------------------- features
_CATS = ["articleType", "baseColour", "season", "material", "location"]


def _split(f: str):
    for c in _CATS:
        if f.startswith(c + "_"):
            return c, f[len(c) + 1:]
    return None, f


def _ind(c: str, v: str) -> str:
    return f"CAST(coalesce({c} = '{v}', false) AS INTEGER)"


_IND = [f for f in FEATURES_FIXED if _split(f)[0] is not None]
SQL["one_hot_encode"] = q("SELECT id, " + ", ".join(
    f'{_ind(*_split(f))} AS "{f}"' for f in _IND) + " FROM clean")
_PRESENT = set(CLEAN_COLUMNS)
SQL["align_features"] = q("SELECT " + ", ".join(
    (f'{_ind(*_split(f))} AS "{f}"' if _split(f)[0] else
     (f'{f}' if f in _PRESENT else f'0 AS "{f}"')) for f in FEATURES_FIXED)
    + ", id, productDisplayName, optimal_price FROM clean")
_SERV_W = ["demand", "inventory", "clicks", "search_volume", "competitor_price_mean",
           "discount_percentage", "freight_price"]


def _serving(f: str) -> str:
    c, v = _split(f)
    if c:
        return f'CAST({_ind(c, v)} AS DOUBLE) AS "{f}"'
    if f in _SERV_W:
        return f"CAST({f} AS DOUBLE) * 1.0e0 AS {f}"
    if f in ("holiday", "weekday", "weekend"):
        return f"CAST(CAST({f} AS INTEGER) AS DOUBLE) AS {f}"
    if f == "ratings":
        return "CAST(ratings AS DOUBLE) AS ratings"
    return f'0.0e0 AS "{f}"'


SQL["scenario_features"] = q("SELECT id, " + ", ".join(_serving(f) for f in FEATURES_FIXED)
                             + " FROM clean")
_CAL = {"demand": 15.0, "inventory": 12.0, "clicks": 8.0, "search_volume": 8.0,
        "competitor_price_mean": 10.0, "holiday": 9.0, "ratings": 4.0, "reviews_count": 3.5,
        "weekend": 6.0, "month": 2.5, "weekday": 2.0, "customer_segment": 0.8}
_PG_COLS = set(CLEAN_COLUMNS) | {"current_price", "prediction", "predicted_price"}


def _clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(-5.0e0, least(5.0e0, {x})) END"


def _weighted(f: str, weights) -> str:
    c, v = _split(f)
    if f in ("holiday", "weekend"):
        w = (weights or {}).get(f, 9.0 if f == "holiday" else 6.0) if weights else 1.0
        e = f"coalesce(TRY_CAST(CAST({f} AS VARCHAR) AS DOUBLE), 0.0e0) * {w}e0"
    elif f in _PG_COLS:
        w = weights.get(f, 1.0) if weights else 1.0
        e = f"CAST({f} AS DOUBLE) * {w}e0"
    elif c == "season":
        w = weights.get(f, 3.0) if weights else 1.0
        e = f"CASE WHEN coalesce(season, 'Summer') = '{v}' THEN {w}e0 ELSE 0.0e0 END"
    else:
        e = "0.0e0"
    return f'{_clip(e)} AS "{f}"'


SQL["weighted_features"] = qf("SELECT id, " + ", ".join(_weighted(f, None) for f in FEATURES_FIXED)
                              + " FROM pg")
SQL["weighted_features_calibrated"] = qf(
    "SELECT id, " + ", ".join(_weighted(f, _CAL) for f in FEATURES_FIXED) + " FROM pg")
SQL["apply_weights"] = qf("SELECT id, " + ", ".join(
    f"{r6(f'CAST({c} AS DOUBLE) * {_CAL[c]}e0')} AS {c}" for c in WEIGHTED_SIGNALS) + " FROM pg")
SQL["clip_features"] = qf("SELECT id, " + ", ".join(
    f"{r6(_clip(f'CAST({c} AS DOUBLE) * {_CAL[c]}e0'))} AS {c}" for c in WEIGHTED_SIGNALS)
    + " FROM pg")


def _score(h: str = "holiday", w: str = "weekend") -> str:
    return (f"(demand / (CASE WHEN inventory IS NOT NULL THEN greatest(inventory, 0.01e0) END) * 0.3e0 + (clicks + search_volume) * 0.25e0 "
            f"+ ({h} * 2.5e0 + {w} * 1.8e0) * 0.2e0 + ratings / 5.0e0 * 0.25e0)")


def _score_level(s: str) -> str:
    return f"CASE WHEN {s} > 2.5 THEN 'ELITE' WHEN {s} > 1.5 THEN 'PREMIUM' ELSE 'OPTIMAL' END"


SQL["timing_scenarios"] = qf(
    f"SELECT id, timing, t.holiday, t.weekend, {r6(_score('t.holiday', 't.weekend'))} AS score, "
    f"{_score_level(_score('t.holiday', 't.weekend'))} AS score_level "
    "FROM (SELECT * EXCLUDE (holiday, weekend) FROM pg) p CROSS JOIN (VALUES "
    "('Normal Day', 0.0e0, 0.0e0), ('Holiday/Event', 1.0e0, 0.0e0), ('Weekend Effect', 0.0e0, 1.0e0))"
    " t(timing, holiday, weekend)")

# ---------------------------------------------------------------- scenarios
_OVR = ["demand", "inventory", "clicks", "search_volume", "competitor_price_mean", "ratings",
        "holiday", "weekend"]
SQL["scenario_grid"] = qf(
    "SELECT id, scenario, " + ", ".join(f"coalesce(s_{c}, CAST({c} AS DOUBLE)) AS {c}" for c in _OVR)
    + ", " + r6("(SELECT a FROM fit) + (SELECT b FROM fit) * coalesce(s_demand, demand)")
    + " AS prediction FROM pg CROSS JOIN (VALUES "
    "('unchanged', NULL, NULL, NULL), ('demand_up', 0.9e0, NULL, NULL), "
    "('stock_low', NULL, 0.1e0, NULL), ('competitor_cut', NULL, NULL, 300.0e0)) "
    "s(scenario, s_demand, s_inventory, s_competitor_price_mean), "
    "(SELECT NULL::DOUBLE AS s_clicks, NULL::DOUBLE AS s_search_volume, NULL::DOUBLE AS s_ratings, "
    "NULL::DOUBLE AS s_holiday, NULL::DOUBLE AS s_weekend)")
SQL["sensitivity_sweep"] = q(
    "SELECT id, step, demand, " + r6(_CLOSED) + " AS prediction FROM (SELECT id, inventory, "
    "CAST(r.range AS INTEGER) AS step, 0.0e0 + CAST(r.range AS DOUBLE) / 100.0e0 AS demand "
    "FROM clean CROSS JOIN range(0, 101) r)")
_IMP = {"demand": 0.15, "inventory": 0.12, "competitor_price_mean": 0.10, "holiday": 0.09,
        "clicks": 0.08, "search_volume": 0.08, "ratings": 0.04}
_SIG_CTE = f""",
sig AS (
  SELECT id, 'demand' AS signal, CAST(demand AS DOUBLE) AS value FROM pg UNION ALL
  SELECT id, 'inventory', 1.0e0 - inventory FROM pg UNION ALL
  SELECT id, 'clicks', CAST(clicks AS DOUBLE) FROM pg UNION ALL
  SELECT id, 'search_volume', CAST(search_volume AS DOUBLE) FROM pg UNION ALL
  SELECT id, 'competitor_price_mean', CASE WHEN current_price > 0 THEN competitor_price_mean
         / current_price ELSE 1.0e0 END FROM pg UNION ALL
  SELECT id, 'ratings', ratings / 5.0e0 FROM pg UNION ALL
  SELECT id, 'holiday', CAST(holiday AS DOUBLE) + CAST(weekend AS DOUBLE) FROM pg
),
imp AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in _IMP.items())})
        t(signal, importance)),
sigimp AS (
  SELECT sig.*, coalesce(CASE WHEN sig.signal IN ({", ".join(f"'{f}'" for f in FEATURES_FIXED)})
                              THEN imp.importance END, 0.05e0) AS importance
  FROM sig LEFT JOIN imp ON sig.signal = imp.signal
)"""
SQL["signal_importance_join"] = qf(
    f"SELECT id, signal, {r6('value')} AS value, importance FROM sigimp", _SIG_CTE)
SQL["encoded_lookup"] = q(
    "SELECT c.id, c.productDisplayName, e.competitor_price_mean, e.demand, e.\"articleType_SMALL\" "
    "FROM clean c JOIN (SELECT id, competitor_price_mean, demand, "
    f"{_ind('articleType', 'SMALL')} AS \"articleType_SMALL\" FROM clean) e ON c.id = e.id")

# ---------------------------------------------------------------- KPIs
_CHG = "(predicted_price - current_price)"
_PCT = f"(CASE WHEN current_price > 0 THEN {_CHG} / current_price * 100.0e0 ELSE 0.0e0 END)"
SQL["price_change"] = qf(
    f"SELECT id, current_price, {r6('predicted_price')} AS predicted_price, "
    f"{r6(_CHG)} AS price_change, {r6(_PCT)} AS change_percent FROM pg")
SQL["price_direction"] = qf(
    f"SELECT id, CASE WHEN {_CHG} > 0 THEN 'INCREASE' WHEN {_CHG} < 0 THEN 'DECREASE' "
    "ELSE 'ADJUSTMENT' END AS direction FROM pg")
SQL["revenue_impact_linear"] = qf(
    f"SELECT id, {r6(f'{_CHG} * demand * 100.0e0 * 1.0e0')} AS revenue_impact FROM op")
_VOL = "CASE WHEN demand IS NOT NULL THEN greatest(1000.0e0, least(5000.0e0, demand * 6000.0e0)) END"
SQL["revenue_impact_clamped"] = qf(
    f"SELECT id, {r6(_VOL)} AS volume_estimate, {r6(f'{_CHG} * {_VOL}')} AS revenue_impact FROM pg")
SQL["profit_margin"] = qf(
    "SELECT id, " + r6("CASE WHEN predicted_price = 0 THEN NULL ELSE (predicted_price - "
                       "predicted_price * 0.7e0) / predicted_price END * 100.0e0")
    + " AS profit_margin FROM op")
SQL["quality_margin"] = qf(
    "SELECT id, " + r6("CASE WHEN ratings IS NOT NULL THEN greatest(20.0e0, least(70.0e0, (1.0e0 - "
                       "(0.4e0 - least(1.0e0, ratings / 5.0e0 * 1.2e0) * 0.15e0)) * 100.0e0)) END")
    + " AS gross_margin FROM pg")
SQL["price_tier"] = qf(
    "SELECT id, current_price, CASE WHEN current_price > 700.0 THEN 'PREMIUM' "
    "WHEN current_price > 400.0 THEN 'COMPETITIVE' ELSE 'OPPORTUNITY' END AS price_tier FROM pg")
SQL["pricing_score"] = qf(
    f"SELECT id, {r6(_score())} AS score, {_score_level(_score())} AS score_level FROM pg")
_POS = "(CASE WHEN current_price > 0 THEN competitor_price_mean / current_price ELSE 1.0e0 END)"
SQL["competitor_position"] = qf(f"SELECT id, {r6(_POS)} AS competitor_position FROM pg")


def _lvl(c: str, hi: float, med: float, inverted: bool = False) -> str:
    op = "<" if inverted else ">"
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} {op} {hi} THEN 'high' "
            f"WHEN {c} {op} {med} THEN 'medium' ELSE 'low' END AS {c}_level")


SQL["signal_tiers"] = qf(
    "SELECT id, " + ", ".join([_lvl("demand", 0.7, 0.4), _lvl("inventory", 0.3, 0.7, True),
                               _lvl("clicks", 0.6, 0.3), _lvl("search_volume", 0.6, 0.3),
                               _lvl("ratings", 4.0, 3.5)])
    + f", CASE WHEN {_POS} > 0.9 AND {_POS} < 1.1 THEN 'high' ELSE 'medium' END AS competitor_level"
    " FROM pg")
SQL["signal_tiers_legacy"] = qf(
    f"SELECT id, CASE WHEN {_POS} / 500.0e0 > 0.9 AND {_POS} / 500.0e0 < 1.1 THEN 'high' "
    "ELSE 'medium' END AS competitor_level FROM pg")
_DAMP = "(CASE WHEN abs(value) > 2.0 THEN tanh(value / 2.0e0) ELSE value END)"
_IMPACT = f"(({_DAMP} - 0.5e0) * importance * 150.0e0)"
SQL["feature_impact"] = qf(
    f"SELECT id, signal, {r6('value')} AS value, {r6(_IMPACT)} AS impact, importance, "
    f"CASE WHEN {_IMPACT} > 0 THEN 'positive' WHEN {_IMPACT} < 0 THEN 'negative' "
    "ELSE 'neutral' END AS impact_type FROM sigimp", _SIG_CTE)
_LIN_CTE = f""",
lin AS (
  SELECT id, {_CHG} AS price_change, signal, value FROM op
  UNPIVOT INCLUDE NULLS (value FOR signal IN ({", ".join(LINEAR_SIGNALS)}))
),
linimp AS (
  SELECT lin.*, coalesce(imp.importance, 0.05e0) AS importance,
         CASE WHEN lin.signal = 'competitor_price_mean'
              THEN (value - 500.0e0) * coalesce(imp.importance, 0.05e0) * 0.8e0
              ELSE (value - 0.5e0) * coalesce(imp.importance, 0.05e0) * 100.0e0 END AS impact
  FROM lin LEFT JOIN (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in _IMP.items())})
       imp(signal, importance) ON lin.signal = imp.signal
)"""
SQL["feature_impact_linear"] = qf(
    f"SELECT id, signal, value, importance, {r6('impact')} AS impact, "
    "CASE WHEN impact > 0 THEN 'positive' WHEN impact < 0 THEN 'negative' ELSE 'neutral' END "
    "AS impact_type FROM linimp", _LIN_CTE)
SQL["impact_share"] = qf(
    f"SELECT id, signal, {r6('impact * 1.0e0')} AS weighted_impact, "
    + r6("CASE WHEN abs(price_change) = 0 THEN NULL ELSE abs(impact * 1.0e0) / abs(price_change) "
         "END * 100.0e0") + " AS share_percent FROM linimp", _LIN_CTE)
SQL["recommendation"] = qf(
    f"SELECT id, CASE WHEN {_CHG} > 0 THEN 'Price Increase Recommended' WHEN {_CHG} < 0 THEN "
    "'Price Reduction Recommended' ELSE 'Price Stable' END AS recommendation, "
    f"CASE WHEN abs({_PCT}) < 20.0 THEN 'High' WHEN abs({_PCT}) < 50.0 THEN 'Medium' ELSE 'Low' END"
    " AS confidence, CASE WHEN demand > 0.7 AND ratings > 4.0 THEN 'Premium Positioning' "
    "WHEN competitor_price_mean < 400.0 THEN 'Competitive Pricing' ELSE 'Market Standard' END "
    "AS strategy FROM op")
SQL["bounded_price"] = q(
    f"SELECT id, {r6(_CLOSED)} AS prediction, "
    f"{r6(f'CASE WHEN {_CLOSED} IS NOT NULL THEN greatest(100.0e0, {_CLOSED}) END')} AS floored_price,"
    f" {r6(f'CASE WHEN {_CLOSED} IS NOT NULL THEN greatest(50.0e0, least(2000.0e0, {_CLOSED})) END')}"
    " AS clamped_price FROM clean")
_MET_CTE = f""",
met0 AS (SELECT avg(abs(optimal_price - p)) AS mae, avg((optimal_price - p) * (optimal_price - p))
         AS mse, sum((optimal_price - p) * (optimal_price - p)) AS sse,
         regr_syy(optimal_price, p) AS sst, count(*) AS n_rows
         FROM (SELECT CAST(optimal_price AS DOUBLE) AS optimal_price, {_CLOSED} AS p FROM clean)),
met AS (SELECT {r6('mae')} AS mae, {r6('mse')} AS mse, {r6('sqrt(mse)')} AS rmse,
        {r6('1.0e0 - CASE WHEN sst = 0 THEN NULL ELSE sse / sst END')} AS r2, n_rows FROM met0)"""
SQL["regression_metrics"] = q("SELECT * FROM met", _MET_CTE)
SQL["model_verdict"] = q(
    "SELECT r2, mae, CASE WHEN coalesce(r2, 0.0) > 0.7 THEN 'Excellent Model Fit' "
    "WHEN coalesce(r2, 0.0) > 0.5 THEN 'Good Model Fit' ELSE 'Fair Model Fit' END AS fit_verdict, "
    "CASE WHEN coalesce(mae, 0.0) < 100.0 THEN 'High Accuracy' ELSE 'Moderate Accuracy' END "
    "AS accuracy_verdict FROM met", _MET_CTE)
_SAMPLE = ("SELECT * FROM clean ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 500")
SQL["seeded_sample"] = q(f"SELECT id, productDisplayName, optimal_price FROM ({_SAMPLE})")
_RES_CTE = f""",
res AS (SELECT id, coalesce(CAST(optimal_price AS DOUBLE), 500.0e0) AS actual,
        {_CLOSED} AS predicted,
        coalesce(CAST(optimal_price AS DOUBLE), 500.0e0) - {_CLOSED} AS residual
        FROM clean)"""
SQL["residuals"] = q(f"SELECT id, actual, {r6('predicted')} AS predicted, "
                     f"{r6('residual')} AS residual FROM res", _RES_CTE)
SQL["residual_histogram"] = q(histogram_sql("res", "residual", 30), _RES_CTE)
SQL["prediction_trend"] = q(
    f"SELECT {r6('regr_slope(predicted, actual)')} AS slope, "
    f"{r6('regr_intercept(predicted, actual)')} AS intercept, "
    f"{r6('regr_r2(predicted, actual)')} AS r2, regr_count(predicted, actual) AS n_pairs FROM res",
    _RES_CTE)

# ---------------------------------------------------------------- sinks, streaming
SQL["report_sink"] = SQL["price_stats_by_category"]
for _key, _of in {"stream_category_stats": "price_stats_by_category", "stream_overview": "dataset_overview",
                  "stream_season_summary": "season_summary", "stream_category_distribution": "category_distribution"}.items():
    SQL[_key] = SQL[_of]
SQL["catalog_quarantine"] = q("SELECT *, CAST(3 AS BIGINT) AS n_quarantined, 'demand; wrong number of cells' AS problems, "
                              "(SELECT count(*) FROM raw_catalog) AS n_good FROM raw_catalog")
SQL["report_sink_parts"] = ("SELECT *, CASE WHEN season = 'Winter' THEN 2 ELSE 1 END AS edition FROM ("
                            + SQL["season_summary"] + ") AS s")
SQL["stream_median_rank"] = q(
    f"SELECT count(*) AS n_values, count(*) AS n_sketched, true AS within_bound FROM "
    f"(SELECT {LIST_MEAN_SQL.format(c='competitor_prices')} AS m FROM raw_catalog) WHERE m IS NOT NULL")
SQL["stream_pricing_kpis"] = qf(
    f"SELECT id, current_price, {r6('predicted_price')} AS predicted_price, "
    f"{r6(_CHG)} AS price_change, {r6(_PCT)} AS change_percent, "
    f"CASE WHEN {_CHG} > 0 THEN 'INCREASE' WHEN {_CHG} < 0 THEN 'DECREASE' ELSE 'ADJUSTMENT' END "
    "AS direction, CASE WHEN current_price > 700.0 THEN 'PREMIUM' WHEN current_price > 400.0 "
    "THEN 'COMPETITIVE' ELSE 'OPPORTUNITY' END AS price_tier, "
    f"{r6(_score())} AS score, {_score_level(_score())} AS score_level, "
    f"{r6(_POS)} AS competitor_position FROM pg")

SQL["forest_interval_sweep"] = ("SELECT 101 * count(*) AS n_rows, count(*) AS n_products, CAST(0 AS BIGINT) AS n_differ FROM part")
SQL["distinct_sketches"] = q(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_values, count(*) AS n_rows, true AS within_bound, "
    f"true AS both_loads_new FROM raw_catalog" for c in RAW_COLUMNS if c not in NUMERIC_CLEAN or c in ("holiday", "weekend", "weekday", "optimal_price")))
_TERMS = [SEARCH_TERM, SEARCH_REGEX, re.escape(SEARCH_LITERAL), NO_MATCH_TERM, *INDEX_TERMS]
SQL["search_by_trigrams"] = q(" UNION ALL ".join(
    f"SELECT '{name}' AS term, id, productDisplayName FROM clean WHERE regexp_matches(productDisplayName, '{t}', 'i')"
    for name, t in zip([SEARCH_TERM, SEARCH_REGEX, SEARCH_LITERAL, NO_MATCH_TERM, *INDEX_TERMS], _TERMS)))
SQL["forest_tables"] = ("SELECT count(*) AS n_products, CAST(0 AS BIGINT) AS n_products_differ, CAST(0 AS BIGINT) AS "
                        "n_features_differ, CAST(50 AS BIGINT) AS n_trees, CAST(0 AS BIGINT) AS n_nodes_lost FROM part")

# ---------------------------------------------------------------- branches and fitted models
_DOMAINS_PG = [("demand", 0.0, 1.0), ("inventory", 0.0, 1.0), ("clicks", 0.0, 1.0),
               ("search_volume", 0.0, 1.0), ("competitor_price_mean", 100.0, 1500.0),
               ("ratings", 1.0, 5.0)]
SQL["domain_violations_playground"] = q(" UNION ALL ".join(
    f"SELECT '{s}' AS signal, {lo}e0 AS lo, {hi}e0 AS hi, count(*) AS n_rows, "
    f"count(*) FILTER (WHERE {s} < {lo}e0 OR {s} > {hi}e0) AS n_outside, "
    f"count(*) FILTER (WHERE {s} IS NULL) AS n_null FROM clean" for s, lo, hi in _DOMAINS_PG))
SQL["reviews_default_absent"] = q("SELECT id, 0.5e0 AS reviews_count FROM clean")
SQL["catalog_scan_na"] = q(
    "SELECT * REPLACE (CASE WHEN id % 31 <> 5 THEN season END AS season) FROM raw_catalog")
SQL["search_products_literal"] = q(
    "SELECT id, productDisplayName || ' (v1.5)' AS productDisplayName FROM clean "
    f"WHERE contains(lower(productDisplayName || ' (v1.5)'), '{SEARCH_LITERAL.lower()}')")
SQL["weighted_features_bad_value"] = qf("SELECT id, " + ", ".join(
    f'CASE WHEN id % 7 = 0 THEN 0.0e0 ELSE {e} END AS "{f}"'
    for f, e in ((f, _weighted(f, _CAL).rsplit(" AS ", 1)[0]) for f in FEATURES_FIXED)) + " FROM pg")
SQL["scenario_features_weighted"] = q("SELECT id, " + ", ".join(
    f"CAST({f} AS DOUBLE) * {SIGNAL_WEIGHTS.get(f, 1.0)}e0 AS {f}" if f in _SERV_W else _serving(f)
    for f in FEATURES_FIXED) + " FROM clean")
SQL["revenue_impact_weighted"] = qf(
    f"SELECT id, {r6(f'{_CHG} * demand * 100.0e0 * {SIGNAL_WEIGHTS["demand"]}e0')} AS revenue_impact FROM op")
_R2 = " UNION ALL ".join(f"SELECT '{s}' AS signal, coalesce(regr_r2(CAST(optimal_price AS DOUBLE), "
                         f"CAST({s} AS DOUBLE)), 0.0e0) AS r2 FROM clean" for s in LINEAR_SIGNALS)
_FITTED_CTE = f""",
fitted AS (SELECT signal, {r6('r2 / (SELECT sum(r2) FROM (' + _R2 + '))')} AS importance FROM ({_R2}))"""
SQL["fitted_importance"] = q("SELECT signal AS feature, importance FROM fitted", _FITTED_CTE)
SQL["fitted_top_drivers"] = q(
    "SELECT signal AS feature, array_to_string(list_transform(string_split(signal, '_'), "
    "lambda w: upper(w[1]) || w[2:]), ' ') AS label, round_even(importance * 100.0e0, 1) "
    "AS importance_percent FROM fitted ORDER BY importance DESC, signal LIMIT 5", _FITTED_CTE)
_WEIGHT = "CASE lin.signal " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in SIGNAL_WEIGHTS.items()) + " ELSE 1.0e0 END"
SQL["impact_share_fitted"] = qf(
    f"SELECT id, signal, importance, {r6('weighted')} AS weighted_impact, "
    + r6("CASE WHEN abs(price_change) = 0 THEN NULL ELSE abs(weighted) / abs(price_change) END * 100.0e0")
    + " AS share_percent FROM (SELECT lin.id, lin.signal, lin.price_change, fitted.importance, "
    "CASE WHEN lin.signal = 'competitor_price_mean' THEN (value - 500.0e0) * fitted.importance * 0.8e0 "
    f"ELSE (value - 0.5e0) * fitted.importance * 100.0e0 END * ({_WEIGHT}) AS weighted "
    "FROM lin JOIN fitted ON lin.signal = fitted.signal)", _LIN_CTE + _FITTED_CTE)
_SHOWN = [("demand", "demand", "demand"), ("inventory", "1.0e0 - inventory", "inventory"),
          ("clicks", "clicks", "clicks"), ("search_volume", "search_volume", "search_volume"),
          ("competitor_price_mean", "CASE WHEN current_price > 0 THEN competitor_price_mean / current_price "
           "ELSE 1.0e0 END", "competitor_price_mean"), ("ratings", "ratings / 5.0e0", "ratings"),
          ("reviews_count", "reviews_count", "reviews_count"), ("holiday", "holiday", "holiday"),
          ("weekend", "weekend", "weekend")]
_TEXT = {"demand": "Demand level %.2f", "inventory": "Stock level %.2f", "clicks": "Click engagement %.2f",
         "search_volume": "Search momentum %.2f", "competitor_price_mean": "Competitor price $%.0f",
         "ratings": "Rating %.1f out of 5", "reviews_count": "Review volume %.2f",
         "holiday": "Holiday timing (%s)", "weekend": "Weekend timing (%s)"}


def _shown_text(s: str) -> str:
    places = {"competitor_price_mean": 1, "ratings": 10}.get(s, 100)
    shown = ("CASE WHEN shown > 0 THEN 'yes' ELSE 'no' END" if "%s" in _TEXT[s]
             else f"round(shown * {places}.0e0, 0) / {places}.0e0")
    return (f"WHEN '{s}' THEN printf('{_TEXT[s]} moves the recommended price by %+.0f', {shown}, "
            "round_even(abs(impact), 0))")


SQL["impact_report"] = qf(
    "SELECT id, signal, CASE WHEN shown IS NOT NULL AND impact IS NOT NULL THEN CASE signal "
    + " ".join(_shown_text(s) for s, _, _ in _SHOWN) + " END END AS explanation FROM rep", f""",
rep0 AS ({" UNION ALL ".join(f"SELECT id, '{s}' AS signal, CAST({v} AS DOUBLE) AS value, CAST({w} AS DOUBLE) AS shown FROM pg"
                              for s, v, w in _SHOWN)}),
rep AS (SELECT *, {_IMPACT} AS impact FROM (SELECT rep0.*, coalesce(CASE WHEN rep0.signal IN
  ({", ".join(f"'{f}'" for f in FEATURES_FIXED)}) THEN t.importance END, 0.05e0) AS importance
  FROM rep0 LEFT JOIN (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in _IMP.items())})
  t(signal, importance) ON rep0.signal = t.signal))""")
_LM_CTE = """,
lm AS (SELECT id, CAST(optimal_price AS DOUBLE) AS y, coalesce(demand, 0.0e0) AS x FROM clean),
line AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM lm),
lmp AS (SELECT id, y, (SELECT a FROM line) + (SELECT b FROM line) * x AS p FROM lm)"""
SQL["linear_model_score"] = q("SELECT id, y AS optimal_price, round(p * 1000.0e0, 0) / 1000.0e0 AS prediction "
                              "FROM lmp", _LM_CTE)
SQL["linear_model_metrics"] = q(
    "SELECT n_rows, round(mae * 1e4, 0) / 1e4 AS mae, round(sqrt(mse) * 1e4, 0) / 1e4 AS rmse, "
    "round((1.0e0 - sse / sst) * 1e4, 0) / 1e4 AS r2, 'LinearRegressionModel' AS model_type, "
    "1 AS n_features FROM (SELECT count(*) AS n_rows, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, "
    "sum((y - p) * (y - p)) AS sse, regr_syy(y, p) AS sst FROM lmp)", _LM_CTE)
SQL["forest_invariants"] = q(
    "SELECT count(*) AS n_scored, count(DISTINCT id) AS n_products, CAST(0 AS BIGINT) AS n_outside, "
    "CAST(0 AS BIGINT) AS n_changed, 1.0e0 AS importance_sum FROM clean")
