"""Catalog inputs shared by the registered queries.

The raw catalog is derived from the driver's tables and the cleaned catalog
from it; both are written once per Spark application and input folder to the
shared checkpoint folder (parquet) and every report reads that table, the way
the application reads its catalog file.  The cache key includes the input
files' sizes and modification times, taken from the store that holds them, so
changed inputs are rebuilt.  ``pricelab.session.clean_up`` deletes the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.narrowing import column_quantiles
from ..operators.cleaning import clean_catalog, clean_flags, clean_label, impute_competitor_mean
from ..session import input_version, write_shared
from ..sources.catalog import catalog_from_tables

SOURCE_TABLES = ["part", "lineitem", "events", "supplier", "nation", "region"]
_CACHE: dict[tuple, str] = {}
_MEDIANS: dict[tuple, float | None] = {}


def catalog_key(spark: SparkSession, sf_dir: str, kind: str) -> tuple:
    versions = tuple(input_version(spark, f"{sf_dir}/{t}.parquet") for t in SOURCE_TABLES)
    return (spark.sparkContext.applicationId, sf_dir, kind, versions)


def _cached(spark: SparkSession, key: tuple) -> DataFrame | None:
    path = _CACHE.get(key)
    if path is None:
        return None
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - the folder was removed: rebuild
        _CACHE.pop(key, None)
        return None


def _store(df: DataFrame, key: tuple, name: str) -> DataFrame:
    path = write_shared(df, name)
    _CACHE[key] = path
    return df.sparkSession.read.parquet(path)


def raw_catalog(spark: SparkSession, sf_dir: str, cache: bool = True) -> DataFrame:
    """The dirty catalog derived from the test tables."""
    if not cache:
        return catalog_from_tables(spark, sf_dir)
    key = catalog_key(spark, sf_dir, "raw")
    hit = _cached(spark, key)
    if hit is not None:
        return hit
    return _store(catalog_from_tables(spark, sf_dir), key, "catalog-raw")


def raw_catalog_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the written raw catalog files (built on first use)."""
    raw_catalog(spark, sf_dir)
    return _CACHE[catalog_key(spark, sf_dir, "raw")]


def _clean_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned catalog as written: price lists parsed once, missing competitor means not filled yet."""
    key = catalog_key(spark, sf_dir, "clean-core")
    core = _cached(spark, key)
    if core is None:
        core = _store(clean_catalog(raw_catalog(spark, sf_dir), flags=None, label="null", impute=False),
                      key, "catalog-clean-core")
    return core


def competitor_median(spark: SparkSession, sf_dir: str) -> float | None:
    """Exact median of the catalog's known competitor means; found once per application and input."""
    key = catalog_key(spark, sf_dir, "competitor-median")
    if key not in _MEDIANS:
        means = _clean_core(spark, sf_dir)
        _MEDIANS[key] = column_quantiles(means, ["competitor_price_mean"], [0.5]).first()["q"][0]
    return _MEDIANS[key]


def cleaned_catalog(spark: SparkSession, sf_dir: str, flags: str = "strict",
                    cache: bool = True, label: str = "fill") -> DataFrame:
    """Catalog after load-time cleaning (strict flags = optimizer edition).

    The editions share one written core (names, competitor mean before the fill);
    the median that fills it, found once from that core, the flag rule and the
    label's fill value are a projection.  ``label="null"`` leaves an unparsable
    label missing, as the data profile shows it.
    """
    if not cache:
        return clean_catalog(raw_catalog(spark, sf_dir, cache=False), flags=flags, label=label)
    core = impute_competitor_mean(_clean_core(spark, sf_dir), median=competitor_median(spark, sf_dir))
    return clean_flags(clean_label(core, label), flags)


def clear_cache() -> None:
    _CACHE.clear()
    _MEDIANS.clear()
