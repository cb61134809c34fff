"""Shared-folder rules, changed inputs, CSV markers, and a part that holds a third of all lines."""
import os
import shutil

import pytest
from pyspark.sql import functions as F

from pricelab import session
from pricelab.plans.catalog import cleaned_catalog, raw_catalog
from pricelab.plans.registry import REGISTRY
from pricelab.sources.catalog import read_catalog_csv

from paths import SF_SMALL


class _Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class _Session:
    sparkContext = _Context()

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session())


def test_clean_up_deletes_what_was_written(spark):
    path = session.write_shared(spark.range(3), "t-clean-up")
    others = session._WRITTEN.pop(spark.sparkContext.applicationId)
    session._WRITTEN[spark.sparkContext.applicationId] = [path]
    try:
        assert session.clean_up(spark) == 1
        assert session.input_version(spark, path) is None
    finally:
        session._WRITTEN[spark.sparkContext.applicationId] = [p for p in others if p != path]


@pytest.fixture()
def tables(tmp_path):
    for t in ("part", "lineitem", "events", "supplier", "nation", "region"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    return tmp_path


def test_changed_input_is_rebuilt(spark, tables):
    sf = f"file://{tables}"
    n = raw_catalog(spark, sf).count()
    assert raw_catalog(spark, sf).count() == n
    spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 2 = 0").toPandas().to_parquet(tables / "part2")
    os.replace(tables / "part2", tables / "part.parquet")
    assert 0 < raw_catalog(spark, sf).count() < n


def test_part_with_a_third_of_all_lines(spark, tables):
    """Thousands of distinct prices of one part: one long list, parsed item by item."""
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    part = lines.agg(F.min("l_partkey")).first()[0]
    hot = lines.where("l_orderkey % 3 = 0").withColumns({
        "l_partkey": F.lit(part).cast(lines.schema["l_partkey"].dataType),
        "l_extendedprice": (F.monotonically_increasing_id() % 100_000 * 10 + 5000) * F.col("l_quantity")})
    both = lines.where("l_orderkey % 3 <> 0").unionByName(
        hot.select(*[F.col(c).cast(lines.schema[c].dataType).alias(c) for c in lines.columns]))
    both.toPandas().to_parquet(tables / "l2", coerce_timestamps="us", allow_truncated_timestamps=True)
    os.replace(tables / "l2", tables / "lineitem.parquet")
    sf = str(tables)
    row = REGISTRY["competitor_mean"](spark, sf).where(F.col("id") == part).first()
    assert row.competitor_prices.count(",") > 800 and row.competitor_price_mean > 0
    assert REGISTRY["price_by_category_top10"](spark, sf).count() > 0


def test_csv_missing_markers_and_line_breaks(spark, tmp_path):
    raw = raw_catalog(spark, SF_SMALL)
    names = raw.columns
    row = {c: "" for c in names} | {"id": "1", "productDisplayName": "NA", "season": "nan", "demand": "0.5",
                                    "competitor_prices": "[1, 2]", "holiday": "null", "location": "x\ny"}
    file = tmp_path / "c.csv"
    file.write_text(",".join(names) + "\n" + ",".join(f'"{row[c]}"' for c in names) + "\n")
    got = read_catalog_csv(spark, str(file), multi_line=True).first()
    assert (got.id, got.productDisplayName, got.season, got.demand, got.location) == (1, None, None, 0.5, "x\ny")
    assert got.holiday is None and got.ratings is None
    file.write_text(",".join(names) + "\n" + ",".join("oops" if c == "demand" else "1" for c in names) + "\n")
    with pytest.raises(Exception):
        read_catalog_csv(spark, str(file)).collect()


def test_label_editions(spark):
    filled, loaded = cleaned_catalog(spark, SF_SMALL), cleaned_catalog(spark, SF_SMALL, label="null")
    missing = loaded.where("optimal_price IS NULL").select("id")
    assert missing.count() > 0 and filled.where("optimal_price IS NULL").count() == 0
    assert filled.join(missing, "id").where("optimal_price <> 500").count() == 0
