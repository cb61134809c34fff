"""Tolerant load with a quarantine table; reports written by part."""
import pytest
from pyspark.sql import functions as F

from pricelab import schema as S
from pricelab.plans.catalog import raw_catalog
from pricelab.session import scratch_path
from pricelab.sources import (load_catalog_csv, read_catalog_csv, read_report_parts, write_catalog_csv, write_report_parts)

from paths import SF_SMALL

N = len(S.CATALOG_SCHEMA.fields)
HEADER = ",".join(S.CATALOG_SCHEMA.names)


def write_lines(spark, path, lines, mode="append"):
    (spark.createDataFrame(list(enumerate(lines)), "k int, value string").coalesce(1).sortWithinPartitions("k")
     .select("value").write.mode(mode).text(path))


def line(**cells):
    return ",".join(str(cells.get(n, "")) for n in S.CATALOG_SCHEMA.names)


def test_good_rows_are_those_of_the_strict_scan(spark):
    path = scratch_path(spark, "t-csv")
    write_catalog_csv(raw_catalog(spark, SF_SMALL), path)
    strict = read_catalog_csv(spark, path)
    load = load_catalog_csv(spark, path, scratch_path(spark, "t-loaded"))
    assert load.good.schema == strict.schema or load.good.schema.simpleString() == strict.schema.simpleString()
    assert sorted(map(str, load.good.collect())) == sorted(map(str, strict.collect()))
    assert load.quarantine.count() == load.n_quarantined == 0 and load.n_good == strict.count()


def test_broken_rows_go_to_quarantine(spark):
    path = scratch_path(spark, "t-csv")
    lines = [HEADER, line(id=1, demand="0.5", clicks="NaN", season="n/a"), line(id=2, demand="much", ratings="4,5"), "3,short",
             line(id="x4"), line(id=5, customer_segment="2.5", demand="1e400"), line(id=6, productDisplayName='"a ""quoted"" name, yes"'),
             line(id=7) + ",,"]
    write_lines(spark, path, lines)
    load = load_catalog_csv(spark, path, scratch_path(spark, "t-loaded"))
    good = {r.id: r for r in load.good.collect()}
    assert set(good) >= {1, 6} and good[1].demand == 0.5 and good[1].clicks is None and good[1].season is None
    assert good[6].productDisplayName == 'a "quoted" name, yes'
    bad = {r.record.split(",")[0].strip('"'): r for r in load.quarantine.collect()}
    assert set(bad) == {"2", "3", "x4", "5", "7"} and len(bad) == load.n_quarantined and load.n_good == 2
    assert bad["x4"].problems == ["id: x4"] and bad["3"].problems == ["wrong number of cells"]
    assert "customer_segment: 2.5" in bad["5"].problems
    assert all(r.file.endswith(".txt") for r in bad.values())
    with pytest.raises(ValueError, match="5 of 7"):
        load_catalog_csv(spark, path, scratch_path(spark, "t-loaded"), max_bad_share=0.5)
    with pytest.raises(Exception):
        read_catalog_csv(spark, path).collect()


def test_empty_folder_of_rows(spark):
    path = scratch_path(spark, "t-csv")
    write_lines(spark, path, [HEADER])
    load = load_catalog_csv(spark, path, scratch_path(spark, "t-loaded"))
    assert (load.n_good, load.n_quarantined, load.good.count(), load.quarantine.count()) == (0, 0, 0, 0)


def test_a_run_replaces_only_its_part(spark):
    path = scratch_path(spark, "t-parts")
    rows = spark.createDataFrame([(s, d, n) for n, (s, d) in enumerate([("a", 1), ("a", 2), ("b", 1), ("c", None)])], "s string, d int, n int")
    write_report_parts(rows, path, ["s"], "first")
    write_report_parts(rows.where("s = 'a' and d = 1").withColumn("n", F.lit(9)), path, ["s"], "second")
    got = lambda: sorted((r.s, r.d or 0, r.n) for r in read_report_parts(spark, path).collect())
    want = [("a", 1, 9), ("b", 1, 2), ("c", 0, 3)]
    assert got() == want
    write_report_parts(rows.where("s = 'a' and d = 1").withColumn("n", F.lit(9)), path, ["s"], "second")
    assert got() == want
    # a run that broke off is noticed, and running it again mends it
    spark.range(1).selectExpr("'s' AS value").write.mode("overwrite").text(f"{path}/_runs/third/begun")
    with pytest.raises(RuntimeError, match="third"):
        read_report_parts(spark, path)
    write_report_parts(rows.where("s = 'b'"), path, ["s"], "third")
    assert got() == want
