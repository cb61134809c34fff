"""HLL sketches by file: only new files are read, merged counts stay within their error."""
from pricelab.functions.distinct import add_files, distinct_counts, error_bound
from pricelab.session import scratch_path


def test_loads_add_up(spark):
    source, table = scratch_path(spark, "t-src"), scratch_path(spark, "t-sk")
    rows = spark.range(40_000).selectExpr("id", "cast(id % 7 as string) as few", "concat('v', id % 9000) as many",
                                          "if(id % 2 = 0, null, cast(id as string)) as odd", "cast(null as string) as none")
    columns = ["few", "many", "odd", "none"]
    loads = []
    for k in range(4):
        rows.where(f"id % 4 = {k}").repartition(2).write.mode("append").parquet(source)
        loads.append(add_files(spark, source, rows.schema, table, columns))
    assert loads == [2, 2, 2, 2] and add_files(spark, source, rows.schema, table, columns) == 0
    got = {r["column"]: r for r in distinct_counts(spark, table, columns).collect()}
    for c, n in (("few", 7), ("many", 9000), ("odd", 20_000), ("none", 0)):
        assert abs(got[c].estimate - n) <= max(1, n * error_bound()) and got[c].n_rows == 40_000


def test_empty_source(spark):
    source, table = scratch_path(spark, "t-src"), scratch_path(spark, "t-sk")
    rows = spark.createDataFrame([], "a string")
    rows.write.parquet(source)
    add_files(spark, source, rows.schema, table, ["a"])
    assert [(r.estimate or 0) for r in distinct_counts(spark, table, ["a"]).collect()] == [0]
