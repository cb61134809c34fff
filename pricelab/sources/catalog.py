"""Catalog sources and sinks.

``catalog_from_tables`` derives a product catalog with the application's
input schema from the driver's star-schema tables (one row per part).  It is
the stand-in for the application's product CSV: it only produces rows of the
expected schema (including planted dirt), it computes no pricing result.

Scale notes: ``lineitem`` is the only large input.  It is scanned once and
aggregated per part with partial aggregation before the one shuffle (a part
holding a third of all lines costs one map-side combine, not one hot task); the
distinct unit prices are a set in that aggregate (bounded by the distinct prices
of the part).  The per-part aggregates of lines and events are joined by merging:
they grow with the input, so none is sent through the driver.  A task that meets many
parts sorts its lines before it combines them, so the lines are written per part
from splits of ``LINE_SPLIT`` bytes: more lines make more tasks, not larger sorts that
spill.  The catalog-wide
maxima used for normalisation are one scalar subquery (one row) over the
materialized per-part aggregate, so lineitem is aggregated exactly once.
Dimension tables are joined by key and left to Spark's size-checked broadcast.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.prices import round_to_long
from ..schema import CATALOG_SCHEMA, NA_MARKERS
from ..session import bounded_splits, materialize

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Fixed mapping of the fixture: sum of ship months mod 4 to a season name.
SEASON_BY_REMAINDER = ["Winter", "Spring", "Summer", "Fall"]
#: The lower 32 bits of a long.
LOW_HALF = (1 << 32) - 1
#: Bytes of a split of the lines: nearly two million lines, some 300 MB where a task sorts them by part.
LINE_SPLIT = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _share(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def catalog_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-part aggregate of the test tables (lazy): one row per part."""
    part = read_table(spark, sf_dir, "part")
    li = read_table(spark, sf_dir, "lineitem")
    ev = read_table(spark, sf_dir, "events")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    # One scan of lineitem and one aggregate per part, combined in the tasks before
    # its one exchange, so a part holding a third of all lines is a few rows by then.
    # Money and quantities are summed as exact integer cents (long); price x tax is
    # summed in two halves, which no number of lines of a part can overflow.
    def cents(c: str) -> Column:
        return round_to_long(F.col(c) * F.lit(100.0))

    unit = round_to_long(F.try_divide(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")), F.lit(10.0)))
    freight = cents("l_extendedprice") * cents("l_tax")
    lines = li.select(
        "l_partkey", unit.alias("unit"), cents("l_quantity").alias("qty_c"), cents("l_discount").alias("disc_c"),
        F.shiftright(freight, 32).alias("freight_hi"), freight.bitwiseAND(F.lit(LOW_HALF)).alias("freight_lo"),
        (F.col("l_returnflag") == "R").alias("ret"), F.col("l_suppkey").alias("sk"), F.month("l_shipdate").alias("mm"))
    n, wide = F.count(F.lit(1)), "decimal(38,0)"
    freight_c2 = F.sum("freight_hi").cast(wide) * F.lit(LOW_HALF + 1) + F.sum("freight_lo").cast(wide)
    li_agg = lines.groupBy("l_partkey").agg(
        n.alias("n_lines"),
        (F.sum("qty_c").cast("double") / F.lit(100.0)).alias("qty"),
        (F.sum("disc_c").cast("double") / F.lit(100.0) / n.cast("double")).alias("disc"),
        (freight_c2.cast("double") / F.lit(10000.0) / n.cast("double") / F.lit(100.0)).alias("freight"),
        F.count_if("ret").alias("n_ret"),
        F.min("sk").alias("sk"),
        F.sum("mm").alias("mm"),
        F.sort_array(F.collect_set("unit").cast("array<string>")).alias("units"),
    )

    n_part = part.select(F.count(F.lit(1))).scalar()
    ev_agg = ev.groupBy((F.col("event_id") % n_part).alias("ek")).agg(
        F.count_if(F.col("event_type") == "click").alias("c"),
        F.count_if(F.col("event_type") == "view").alias("v"),
    )

    base = (part.join(li_agg.hint("merge"), part.p_partkey == li_agg.l_partkey, "left")
            .join(ev_agg.hint("merge"), F.col("p_partkey") == F.col("ek"), "left")
            .join(sup, F.col("sk") == F.col("s_suppkey"), "left")
            .join(nat, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .join(reg, F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    return base.select(
        "p_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice", "n_lines",
        "qty", "disc", "freight", "n_ret", "mm", "units", "c", "v", "r_name")


def catalog_from_tables(spark: SparkSession, sf_dir: str, materialize_base: bool = True) -> DataFrame:
    """Raw (dirty) catalog with ``CATALOG_SCHEMA`` derived from the test tables.

    ``materialize_base`` writes the per-part aggregate once (parquet in the
    shared folder) so the normalisation maxima and the final projection do
    not both recompute the lineitem aggregation.
    """
    base = catalog_base(spark, sf_dir)
    if materialize_base:
        with bounded_splits(spark, LINE_SPLIT):
            base = materialize(base, "catalog-base")

    # one scalar subquery (a single row) for all normalisation maxima
    mx = base.select(F.struct(F.max("qty").alias("q"), F.max("c").alias("c"),
                              F.max("v").alias("v"), F.max("n_lines").alias("n"))).scalar()
    max_qty, max_c, max_v, max_n = (mx.getField(k) for k in ("q", "c", "v", "n"))

    pid = F.col("p_partkey")
    demand = _share(F.col("qty"), max_qty)
    inventory = (F.col("p_size") - 1) / F.lit(49.0)
    season = F.element_at(F.array(*[F.lit(s) for s in SEASON_BY_REMAINDER]),
                          (F.col("mm") % 4 + 1).cast("int"))
    ratings = (F.expr("(101 * n_lines - 80 * n_ret) div (2 * n_lines)").cast("double")
               / F.lit(10.0))
    comp = F.concat(F.lit("["), F.array_join("units", ", "), F.lit("]"))
    price = F.round((F.col("p_retailprice") - F.lit(880.0)) * F.lit(5.0)
                    + F.lit(300.0) * demand + F.lit(100.0) * (F.lit(1.0) - inventory), 0)
    weekend = pid % 3 == 0

    out = base.select(
        pid.alias("id"),
        F.when(pid % 50 != 7, F.col("p_name")).alias("productDisplayName"),
        F.col("p_type").alias("articleType"),
        F.split(F.col("p_name"), " ").getItem(0).alias("baseColour"),
        season.alias("season"),
        F.col("p_brand").alias("material"),
        F.col("r_name").alias("location"),
        demand.alias("demand"),
        inventory.alias("inventory"),
        _share(F.col("c"), max_c).alias("clicks"),
        _share(F.col("v"), max_v).alias("search_volume"),
        _share(F.col("n_lines"), max_n).alias("reviews_count"),
        F.when(pid % 41 != 3, ratings).alias("ratings"),
        F.col("disc").alias("discount_percentage"),
        F.col("freight").alias("freight_price"),
        F.when(pid % 97 == 11, F.lit("unknown"))
         .when(pid % 89 == 13, F.lit("[]"))
         .when(pid % 83 == 17, F.lit(None).cast("string"))
         .otherwise(comp).alias("competitor_prices"),
        F.when(pid % 61 == 5, F.lit(None).cast("string"))
         .when(F.col("mm") % 12 == 0, F.lit("1")).otherwise(F.lit("0")).alias("holiday"),
        F.when(weekend, F.lit("1")).otherwise(F.lit("0")).alias("weekend"),
        F.when(weekend, F.lit("0")).otherwise(F.lit("1")).alias("weekday"),
        (pid % 2).cast("int").alias("customer_segment"),
        F.when(pid % 101 == 1, F.lit("bad"))
         .otherwise(price.cast("bigint").cast("string")).alias("optimal_price"),
    )
    return out


def _text_schema(*more: str) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in (*(f.name for f in CATALOG_SCHEMA), *more)])


def _csv(spark: SparkSession, mode: str, multi_line: bool):
    return (spark.read.option("header", True).option("escape", '"').option("mode", mode).option("multiLine", multi_line))


def _fits(field: StructField) -> Column:
    """The cell as its column's type if it is a value of it, else NULL (also for a NaN, which is a missing mark)."""
    value = F.col(f"`{field.name}`").try_cast(field.dataType)
    return F.when(~F.isnan(value), value) if field.dataType == DoubleType() else value


def read_catalog_csv(spark: SparkSession, path: str, na_values: Sequence[str] = NA_MARKERS,
                     multi_line: bool = False) -> DataFrame:
    """Catalog CSV scan with the declared schema (no inference, quoted list cells).

    Cells whose text is one of ``na_values`` are missing; any other text that
    does not fit its column's type fails the query.  ``multi_line`` reads
    quoted line breaks (a file is then not split).
    """
    rows = _csv(spark, "FAILFAST", multi_line).schema(_text_schema()).csv(path)
    out = []
    for f in CATALOG_SCHEMA:
        # most cells are values; only the others are held against the markers, and the cast fails on what is left
        known = F.when(~F.col(f.name).isin(list(na_values)), F.col(f.name))
        out.append((known if f.dataType == StringType() else F.coalesce(_fits(f), known.cast(f.dataType))).alias(f.name))
    return rows.select(*out)


class CatalogLoad(NamedTuple):
    good: DataFrame         # rows of the declared schema
    quarantine: DataFrame   # file, record (its text), problems (array of text)
    n_good: int
    n_quarantined: int


def load_catalog_csv(spark: SparkSession, path: str, table_dir: str, na_values: Sequence[str] = NA_MARKERS,
                     multi_line: bool = False, max_bad_share: float = 1.0) -> CatalogLoad:
    """Tolerant load: broken rows go to a quarantine table and the others stay.

    A row is broken if it has too few or too many cells, or a cell that is
    neither a value of its column's type nor one of ``na_values``; ``problems``
    names each.  The files are scanned once: typed and broken rows are written to
    ``table_dir`` side by side (partition ``ok``), and an observation counts them on the way.
    More than ``max_bad_share`` of broken rows raises, with both tables left to look at.
    """
    corrupt = "_corrupt_record"
    rows = (_csv(spark, "PERMISSIVE", multi_line).option("columnNameOfCorruptRecord", corrupt)
            .schema(_text_schema(corrupt)).csv(path).select("*", F.col("_metadata.file_path").alias("_file")))
    problems = [F.when(F.col(corrupt).isNotNull(), F.lit("wrong number of cells"))]
    typed = []
    for f in CATALOG_SCHEMA:
        text = F.col(f.name)
        known = F.when(~text.isin(list(na_values)), text)
        if f.dataType == StringType():
            typed.append(known.alias(f.name))
            continue
        typed.append(_fits(f).alias(f.name))
        odd = F.col(corrupt).isNull() & _fits(f).isNull() & known.isNotNull()
        problems.append(F.when(odd, F.concat(F.lit(f"{f.name}: "), text)))
    record = F.coalesce(F.col(corrupt), F.to_csv(F.struct(*[F.col(f.name) for f in CATALOG_SCHEMA])))
    found = F.array_compact(F.array(*problems))
    parsed = rows.select(*typed, found.alias("_problems"), F.when(F.size(found) > 0, record).alias("_record"),
                         "_file", (F.size(found) == 0).alias("ok"))
    seen = Observation()
    counted = parsed.observe(seen, F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))
    counted.write.mode("overwrite").partitionBy("ok").parquet(table_dir)
    n_good, n_bad = int(seen.get["good"]), int(seen.get["bad"])
    if n_bad > max_bad_share * (n_good + n_bad):
        raise ValueError(f"{n_bad} of {n_good + n_bad} rows are broken; see {table_dir}/ok=false")
    written = spark.read.schema(StructType([*CATALOG_SCHEMA.fields, *parsed.schema.fields[-4:]])).parquet(table_dir)
    return CatalogLoad(written.where("ok").select(*[f.name for f in CATALOG_SCHEMA]),
                       written.where("not ok").select(F.col("_file").alias("file"), F.col("_record").alias("record"),
                                                      F.col("_problems").alias("problems")), n_good, n_bad)


def read_catalog_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).parquet(path)


def write_catalog_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .csv(path))


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Report sink: every report is a DataFrame; write it where the caller says."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_report_parts(df: DataFrame, path: str, parts: Sequence[str], run: str) -> None:
    """Report sink by partition: only the parts that ``df`` has are replaced (dynamic overwrite).

    A marker is written before (``_runs/<run>/begun``) and one after
    (``_runs/<run>/done``), so read_report_parts() can tell a run that broke off.
    Running the same ``run`` again replaces the same parts and its markers.
    """
    spark = df.sparkSession
    mark = spark.range(1).select(F.lit(",".join(parts)).alias("value"))
    mark.write.mode("overwrite").text(f"{path}/_runs/{run}/begun")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/rows")
    mark.write.mode("overwrite").text(f"{path}/_runs/{run}/done")


def read_report_parts(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned report; raises if a run has begun and not ended."""
    jvm = spark.sparkContext._jvm
    runs = jvm.org.apache.hadoop.fs.Path(f"{path}/_runs")
    fs = runs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for run in fs.listStatus(runs):
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(run.getPath(), "done/_SUCCESS")):
            raise RuntimeError(f"run {run.getPath().getName()} of {path} has begun and not ended: run it again")
    return spark.read.parquet(f"{path}/rows")
