"""Compare the Spark catalog view with its DuckDB twin, row by row."""
import sys

import duckdb

sys.path.insert(0, "/root/repo")
from pricelab.oracle import CATALOG_CTES  # noqa: E402
from pricelab.session import local_session  # noqa: E402
from pricelab.sources import catalog_from_tables  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = local_session()
sdf = catalog_from_tables(spark, sf).toPandas().sort_values("id").reset_index(drop=True)
con = duckdb.connect()
for t in ["region", "nation", "supplier", "part", "lineitem", "events"]:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
ddf = con.execute("WITH " + CATALOG_CTES + " SELECT * FROM raw_catalog ORDER BY id").df()
print(len(sdf), len(ddf))
bad = 0
for c in sdf.columns:
    a, b = sdf[c], ddf[c]
    diff = ~((a == b) | (a.isna() & b.isna()))
    if diff.any():
        bad += 1
        print("MISMATCH", c, int(diff.sum()), a[diff].head(3).tolist(), b[diff].head(3).tolist())
print("columns differing:", bad)
print(sdf.head(3).T)
