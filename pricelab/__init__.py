"""pricelab: product-pricing analytics as lazy Spark DataFrame operators.

Every public operator takes a DataFrame and returns a DataFrame.  Nothing is
collected to the driver except schema information and bounded, size-checked
vocabularies.  Typical use::

    from pricelab.plans.catalog import cleaned_catalog
    from pricelab.plans.reports import profile_reports, write_reports
    clean = cleaned_catalog(spark, "/path/to/tables")
    write_reports(profile_reports(clean), "/shared/reports")
"""

__all__ = ["functions", "operators", "plans", "schema", "session", "sources", "streaming"]
