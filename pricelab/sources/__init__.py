from .catalog import (CatalogLoad, catalog_from_tables, load_catalog_csv, read_catalog_csv, read_catalog_parquet, read_report_parts,
                      read_table, write_catalog_csv, write_report, write_report_parts)

__all__ = ["CatalogLoad", "catalog_from_tables", "load_catalog_csv", "read_catalog_csv", "read_catalog_parquet",
           "read_report_parts", "read_table", "write_catalog_csv", "write_report", "write_report_parts"]
