from .pricing import catalog_stream, pricing_kpi_stream, run_available
from .stats import (RANK_ERROR, add_sketch, arrivals, category_shares, category_stats, cells, compact, median_fill_stream,
                    newest_cells, overview, run_to_table, season_means, sketch_quantile)

__all__ = ["RANK_ERROR", "add_sketch", "arrivals", "catalog_stream", "category_shares", "category_stats", "cells", "compact",
           "median_fill_stream", "newest_cells", "overview", "pricing_kpi_stream", "run_available", "run_to_table",
           "season_means", "sketch_quantile"]
