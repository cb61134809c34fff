from .prices import (clip, flag_lenient, flag_strict, is_numeric_list, nan_to_null, price_coerce,
                     price_list_mean, price_list_values, sign_label, tiers)
from .stats import exact_median, exact_quantiles, histogram, safe_corr, unpivot_values

__all__ = ["clip", "flag_lenient", "flag_strict", "is_numeric_list", "nan_to_null", "price_coerce",
           "price_list_mean", "price_list_values", "sign_label", "tiers", "exact_median",
           "exact_quantiles", "histogram", "safe_corr", "unpivot_values"]
