"""Column expressions for price lists and simple numeric guards.

All expressions are built-in Spark functions (whole-stage codegen, no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INVALID_PRICE_LIST_MEAN


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# One item of a numeric list literal (fixed rule of the parser): an optional sign, then
# zeros, an integer with single underscores between digits, a decimal with an optional
# exponent, or an integer with an exponent.  No part repeats a group, so matching never
# recurses, and no pattern runs over more than one item.
ITEM = (r"^\s*[+-]?(0+|[1-9]([0-9_]*[0-9])?"
        r"|([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
        r"|[0-9]+[eE][+-]?[0-9]+)\s*$")
BRACKETS = r"^[ \t]*\[[^\[\]]*\]\s*$"


def price_list_items(text) -> Column:
    """array<string> of what stands between the commas; one blank last item is left out."""
    inner = F.regexp_replace(_col(text), r"[\[\]]", "")
    items = F.split(inner, ",", -1)
    blank = F.trim(F.regexp_replace(F.element_at(items, -1), r"\s", "")) == ""
    return F.when(blank, F.slice(items, F.lit(1), F.size(items) - 1)).otherwise(items)


def is_numeric_list(text) -> Column:
    """True when the text is a literal list of plain numbers (``[1, 2.5]``), item by item."""
    numeric = F.forall(price_list_items(text), lambda x: x.rlike(ITEM) & ~x.contains("__"))
    return F.coalesce(_col(text).rlike(BRACKETS) & numeric, F.lit(False))


def price_list_values(text) -> Column:
    """array<double> of the list items (blanks and digit underscores removed, one array cast)."""
    inner = F.regexp_replace(_col(text), r"[\[\]\s_]", "")
    return F.array_remove(F.split(inner, ","), "").try_cast("array<double>")


def price_list_mean(text, invalid: float = INVALID_PRICE_LIST_MEAN) -> Column:
    """Mean of a numeric list literal; ``invalid`` for anything else.

    The empty list ``[]`` yields NULL (a mean of nothing), which the median
    imputation step then fills.  Splitting, dropping empty items and the cast are
    code-generated; only the sum is an interpreted pass over the items.
    """
    vals = price_list_values(text)
    total = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.try_divide(total, F.size(vals).cast("double"))
    return F.when(is_numeric_list(text), mean).otherwise(F.lit(float(invalid)))


def nan_to_null(c) -> Column:
    """NaN becomes NULL: aggregates then skip it (one missing marker only)."""
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def clip(c, lo: float | None, hi: float | None) -> Column:
    """Clip to [lo, hi] (either bound may be None); NULL stays NULL.

    ``greatest``/``least`` skip NULL arguments, so an unguarded clip would turn
    a missing value into a bound.
    """
    x = _col(c)
    y = x
    if hi is not None:
        y = F.least(F.lit(float(hi)), y)
    if lo is not None:
        y = F.greatest(F.lit(float(lo)), y)
    return F.when(x.isNotNull(), y)


def flag_strict(c) -> Column:
    """NULL to 0, truncate to int, clip to [0, 1]; unparsable text raises (ANSI)."""
    as_int = F.coalesce(_col(c).cast("string"), F.lit("0")).cast("double").cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(1), as_int))


def flag_lenient(c) -> Column:
    """Unparsable or NULL to 0.0; no clipping; stays double."""
    return F.coalesce(_col(c).cast("string").try_cast("double"), F.lit(0.0))


def price_coerce(c, missing: float) -> Column:
    """Unparsable or NULL price to ``missing``."""
    return F.coalesce(nan_to_null(_col(c).cast("string").try_cast("double")),
                      F.lit(float(missing)))


def sign_label(c, positive="positive", negative="negative", neutral="neutral") -> Column:
    x = _col(c)
    return F.when(x > 0, F.lit(positive)).when(x < 0, F.lit(negative)).otherwise(F.lit(neutral))


def tiers(c, levels, otherwise) -> Column:
    """``levels`` = [(threshold, label), ...] tested in order with strict ``>``."""
    x = _col(c)
    expr = None
    for thr, label in levels:
        expr = (F.when(x > thr, F.lit(label)) if expr is None
                else expr.when(x > thr, F.lit(label)))
    return expr.otherwise(F.lit(otherwise))


def round_to(c, digits: int) -> Column:
    """Round half away from zero at ``digits`` places: ``round(x * 10^d) / 10^d``.

    The scaling is one exact IEEE multiply and the integer rounding of a value
    below 2^52 is exact, so any engine that follows IEEE arithmetic gets the same
    digits (rounding the decimal form directly differs between engines on values
    whose shortest decimal form ends in 5).
    """
    scale = F.lit(float(10 ** digits))
    return F.round(_col(c) * scale, 0) / scale


def round_to_long(c) -> Column:
    """A double rounded half away from zero to a whole number (long).

    Same as ``round(c, 0)`` cast to long, which prints each double as a decimal
    first; the part behind the point is exact here, so nothing needs printing.
    """
    x = _col(c)
    whole = x.cast("long")
    rest = x - whole.cast("double")
    return whole + F.when(rest >= 0.5, F.lit(1)).when(rest <= -0.5, F.lit(-1)).otherwise(F.lit(0))


def round6(c) -> Column:
    """Reported doubles: 6 places (order-dependent last bits of sums do not leak)."""
    return round_to(c, 6)
