"""Text helpers: money rendering and landing-page titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
# Title text before the first '|' (trailing blanks dropped); no '|' -> NULL.
# `(?d)`: only "\n" ends a line, as in the reports' regex dialect; its blank
# class has no vertical tab.
TITLE_PREFIX_PATTERN = r"(?d)^(.*?)[\t\n\f\r ]*\|"
# ---------------------------------------------------------------------------


def money_text(x: Column) -> Column:
    """A double as plain digits, without a trailing '.0': 25.0 -> '25',
    25.5 -> '25.5', 1e29 -> '1' and 29 zeros, 0.0005 -> '0.0005'.

    One rule for every finite double: the digits of its shortest text, with
    the point moved by the exponent. NaN gives 'NaN', infinities 'inf' and
    '-inf'; NULL gives NULL."""
    text = x.cast("string")
    sign = F.regexp_extract(text, "^(-?)", 1)
    whole, rest = F.regexp_extract(text, r"^-?([0-9]+)", 1), F.regexp_extract(text, r"\.([0-9]+)", 1)
    exponent = F.coalesce(F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits, point = F.concat(whole, rest), F.length(whole) + exponent
    # zeros on both sides, so that the point always falls between digits
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    before = F.concat(zeros(F.lit(1) - point), F.substring(F.concat(digits, zeros(point - F.length(digits))), F.lit(1), F.greatest(point, F.lit(0))))
    after = F.concat(zeros(-point), F.substring(digits, F.greatest(point, F.lit(0)) + 1, F.length(digits)))
    after = F.regexp_replace(after, "0+$", "")
    plain = F.concat(sign, F.regexp_replace(before, "^0+(?=[0-9])", ""), F.when(after != "", F.concat(F.lit("."), after)).otherwise(F.lit("")))
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("NaN"))
        .when(F.abs(x) == F.lit(float("inf")), F.concat(sign, F.lit("inf")))
        .otherwise(plain)
    )


def landing_page_title(title: Column) -> Column:
    """Capture group 1 of TITLE_PREFIX_PATTERN, NULL when it does not match
    (Spark's regexp_extract alone would give '')."""
    return F.when(title.rlike(TITLE_PREFIX_PATTERN), F.regexp_extract(title, TITLE_PREFIX_PATTERN, 1))
