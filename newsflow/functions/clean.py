"""Value cleaning for text read from CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The CSV cells that mean "no value".
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# The JVM reads "1d", "2f" and hexadecimal literals as numbers; a number in
# these files is plain decimal text.
_NOT_DECIMAL = r"(?i)[0-9.][df]\s*$|x"


def null_if_na(col: Column) -> Column:
    """NULL for a cell that spells a missing value."""
    return F.when(~col.isin(*NA_TOKENS), col)


def null_if_blank(col: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(col, F.lit(""))


def first_present(*cols: Column) -> Column:
    """First argument that is neither NULL nor empty."""
    return F.coalesce(*[null_if_blank(c) for c in cols])


def null_if_nan(col: Column) -> Column:
    """NULL for a floating-point NaN."""
    return F.when(~F.isnan(col), col)


def to_double(col: Column) -> Column:
    """Text to DOUBLE; anything unreadable, and NaN, becomes NULL."""
    return null_if_nan(F.when(~col.rlike(_NOT_DECIMAL), col.try_cast("double")))


def to_count(col: Column) -> Column:
    """Text to BIGINT, truncated towards zero; unreadable or missing becomes 0."""
    return F.coalesce(to_double(col).try_cast("bigint"), F.lit(0).cast("bigint"))
