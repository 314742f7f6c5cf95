"""Means and how registered queries print them.

A mean is the plain `avg` of the values, in batch and on streams. Its last
bits depend on the order of summation, so a registered query prints means
with `round6`, and its oracle with `round6_sql`: six decimals, where a mean
that lies on a rounding border (to within the noise of the summation) is
lifted off it on both sides alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import as_col

#: Far above the noise of a sum of doubles, far below the last printed digit.
BORDER = 1e-9


def round_mean(x, digits: int) -> Column:
    """HALF_UP rounding of a computed mean, independent of the order of summation."""
    return F.round(as_col(x) + F.lit(BORDER), digits)


def round_mean_sql(x: str, digits: int) -> str:
    return f"round({x} + {BORDER!r}, {digits})"


def round6(df: DataFrame, cols: list[str]) -> DataFrame:
    """The named columns as a registered query prints them."""
    return df.withColumns({c: round_mean(c, 6) for c in cols})


def round6_sql(sql: str, cols: list[str]) -> str:
    """The same for the DuckDB text of a query."""
    inner = ", ".join(f"{round_mean_sql(c, 6)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({inner}) FROM ({sql})"
