"""Exact percentages and means as Column expressions.

The arguments are column names or SQL text, so that a summary row with a dozen
percentages stays a short select list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = "decimal(30,6)"


def pct(num: str, den: str) -> Column:
    """``num`` as a percentage of ``den``: 2 decimals, half away from zero, as DOUBLE.

    NULL when ``den`` is 0 or NULL.  The rounding is done on integers, so a tie such
    as 1/32 = 3.125 % never depends on how a double happens to be stored.
    """
    n, d = f"cast({num} as {_EXACT})", f"cast({den} as {_EXACT})"
    sign = f"case when ({n} < 0) <> ({d} < 0) then -1 else 1 end"
    hundredths = f"(abs({n}) * 20000 + abs({d})) div nullif(abs({d}) * 2, 0)"
    return F.expr(f"({sign}) * ({hundredths}) / 100D")


def milli(score: str) -> str:
    """SQL text: a 3-decimal score as a whole number of thousandths, so sums stay exact."""
    return f"cast({score} * 1000 as bigint)"


def mean_milli(total_milli: str, n: str) -> Column:
    """Mean of thousandths, rounded half up to 3 decimals, as DOUBLE; NULL when n = 0."""
    return F.expr(f"((({total_milli}) * 2 + ({n})) div nullif(({n}) * 2, 0)) / 1000D")


def none(sql_type: str) -> Column:
    return F.lit(None).cast(sql_type)
