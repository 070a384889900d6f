"""Deterministic numeric column helpers.

* Money is summed as ``decimal`` so totals do not depend on the order in which
  partitions are combined; the result is cast to double last.
* Rounding goes through a decimal so ``round(0.285, 2)`` is 0.29 whatever the
  binary value of the double (half-up, the SQL behaviour).
* Divisions are guarded: ANSI mode raises on division by zero, the reference's
  SQL returns NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
ROUNDING = "decimal(38,9)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: str | Column, scale: int = 0) -> Column:
    """Round a double half-up on its decimal value; result is double."""
    return F.round(col(c).cast(ROUNDING), scale).cast("double")


def money(c: str | Column) -> Column:
    """A double money amount as an exact decimal."""
    return col(c).cast(MONEY)


def money_sum(c: str | Column) -> Column:
    """Order-independent sum of money amounts (decimal result)."""
    return F.sum(money(c))


def rounded_money_sum(c: str | Column, scale: int = 2) -> Column:
    return F.round(money_sum(c), scale).cast("double")


def extended_value(quantity: str | Column, unit_cost: str | Column, scale: int | None = 2) -> Column:
    """quantity * unit cost, exact; rounded to ``scale`` unless None (decimal)."""
    value = col(quantity).cast("decimal(20,0)") * money(unit_cost)
    return value if scale is None else F.round(value, scale)


def safe_divide(numerator: str | Column, denominator: str | Column) -> Column:
    """numerator / denominator as double, NULL when the denominator is 0 or NULL."""
    den = col(denominator)
    return F.when(den != 0, col(numerator).cast("double") / den.cast("double"))


def pct(numerator: str | Column, denominator: str | Column) -> Column:
    """100 * numerator / denominator (double), NULL on a zero denominator.

    Evaluated as (100 * numerator) / denominator, the reference's order.
    """
    den = col(denominator)
    return F.when(den != 0, (F.lit(100.0) * col(numerator).cast("double")) / den.cast("double"))


def ceil_clean(c: str | Column, digits: int = 9) -> Column:
    """ceil after rounding away floating noise (375.00000000000006 -> 375)."""
    return F.ceil(F.round(col(c), digits)).cast("bigint")


def to_double(c: str | Column) -> Column:
    """Coerce dirty input: anything non-numeric becomes NULL (ANSI-safe)."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")
