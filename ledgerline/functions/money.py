"""Exact money arithmetic.

Prices carry two decimals and discounts at most four, so multiplying exact
decimals and summing them gives the same cents in any order and on any engine.
The double form (multiply and sum in DOUBLE, cast the sum) is kept behind
``exact=False``; its sums depend on the order rows are added in.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

# Line-level types hold every price and quantity whose sums fit the report, so no
# legal line is refused; a value with more decimals than its type raises instead of
# being rounded.
PRICE = DecimalType(12, 2)
QUANTITY = DecimalType(10, 0)
RATE = DecimalType(5, 4)
LINE_GROSS = DecimalType(23, 2)
LINE_NET = DecimalType(29, 6)
REPORT_MONEY = DecimalType(12, 2)


def _exact(value: Column, kind: DecimalType) -> Column:
    """The value as a decimal; an error when it has more decimals than ``kind``."""
    fits = value.isNull() | (F.round(value, kind.scale) == value)
    refused = F.raise_error(F.concat(F.lit("more decimals than allowed: "), value.cast("string")))
    return F.when(fits, value.cast(kind)).otherwise(refused.cast(kind))


def gross_amount(price: Column, quantity: Column, exact: bool = True) -> Column:
    """unit_price * quantity, exact to the cent (or the double product)."""
    if not exact:
        return price * quantity
    return (_exact(price, PRICE) * quantity.cast(QUANTITY)).cast(LINE_GROSS)


def net_amount(gross: Column, discount: Column, exact: bool = True) -> Column:
    """gross * (1 - discount), exact to 1e-6 (or the double product)."""
    if not exact:
        return gross * (F.lit(1.0) - discount)
    return (gross * (F.lit(1).cast(RATE) - _exact(discount, RATE))).cast(LINE_NET)


def wide_sum(amount: Column) -> Column:
    """The exact sum in the widest decimal; it fits the report or not (:func:`fits_report`)."""
    return F.sum(amount)


def report_money(total: Column) -> Column:
    """A sum as the report's DECIMAL(12,2) (HALF_UP); null where it doesn't fit."""
    return total.try_cast(REPORT_MONEY)


def fits_report(total: Column) -> Column:
    return total.isNull() | report_money(total).isNotNull()
