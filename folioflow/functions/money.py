"""Amounts: exact decimal arithmetic and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def percent() -> Column:
    """One hundredth as a decimal, so that percentages stay exact."""
    return F.lit("0.01").cast("decimal(2,2)")


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def or_zero(amount: Column) -> Column:
    return F.coalesce(amount, zero())


def no_amount() -> Column:
    """Empty amount cell."""
    return F.lit(None).cast("decimal(28,2)")


def signed(amount: Column, negative: Column) -> Column:
    """Amount with its sign turned where ``negative`` holds."""
    return F.when(negative, -amount).otherwise(amount)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, NULL when whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def discount_value(price_unit: Column, quantity: Column, discount: Column) -> Column:
    """Value of a discount in percent, NULL without discount."""
    return F.when(discount > 0, price_unit * quantity * discount * percent())


def line_subtotal(price_unit: Column, quantity: Column, discount: Column) -> Column:
    return price_unit * quantity * (100 - discount) * percent()


def european_number(amount: Column) -> Column:
    """1234.5 -> ``1.234,50``."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def two_decimals(amount: Column) -> Column:
    """1234.5 -> ``1234.50``."""
    return amount.cast("decimal(38,2)").cast("string")


def thousands_text(amount: Column) -> Column:
    """1234.5 -> ``1,234.50``."""
    return F.format_number(amount, 2)
