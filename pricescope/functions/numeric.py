"""Rounding and price rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies without and with three minor digits; all others have two.
ZERO_DIGITS = ["BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF"]
THREE_DIGITS = ["BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND"]


def is_valid_price(price: Column) -> Column:
    """A finite number above zero; null counts as invalid."""
    return F.coalesce((price > 0) & ~F.isnan(price) & (price < float("inf")), F.lit(False))


def round_money(amount: Column, currency: Column) -> Column:
    """Half away from zero on the shortest decimal form, to the currency's minor digits."""
    code = F.upper(currency)
    return F.when(code.isin(ZERO_DIGITS), F.round(amount, 0)).when(code.isin(THREE_DIGITS), F.round(amount, 3)).otherwise(F.round(amount, 2)) + 0.0


def round_percent(value: Column) -> Column:
    return F.round(value, 2) + 0.0


def round_half_up(value: Column) -> Column:
    """To an integer, halves toward positive infinity."""
    return F.floor(value + 0.5)


def percent_over(value: Column, base: Column) -> Column:
    """How far ``value`` lies above ``base``, in rounded percent; null where that is undefined."""
    return round_percent(F.try_divide(value - base, base) * 100)


def gap_position(gap: Column, low: float = 5.0, high: float = 10.0) -> Column:
    """The band of a rounded gap: more than ``low`` percent off is slightly, more than ``high`` clearly off the market."""
    return (
        F.when(gap < -high, "UNDERPRICED")
        .when(gap < -low, "SLIGHTLY_UNDERPRICED")
        .when(gap <= low, "MARKET_ALIGNED")
        .when(gap <= high, "SLIGHTLY_OVERPRICED")
        .when(gap.isNotNull(), "OVERPRICED")
    )


def exact_mean(value: Column) -> Column:
    """The mean of decimal amounts, the same whatever the order in which partial sums meet."""
    return F.try_divide(F.sum(value.cast("decimal(28, 9)")).cast("double"), F.count(value))
