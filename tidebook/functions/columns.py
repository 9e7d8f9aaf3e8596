"""Column expressions: validity, flags, parsing and rendering. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() has it.
_STRIP = "(?U)^\\s+|\\s+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def symbol_valid(c: Column) -> Column:
    """Letters only, one at least; null is invalid."""
    return F.coalesce(c.rlike("^\\p{L}+$"), F.lit(False))


#: Fixed value: the addresses that count as valid.
_EMAIL = "(?U)^[\\w.+-]+@([\\w-]+\\.)+[a-zA-Z]{2,}$"


def email_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(_EMAIL), F.lit(False))


def user_valid(email: Column, username: Column) -> Column:
    """The laxer rule of a stored user: an @ somewhere, and a username of three characters or more."""
    return F.coalesce(F.contains(email, F.lit("@")) & (F.length(username) >= 3), F.lit(False))


def asset_valid(symbol: Column, price: Column) -> Column:
    """A symbol that is not empty and a price that is not negative."""
    return F.coalesce((symbol != "") & (price >= 0), F.lit(False))


def zero_to_null(c: Column) -> Column:
    return F.when(c != 0, c)


def is_bullish(change: Column) -> Column:
    """Above 0; null and 0 are not."""
    return F.coalesce(change > 0, F.lit(False))


def is_up(change: Column) -> Column:
    """The sign shown on a screen: null counts as 0, and 0 as up. Not the same rule as is_bullish."""
    return F.coalesce(change, F.lit(0)) >= 0


def number_or_zero(c: Column) -> Column:
    """The number that a string begins with; 0 where there is none."""
    head = F.regexp_extract(c, "^\\s*([+-]?(?:Infinity|(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?))", 1)
    return F.coalesce(F.when(head != "", head).try_cast("double"), F.lit(0.0))


def billions(c: Column, places: int = 2, zero_dash: bool = False) -> Column:
    """$1.23B; a dash for null, and for 0 where that is asked for."""
    shown = F.when(c.isNotNull() & ((c != 0) if zero_dash else F.lit(True)), F.format_string(f"$%.{places}fB", c.cast("double") / F.lit(1e9)))
    return F.coalesce(shown, F.lit("-"))


def money(c: Column, places: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, places))


def signed_percent(c: Column, places: int = 2) -> Column:
    value = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.concat(F.when(value >= 0, F.lit("+")).otherwise(F.lit("-")), F.format_number(F.abs(value), places), F.lit("%"))


def badge(symbol: Column) -> Column:
    return F.substring(symbol, 1, 2)


def avg_buy_price(purchase: Column, quantity: Column) -> Column:
    """Null if nothing is held."""
    return F.try_divide(purchase, quantity)


def unrealized_pnl(current: Column, purchase: Column) -> Column:
    return current - purchase


def unrealized_pnl_pct(current: Column, purchase: Column) -> Column:
    """Null without a current value or without a cost."""
    return F.try_divide(current - purchase, purchase) * 100
