"""Text forms of report values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_currency(value: Column) -> Column:
    """US dollars with thousands separators and two decimals; null shows as $0.00."""
    amount = F.round(F.coalesce(value.cast("double"), F.lit(0.0)), 2)
    sign = F.when(amount < 0, "-").otherwise("")
    return F.concat(sign, F.lit("$"), F.format_number(F.abs(amount), 2))


def as_fixed(value: Column, decimals: int = 2) -> Column:
    """A fixed number of decimals, ties away from zero; null shows as 0."""
    number = F.coalesce(value.cast("double"), F.lit(0.0))
    # Java rounds an exact tie to the even digit. Only a multiple of 2^-(decimals+1) can be an exact tie.
    is_tie = F.abs(number) * F.lit(2.0 ** (decimals + 1)) % 2 == 1
    nudged = number + F.signum(number) * F.when(is_tie, 10.0 ** -(decimals + 1)).otherwise(0.0)
    pattern = "0" if decimals == 0 else "0." + "0" * decimals
    return F.call_function("format_number", nudged, F.lit(pattern))


def as_short_date(value: Column) -> Column:
    return F.date_format(value, "M/d/yyyy")


def as_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})
