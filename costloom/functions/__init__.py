"""Column expressions. Everything here runs inside the JVM; there are no Python UDFs."""

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def literal(value: object) -> Column:
    """A parameter that may be a constant or a column."""
    return value if isinstance(value, Column) else F.lit(value)


def cases(pairs: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    chain = F
    for condition, value in pairs:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def utc_day(moment: Column) -> Column:
    """The UTC date of a timestamp, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(moment) / F.lit(86_400_000_000)).cast("int"))
