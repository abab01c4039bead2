"""Changes to whole tables: deactivation, retention, refresh, back-dating. All are narrow, without a shuffle."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from costloom import constants as K
from costloom.functions import cases


def deactivate(catalog: DataFrame, as_of: date, now: datetime) -> DataFrame:
    """Retire active rows from before ``as_of``. Rows of the same day stay active."""
    retired = F.coalesce(F.col("is_active") & (F.col("effective_date") < F.lit(as_of)), F.lit(False))
    return catalog.withColumns(
        {
            "is_active": F.when(retired, False).otherwise(F.col("is_active")),
            "last_updated": F.when(retired, F.lit(now)).otherwise(F.col("last_updated")),
        }
    )


def changing(catalog: DataFrame, as_of: date, keep_days: int = K.CATALOG_KEEP_DAYS) -> DataFrame:
    """The rows that a refresh of that day retires or removes."""
    expired = (F.col("effective_date") < F.date_sub(F.lit(as_of), keep_days)) & ~F.col("is_active")
    retired = F.col("is_active") & (F.col("effective_date") < F.lit(as_of))
    return catalog.where(F.coalesce(retired | expired, F.lit(False)))


def drop_expired(catalog: DataFrame, as_of: date, keep_days: int = K.CATALOG_KEEP_DAYS) -> DataFrame:
    """Remove inactive rows older than ``keep_days``."""
    old = F.col("effective_date") < F.date_sub(F.lit(as_of), keep_days)
    return catalog.where(~F.coalesce(old & ~F.col("is_active"), F.lit(False)))


def refresh(catalog: DataFrame, fetched: DataFrame, as_of: date, now: datetime) -> DataFrame:
    """Retire, append, then expire, as one plan. Appending keeps duplicates."""
    merged = deactivate(catalog, as_of, now).unionByName(fetched, allowMissingColumns=True)
    return drop_expired(merged, as_of)


def backdate(specs: DataFrame, now: datetime, days: dict[str, int] | None = None) -> DataFrame:
    """Spread ``created_at`` over the days before ``now``, by a hash of the id instead of a random number."""
    hashed = F.conv(F.substring(F.md5("resource_id"), 1, 8), 16, 10).cast("bigint")

    def moved(most: int) -> Column:
        return F.timestamp_add("DAY", -(hashed % (most + 1)).cast("int"), F.lit(now))

    rules = [(F.col("resource_id").endswith(end), moved(most)) for end, most in (days or K.BACKDATE_DAYS).items()]
    return specs.withColumn("created_at", cases(rules, F.col("created_at")))
