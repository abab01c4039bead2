"""Cost lines: base costs, discounts, totals and extra disks of priced resources.

Every expression keeps a fixed order of operations, so a line costs the same to the last bit on any plan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from costloom import constants as K, schemas
from costloom.functions import cases, literal, rates, utc_day
from costloom.operators.pricing import price_all

SPEC_FIELDS = [
    "resource_id", "project_id", "instance_name", "machine_type", "vcpu_count", "memory_gb", "disk_type",
    "disk_size_gb", "region", "pricing_model", "usage_duration_hours", "usage_pattern", "cost_center",
    "environment", "team",
]
LINE_FIELDS = [name for name in schemas.RESULTS.names if name != "notes"]


def _hours() -> Column:
    return rates.zero(F.col("usage_duration_hours"))


def add_base_costs(priced: DataFrame) -> DataFrame:
    """Compute, storage, GPU and network cost. Memory is part of the compute price and stays 0."""
    hours = _hours()
    gpu = F.col("gpu_price_per_hour") * F.col("gpu_count") * hours
    return priced.withColumns(
        {
            "compute_cost_usd": F.col("compute_price_per_hour") * hours,
            "memory_cost_usd": F.lit(0.0),
            "storage_cost_usd": F.col("storage_price_per_gb_month")
            * rates.zero(F.col("disk_size_gb"))
            * (hours / F.lit(K.HOURS_PER_MONTH)),
            "gpu_cost_usd": F.when(F.col("gpu_count") > 0, gpu).otherwise(0.0),
            "network_cost_usd": F.when(F.col("external_ip"), F.lit(K.EXTERNAL_IP_HOUR_RATE) * hours).otherwise(0.0),
        }
    )


def add_discounts(costed: DataFrame) -> DataFrame:
    """At most one of the three discounts applies to a line; each is on compute plus GPU cost only."""
    model = F.col("pricing_model")
    is_spot = model.isin(K.SPOT_MODELS)
    committed = cases(((model == name, float(percent)) for name, percent in K.COMMITTED_DISCOUNTS.items()), 0.0)
    steps = F.floor((F.col("usage_duration_hours") - K.SUSTAINED_AFTER_HOURS) / F.lit(K.SUSTAINED_STEP_HOURS))
    sustained = F.least(F.lit(K.SUSTAINED_MAX_DISCOUNT), steps * K.SUSTAINED_STEP_DISCOUNT).cast("double")
    earns_sustained = (
        ~is_spot
        & ~model.isin(list(K.COMMITTED_DISCOUNTS))
        & (F.col("usage_duration_hours") > K.SUSTAINED_AFTER_HOURS)
        & (F.col("usage_pattern") == K.SUSTAINED_PATTERN)
    )
    percents = {
        "sustained_use_discount_percent": F.when(earns_sustained, sustained).otherwise(0.0),
        "committed_use_discount_percent": committed,
        "spot_discount_percent": F.when(is_spot, float(K.SPOT_DISCOUNT)).otherwise(0.0),
    }
    base = F.col("compute_cost_usd") + F.col("gpu_cost_usd")
    amounts = {name.replace("_percent", "_usd"): base * (F.col(name) / F.lit(100)) for name in percents}
    return costed.withColumns(percents).withColumns(amounts)


def add_totals(discounted: DataFrame) -> DataFrame:
    col = F.col
    subtotal = (
        col("compute_cost_usd")
        + col("memory_cost_usd")
        + col("storage_cost_usd")
        + col("network_cost_usd")
        + col("gpu_cost_usd")
    )
    discount = (
        col("sustained_use_discount_usd") + col("committed_use_discount_usd") + col("spot_discount_usd")
    )
    return discounted.withColumns({"subtotal_usd": subtotal, "total_discount_usd": discount}).withColumn(
        "total_cost_usd", F.greatest(F.lit(0.0), col("subtotal_usd") - col("total_discount_usd"))
    )


def extra_disk_costs(disks: Column, hours: Column) -> Column:
    """Costs of additional disks at the default rates. They are reported but not part of the total."""
    months = rates.zero(hours) / F.lit(K.HOURS_PER_MONTH)

    def cost(disk: Column) -> Column:
        rate = rates.default_disk_rate(disk["disk_type"])
        return F.struct(
            disk["disk_type"].alias("disk_type"),
            disk["size_gb"].alias("size_gb"),
            (rate * rates.zero(disk["size_gb"]) * months).alias("cost_usd"),
            rate.alias("price_per_gb_month"),
        )

    return F.coalesce(F.transform(disks, cost), F.array().cast(schemas.RESULTS["additional_storage_costs"].dataType))


def cost_lines(
    priced: DataFrame,
    boq_id: str | Column,
    calculated_at: datetime | Column,
    requested_by: str | Column | None = None,
) -> DataFrame:
    """The result line of each priced resource."""
    disks = F.col("additional_disks") if "additional_disks" in priced.columns else F.lit(None).cast(
        schemas.SPECS["additional_disks"].dataType
    )
    costed = add_totals(add_discounts(add_base_costs(priced)))
    stamped = costed.withColumns(
        {
            "boq_id": literal(boq_id),
            "calculation_timestamp": literal(calculated_at).cast("timestamp"),
            "requested_by": literal(requested_by).cast("string"),
            "additional_storage_costs": extra_disk_costs(disks, F.col("usage_duration_hours")),
            "pricing_date": utc_day(literal(calculated_at).cast("timestamp")),
            "calculation_version": F.lit(K.CALCULATION_VERSION),
        }
        | {name: F.lit(None).cast("string") for name in SPEC_FIELDS if name not in costed.columns}
    )
    return stamped.select(LINE_FIELDS)


def boq_lines(
    specs: DataFrame,
    catalog: DataFrame,
    boq_id: str | Column,
    calculated_at: datetime | Column,
    requested_by: str | Column | None = None,
    **bounds: int,
) -> DataFrame:
    return cost_lines(price_all(specs, catalog, **bounds), boq_id, calculated_at, requested_by)

