"""Declared schemas of the three tables and of the price feed, with column defaults and required columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, WHOLE, REAL, FLAG, DAY, TIME = (
    StringType(), LongType(), DoubleType(), BooleanType(), DateType(), TimestampType()
)


def record(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


SPECS = record(
    project_id=TEXT,
    resource_id=TEXT,
    instance_name=TEXT,
    machine_type=TEXT,
    vcpu_count=WHOLE,
    memory_gb=REAL,
    disk_type=TEXT,
    disk_size_gb=WHOLE,
    additional_disks=ArrayType(record(disk_type=TEXT, size_gb=WHOLE, description=TEXT)),
    region=TEXT,
    zone=TEXT,
    usage_duration_hours=WHOLE,
    usage_pattern=TEXT,
    pricing_model=TEXT,
    commitment_type=TEXT,
    gpu_type=TEXT,
    gpu_count=WHOLE,
    network_tier=TEXT,
    external_ip=FLAG,
    created_at=TIME,
    updated_at=TIME,
    created_by=TEXT,
    tags=ArrayType(TEXT),
    description=TEXT,
    cost_center=TEXT,
    environment=TEXT,
    team=TEXT,
)

CATALOG = record(
    sku_id=TEXT,
    sku_name=TEXT,
    service_name=TEXT,
    service_id=TEXT,
    resource_family=TEXT,
    resource_group=TEXT,
    usage_type=TEXT,
    region=TEXT,
    zone=TEXT,
    currency_code=TEXT,
    pricing_unit=TEXT,
    price_per_unit=REAL,
    tiered_rates=ArrayType(record(start_usage_amount=WHOLE, price_per_unit=REAL, currency_code=TEXT)),
    machine_family=TEXT,
    machine_type=TEXT,
    vcpu_count=WHOLE,
    memory_gb=REAL,
    disk_type=TEXT,
    gpu_type=TEXT,
    commitment_term=TEXT,
    commitment_type=TEXT,
    discount_percent=REAL,
    network_tier=TEXT,
    effective_date=DAY,
    last_updated=TIME,
    pricing_source=TEXT,
    is_active=FLAG,
    validation_status=TEXT,
    description=TEXT,
    category=TEXT,
    tags=ArrayType(TEXT),
)

RESULTS = record(
    boq_id=TEXT,
    calculation_timestamp=TIME,
    requested_by=TEXT,
    resource_id=TEXT,
    project_id=TEXT,
    instance_name=TEXT,
    machine_type=TEXT,
    vcpu_count=WHOLE,
    memory_gb=REAL,
    disk_type=TEXT,
    disk_size_gb=WHOLE,
    region=TEXT,
    pricing_model=TEXT,
    usage_duration_hours=WHOLE,
    usage_pattern=TEXT,
    compute_cost_usd=REAL,
    memory_cost_usd=REAL,
    storage_cost_usd=REAL,
    network_cost_usd=REAL,
    gpu_cost_usd=REAL,
    compute_price_per_hour=REAL,
    memory_price_per_gb_hour=REAL,
    storage_price_per_gb_month=REAL,
    sustained_use_discount_percent=REAL,
    committed_use_discount_percent=REAL,
    spot_discount_percent=REAL,
    subtotal_usd=REAL,
    total_discount_usd=REAL,
    total_cost_usd=REAL,
    additional_storage_costs=ArrayType(
        record(disk_type=TEXT, size_gb=WHOLE, cost_usd=REAL, price_per_gb_month=REAL)
    ),
    pricing_date=DAY,
    calculation_version=TEXT,
    notes=TEXT,
    cost_center=TEXT,
    environment=TEXT,
    team=TEXT,
)

# One price-feed record. 64-bit numbers arrive as text.
UNIT_PRICE = record(currencyCode=TEXT, units=TEXT, nanos=TEXT)
RATE = record(startUsageAmount=TEXT, unitPrice=UNIT_PRICE)
EXPRESSION = record(usageUnit=TEXT, tieredRates=ArrayType(RATE))
RAW_SKU = record(
    skuId=TEXT,
    description=TEXT,
    serviceRegions=ArrayType(TEXT),
    pricingInfo=ArrayType(record(pricingExpression=EXPRESSION)),
)

# One calculation request: four optional list filters and the requester.
REQUEST = record(
    boq_id=TEXT,
    project_ids=ArrayType(TEXT),
    resource_ids=ArrayType(TEXT),
    regions=ArrayType(TEXT),
    pricing_models=ArrayType(TEXT),
    requested_by=TEXT,
    requested_at=TIME,
)

REQUIRED = {
    "specs": [
        "project_id", "resource_id", "machine_type", "vcpu_count", "memory_gb", "disk_type", "disk_size_gb",
        "region", "usage_duration_hours", "pricing_model",
    ],
    "catalog": [
        "sku_id", "sku_name", "service_name", "service_id", "pricing_unit", "price_per_unit", "effective_date",
    ],
    "results": [
        "boq_id", "resource_id", "project_id", "machine_type", "vcpu_count", "memory_gb", "disk_type",
        "disk_size_gb", "region", "pricing_model", "usage_duration_hours", "compute_cost_usd",
        "memory_cost_usd", "storage_cost_usd", "subtotal_usd", "total_cost_usd",
    ],
}

# Date partition column (derived where the table stores a timestamp) and sort order inside a partition.
LAYOUT = {
    "specs": ("created_date", ["project_id", "region", "pricing_model"]),
    "catalog": ("effective_date", ["service_name", "resource_family", "region", "machine_type"]),
    "results": ("calc_date", ["project_id", "region", "pricing_model", "boq_id"]),
}

SCHEMAS = {"specs": SPECS, "catalog": CATALOG, "results": RESULTS}


def defaults(table: str, now: datetime) -> dict[str, Column]:
    """Values for columns an insert leaves out. They never replace an explicit null."""
    if table == "specs":
        return {
            "usage_pattern": F.lit("continuous"),
            "pricing_model": F.lit("on-demand"),
            "gpu_count": F.lit(0),
            "network_tier": F.lit("standard"),
            "external_ip": F.lit(False),
            "created_at": F.lit(now),
            "updated_at": F.lit(now),
        }
    if table == "catalog":
        return {
            "currency_code": F.lit("USD"),
            "discount_percent": F.lit(0.0),
            "last_updated": F.lit(now),
            "pricing_source": F.lit("cloud-billing-api"),
            "is_active": F.lit(True),
            "validation_status": F.lit("valid"),
        }
    if table == "results":
        return {
            "calculation_timestamp": F.lit(now),
            "network_cost_usd": F.lit(0.0),
            "gpu_cost_usd": F.lit(0.0),
            "sustained_use_discount_percent": F.lit(0.0),
            "committed_use_discount_percent": F.lit(0.0),
            "spot_discount_percent": F.lit(0.0),
            "total_discount_usd": F.lit(0.0),
            "calculation_version": F.lit("1.0"),
        }
    raise ValueError(f"unknown table {table!r}")
