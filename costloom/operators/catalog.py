"""From price-feed records to catalog rows."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from costloom import constants as K
from costloom.functions import literal, sku

ADHOC_LEAVES_OUT = ["tiered_rates", "commitment_type", "discount_percent", "network_tier", "pricing_source", "tags"]


def select_skus(feed: DataFrame, profile: str = "daily", region: str | None = None) -> DataFrame:
    """Records the profile reads at all. A region may be anywhere in a record's list of regions."""
    if profile == "daily":
        return feed.where(sku.is_relevant(F.col("description")))
    picked = feed.where(sku.is_fetched_adhoc(F.col("description")))
    return picked.where(F.array_contains("serviceRegions", region)) if region else picked


def price_skus(feed: DataFrame, profile: str = "daily") -> DataFrame:
    """Add the first tier's price; drop records without tiers or with an unreadable price.

    The daily profile also drops a record whose first tier is free, even if later tiers cost.
    """
    expression = F.get("pricingInfo", F.lit(0))["pricingExpression"]
    priced = feed.withColumns(
        {
            "pricing_unit": expression["usageUnit"],
            "rates": expression["tieredRates"],
            "first_price": F.get(expression["tieredRates"], F.lit(0))["unitPrice"],
        }
    ).withColumn("price_per_unit", F.when(F.col("first_price").isNotNull(), sku.unit_price(F.col("first_price"))))
    if profile == "daily":
        complete = F.forall("rates", lambda rate: rate["unitPrice"].isNotNull())
        return priced.where((F.col("price_per_unit") != 0) & complete)
    return priced.where(F.col("price_per_unit").isNotNull())


def classify(priced: DataFrame, profile: str, as_of: date | Column, now: datetime | Column) -> DataFrame:
    # Staged, so that the lower-cased text and each detected part are computed once per row.
    staged = priced.withColumn("text", F.lower("description"))
    text = F.col("text")
    staged = staged.withColumns(
        {
            "family_match": sku.machine_family(text, profile),
            "type_match": sku.machine_type(text, profile),
            "gpu_match": sku.gpu_type(text),
            "disk": sku.disk_type(text, profile),
            "term": sku.commitment_term(text),
            "tier": sku.network_tier(text) if profile == "daily" else F.lit(None).cast("string"),
        }
    ).withColumns({"family": sku.or_null(F.col("family_match")), "gpu": F.nullif("gpu_match", F.lit("-"))})
    family, disk, gpu, term, tier = (F.col(name) for name in ("family", "disk", "gpu", "term", "tier"))
    columns: dict[str, Column] = {
        "sku_id": F.col("skuId"),
        "sku_name": F.col("description"),
        "service_name": F.lit(K.COMPUTE_SERVICE_NAME),
        "service_id": F.lit(K.COMPUTE_SERVICE_ID),
        "resource_family": F.lit("Compute"),
        "resource_group": F.coalesce(F.concat(F.upper(family), F.lit("Standard")), F.lit("Standard")),
        "usage_type": sku.usage_type(text, term),
        "region": F.get("serviceRegions", F.lit(0)),
        "currency_code": sku.currency(F.col("first_price")),
        "pricing_unit": F.col("pricing_unit"),
        "price_per_unit": F.col("price_per_unit"),
        "tiered_rates": sku.tiered_rates(F.col("rates")),
        "machine_family": family,
        "machine_type": sku.or_null(F.col("type_match")),
        "vcpu_count": sku.vcpu_count(text),
        "memory_gb": sku.memory_gb(text),
        "disk_type": disk,
        "gpu_type": gpu,
        "commitment_term": term,
        "commitment_type": F.when(term.isNotNull(), "resource"),
        "discount_percent": sku.commitment_discount(term),
        "network_tier": tier,
        "effective_date": literal(as_of),
        "last_updated": literal(now),
        "pricing_source": F.lit(K.PRICING_SOURCE),
        "is_active": F.lit(True),
        "validation_status": F.lit("valid"),
        "description": F.col("description"),
        "category": sku.category(text, disk, tier if profile == "daily" else None),
        "tags": sku.tags(text, family, disk, gpu, term, tier),
    }
    left_out = ADHOC_LEAVES_OUT if profile == "adhoc" else []
    return staged.select([value.alias(name) for name, value in columns.items() if name not in left_out])


def build_catalog(
    feed: DataFrame,
    as_of: date | Column,
    now: datetime | Column,
    profile: str = "daily",
    region: str | None = None,
) -> DataFrame:
    """Catalog rows of one feed: a narrow, native-column job with no shuffle."""
    if profile not in sku.PROFILES:
        raise ValueError(f"profile must be one of {sku.PROFILES}, not {profile!r}")
    if region and profile == "daily":
        raise ValueError("only the adhoc profile takes a region")
    return classify(price_skus(select_skus(feed, profile, region), profile), profile, as_of, now)
