"""Hand-made rows with results worked out by hand from the pricing rules."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import SparkSession

from costloom import schemas
from costloom.operators import quality

NOW = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
TODAY = date(2024, 5, 6)

FIELDS = [
    "resource_id", "machine_type", "vcpu_count", "memory_gb", "disk_type", "disk_size_gb", "region",
    "usage_duration_hours", "usage_pattern", "pricing_model", "gpu_type", "gpu_count", "external_ip", "cost_center",
]
FULL = [
    ("prod-web-001", "n1-standard-2", 2, 7.5, "pd-standard", 100, "us-central1", 730, "continuous", "on-demand", None, 0, True, "engineering"),
    ("prod-web-002", "n1-standard-2", 2, 7.5, "pd-standard", 100, "us-central1", 730, "continuous", "on-demand", None, 0, True, "engineering"),
    ("prod-db-001", "n1-highmem-4", 4, 26.0, "pd-ssd", 500, "us-central1", 730, "continuous", "cud-1-year", None, 0, False, "engineering"),
    ("prod-db-002", "n1-highmem-4", 4, 26.0, "pd-ssd", 500, "us-east1", 730, "continuous", "cud-1-year", None, 0, False, "engineering"),
    ("dev-web-001", "e2-medium", 1, 4.0, "pd-standard", 50, "us-central1", 200, "intermittent", "on-demand", None, 0, True, "engineering"),
    ("test-api-001", "n1-standard-1", 1, 3.75, "pd-standard", 30, "us-central1", 100, "scheduled", "on-demand", None, 0, False, "engineering"),
    ("batch-001", "n1-standard-4", 4, 15.0, "pd-standard", 100, "us-central1", 168, "intermittent", "spot", None, 0, False, "data-analytics"),
    ("batch-002", "n1-standard-4", 4, 15.0, "pd-standard", 100, "us-west1", 168, "intermittent", "spot", None, 0, False, "data-analytics"),
    ("ml-train-001", "n1-standard-8", 8, 30.0, "pd-ssd", 200, "us-central1", 100, "scheduled", "on-demand", "nvidia-tesla-v100", 1, False, "research"),
    ("ml-infer-001", "n1-standard-2", 2, 7.5, "pd-ssd", 50, "us-central1", 730, "continuous", "on-demand", "nvidia-tesla-t4", 1, True, "research"),
    ("cache-001", "n1-highmem-2", 2, 13.0, "pd-ssd", 100, "us-central1", 730, "continuous", "cud-3-year", None, 0, False, "platform"),
    ("cpu-001", "c2-standard-8", 8, 32.0, "pd-balanced", 200, "us-central1", 400, "scheduled", "on-demand", None, 0, False, "research"),
    ("region-eu-001", "n1-standard-2", 2, 7.5, "pd-standard", 100, "europe-west1", 730, "continuous", "on-demand", None, 0, True, "global-ops"),
    ("region-asia-001", "n1-standard-2", 2, 7.5, "pd-standard", 100, "asia-southeast1", 730, "continuous", "on-demand", None, 0, True, "global-ops"),
    ("dev-micro-001", "f1-micro", 1, 0.6, "pd-standard", 20, "us-central1", 100, "intermittent", "on-demand", None, 0, False, "engineering"),
    ("staging-001", "n1-standard-1", 1, 3.75, "pd-standard", 50, "us-central1", 200, "scheduled", "on-demand", None, 0, True, "engineering"),
    ("db-storage-001", "n1-highmem-8", 8, 52.0, "pd-ssd", 100, "us-central1", 730, "continuous", "cud-1-year", None, None, None, "engineering"),
]
# These rows leave the usage pattern out, so it takes its default.
SHORT_FIELDS = [name for name in FIELDS if name not in ("usage_pattern", "gpu_type", "gpu_count", "external_ip")]
SHORT = [
    ("marketing-001", "n1-standard-2", 2, 7.5, "pd-standard", 100, "us-central1", 500, "on-demand", "marketing"),
    ("sales-crm-001", "n1-standard-4", 4, 15.0, "pd-ssd", 200, "us-central1", 730, "cud-1-year", "sales"),
    ("hr-001", "e2-medium", 1, 4.0, "pd-standard", 50, "us-central1", 300, "on-demand", "human-resources"),
    ("finance-001", "n1-highmem-2", 2, 13.0, "pd-ssd", 100, "us-central1", 400, "on-demand", "finance"),
]

# resource: compute, storage, network, (sustained, committed, spot) percent, subtotal, discount, total
GOLDEN = {
    "prod-web-001": (103.8425, 4.0, 2.92, (30, 0, 0), 110.7625, 31.15275, 79.60975),
    "prod-web-002": (103.8425, 4.0, 2.92, (30, 0, 0), 110.7625, 31.15275, 79.60975),
    "prod-db-001": (258.274, 85.0, 0, (0, 25, 0), 343.274, 64.5685, 278.7055),
    "prod-db-002": (258.274, 85.0, 0, (0, 25, 0), 343.274, 64.5685, 278.7055),
    "dev-web-001": (14.54, 0.547945, 0.8, (0, 0, 0), 15.887945, 0, 15.887945),
    "test-api-001": (7.1125, 0.164384, 0, (0, 0, 0), 7.276884, 0, 7.276884),
    "batch-001": (47.796, 0.920548, 0, (0, 0, 60), 48.716548, 28.6776, 20.038948),
    "batch-002": (47.796, 0.920548, 0, (0, 0, 60), 48.716548, 28.6776, 20.038948),
    "ml-train-001": (56.9, 4.657534, 0, (0, 0, 0), 61.557534, 0, 61.557534),
    "ml-infer-001": (103.8425, 8.5, 2.92, (30, 0, 0), 115.2625, 31.15275, 84.10975),
    "cache-001": (129.137, 17.0, 0, (0, 37, 0), 146.137, 47.78069, 98.35631),
    "cpu-001": (232.64, 10.958904, 0, (0, 0, 0), 243.598904, 0, 243.598904),
    "region-eu-001": (103.8425, 4.0, 2.92, (30, 0, 0), 110.7625, 31.15275, 79.60975),
    "region-asia-001": (103.8425, 4.0, 2.92, (30, 0, 0), 110.7625, 31.15275, 79.60975),
    "dev-micro-001": (5.128, 0.109589, 0, (0, 0, 0), 5.237589, 0, 5.237589),
    "staging-001": (14.225, 0.547945, 0.8, (0, 0, 0), 15.572945, 0, 15.572945),
    "db-storage-001": (516.548, 17.0, 0, (0, 25, 0), 533.548, 129.137, 404.411),
    "marketing-001": (71.125, 2.739726, 0, (20, 0, 0), 73.864726, 14.225, 59.639726),
    "sales-crm-001": (207.685, 34.0, 0, (0, 25, 0), 241.685, 51.92125, 189.76375),
    "hr-001": (21.81, 0.821918, 0, (5, 0, 0), 22.631918, 1.0905, 21.541418),
    "finance-001": (70.76, 9.315068, 0, (10, 0, 0), 80.075068, 7.076, 72.999068),
}


def schema(names):
    return schemas.record(**{name: schemas.SPECS[name].dataType for name in names})


def seed_specs(spark: SparkSession):
    full_fields = ["project_id", *FIELDS, "additional_disks"]
    disks = [("pd-ssd", 1000, "Database data volume"), ("pd-standard", 500, "Database backup volume")]
    full = spark.createDataFrame(
        [("p1", *row, disks if row[0] == "db-storage-001" else None) for row in FULL], schema(full_fields)
    )
    short = spark.createDataFrame([("p1", *row) for row in SHORT], schema(["project_id", *SHORT_FIELDS]))
    return quality.apply_defaults(full, "specs", NOW).unionByName(quality.apply_defaults(short, "specs", NOW))


def spec(**changes):
    """One resource row; anything not given is an ordinary small machine."""
    row = dict.fromkeys(schemas.SPECS.names)
    row.update(
        project_id="p1", resource_id="r1", machine_type="n1-standard-4", vcpu_count=4, memory_gb=15.0,
        disk_type="pd-ssd", disk_size_gb=100, region="us-central1", usage_duration_hours=730,
        usage_pattern="continuous", pricing_model="on-demand", gpu_count=0, external_ip=False, created_at=NOW,
    )
    row.update(changes)
    return tuple(row[name] for name in schemas.SPECS.names)


def specs_of(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.SPECS)


def price(**changes):
    """One active on-demand catalog row."""
    row = dict.fromkeys(schemas.CATALOG.names)
    row.update(
        sku_id="s1", sku_name="n", service_name="Compute Engine", service_id="6F81-5844-456A", usage_type="OnDemand",
        currency_code="USD", pricing_unit="h", price_per_unit=1.0, discount_percent=0.0, effective_date=TODAY,
        last_updated=NOW, pricing_source="cloud-billing-api", is_active=True, validation_status="valid",
        category="compute",
    )
    row.update(changes)
    return tuple(row[name] for name in schemas.CATALOG.names)


def catalog_of(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.CATALOG)


def sku(sku_id="s", description="N1-standard-1 instance", nanos="500000000", units="1", regions=(), tiers=None, **rate):
    """One feed record."""
    if tiers is None:
        tiers = [("0", {"currencyCode": rate.get("currency"), "units": units, "nanos": nanos})]
    info = [((("h"), [(start, unit) for start, unit in tiers]),)]
    return (sku_id, description, None if regions is None else list(regions), info)


def feed_of(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RAW_SKU)
