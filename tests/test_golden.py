"""Hand-computed results: the sample resources with an empty catalog, and sample price-feed descriptions."""

import pytest
from pyspark.sql import functions as F

from costloom import schemas
from costloom.operators import catalog as catalogs
from costloom.operators import costing, reports
from samples import GOLDEN, NOW, TODAY, catalog_of, feed_of, seed_specs, sku


@pytest.fixture(scope="module")
def golden_lines(spark):
    lines = costing.boq_lines(seed_specs(spark), catalog_of(spark), "b1", NOW, "me")
    return reports.with_calc_date(lines).cache()


def test_every_line(golden_lines):
    rows = {row["resource_id"]: row for row in golden_lines.collect()}
    assert rows.keys() == GOLDEN.keys()
    for name, (compute, storage, network, percents, subtotal, discount, total) in GOLDEN.items():
        row = rows[name]
        got = [row[c] for c in ("compute_cost_usd", "storage_cost_usd", "network_cost_usd")]
        assert got == pytest.approx([compute, storage, network], abs=1e-6), name
        assert (row["memory_cost_usd"], row["gpu_cost_usd"]) == (0, 0)
        assert percents == (
            row["sustained_use_discount_percent"],
            row["committed_use_discount_percent"],
            row["spot_discount_percent"],
        ), name
        got = [row["subtotal_usd"], row["total_discount_usd"], row["total_cost_usd"]]
        assert got == pytest.approx([subtotal, discount, total], abs=1e-6), name


def test_line_columns(golden_lines):
    assert golden_lines.drop("calc_date").columns == [c for c in schemas.RESULTS.names if c != "notes"]
    row = golden_lines.first()
    assert (row["boq_id"], row["requested_by"], row["calculation_version"]) == ("b1", "me", "1.0")
    assert row["pricing_date"] == TODAY and row["calc_date"] == TODAY


def test_extra_disks_are_reported_but_not_totalled(golden_lines):
    row = golden_lines.where("resource_id = 'db-storage-001'").first()
    disks = [(d["disk_type"], d["size_gb"], d["cost_usd"], d["price_per_gb_month"]) for d in row[29]]
    assert disks == [("pd-ssd", 1000, pytest.approx(170.0), 0.17), ("pd-standard", 500, pytest.approx(20.0), 0.04)]
    others = golden_lines.where("resource_id <> 'db-storage-001'").where(F.size("additional_storage_costs") > 0)
    assert others.isEmpty()


def test_summary(golden_lines):
    row = reports.boq_summary(golden_lines).first()
    assert row["total_resources"] == 21
    assert row["total_cost_usd"] == pytest.approx(2195.880720, abs=1e-4)
    assert row["total_discount_usd"] == pytest.approx(593.486390, abs=1e-4)
    assert row["average_cost_per_resource"] == pytest.approx(104.565749, abs=1e-4)
    by_region = {r["region"]: r["total_cost_usd"] for r in reports.cost_by(golden_lines, "region").collect()}
    assert by_region == pytest.approx(
        {
            "us-central1": 1737.916772,
            "us-east1": 278.705500,
            "us-west1": 20.038948,
            "europe-west1": 79.609750,
            "asia-southeast1": 79.609750,
        },
        abs=1e-4,
    )


def test_budgets(golden_lines):
    rows = {r["cost_center"]: r for r in reports.budget_check(golden_lines).collect()}
    assert rows["engineering"]["budget_threshold"] == 10000 and not rows["engineering"]["over_budget"]
    assert rows["sales"]["budget_threshold"] is None and not rows["sales"]["over_budget"]
    tight = {r["cost_center"]: r for r in reports.budget_check(golden_lines, {"sales": 100.0}).collect()}
    assert tight["sales"]["over_budget"]


# description: category, usage type, family, machine type, disk, gpu, vcpu, memory; None = not kept
DAILY = {
    "N1-Standard-4 Instance 4 vCPU 15 GB running in Americas": (
        "compute", "OnDemand", "n1", "n1-standard-4", None, None, 4, 15.0
    ),
    "N2D-highcpu-8 Preemptible VM 8vcpu 32.5gb": ("compute", "Preemptible", "n2d", "n2d-highcpu-8", None, None, 8, 32.5),
    "SSD Persistent Disk Capacity": ("storage", "OnDemand", None, None, "pd-ssd", None, None, None),
    "Balanced PD Storage Capacity Regional": ("storage", "OnDemand", None, None, "pd-balanced", None, None, None),
    "Storage PD Capacity standard": ("storage", "OnDemand", None, None, "pd-standard", None, None, None),
    "Nvidia Tesla V100 GPU running in Iowa": ("gpu", "OnDemand", None, None, None, "nvidia-tesla", None, None),
    "Tesla T4 GPU attached to Spot VM": ("gpu", "Preemptible", None, None, None, "tesla-t4", None, None),
    "Commitment v1: N1-highmem-2 Cpu for 1 Year": ("compute", "Committed", "n1", "n1-highmem-2", None, None, None, None),
    "E2-medium Instance Core 3-year commitment": ("compute", "Committed", "e2", "e2-medium", None, None, None, None),
    "External IP Address standard network": ("network", "OnDemand", None, None, None, None, None, None),
    "Network premium egress global": ("network", "OnDemand", None, None, None, None, None, None),
    "C2-standard-8 Instance 8 vCPU": ("compute", "OnDemand", "c2", "c2-standard-8", None, None, 8, None),
    "F1-micro Instance": ("compute", "OnDemand", "f1", "f1-micro", None, None, None, None),
    "License fee for VM image": None,
    "Cloud Rapid Storage": None,
    "Consulting hours": None,
}


def classified(spark, descriptions, profile="daily", **options):
    feed = feed_of(spark, *[sku(text, text) for text in descriptions])
    rows = catalogs.build_catalog(feed, TODAY, NOW, profile, **options).collect()
    return {row["description"]: row for row in rows}


def test_daily_classification(spark):
    rows = classified(spark, DAILY)
    assert set(rows) == {text for text, kept in DAILY.items() if kept}
    for text, row in rows.items():
        got = tuple(
            row[c]
            for c in (
                "category", "usage_type", "machine_family", "machine_type", "disk_type", "gpu_type", "vcpu_count",
                "memory_gb",
            )
        )
        assert got == DAILY[text], text


def test_daily_details(spark):
    rows = classified(spark, [*DAILY, "Tesla GPU standard regional network premium vm n1-a 3 year global"])
    one = rows["Commitment v1: N1-highmem-2 Cpu for 1 Year"]
    assert (one["commitment_term"], one["commitment_type"], one["discount_percent"]) == ("1-year", "resource", 25.0)
    assert one["resource_group"] == "N1Standard" and one["resource_family"] == "Compute"
    three = rows["E2-medium Instance Core 3-year commitment"]
    assert (three["commitment_term"], three["discount_percent"]) == ("3-year", 37.0)
    plain = rows["SSD Persistent Disk Capacity"]
    assert (plain["resource_group"], plain["discount_percent"], plain["commitment_type"]) == ("Standard", 0.0, None)
    assert plain["tags"] == ["storage:ssd"]
    assert rows["F1-micro Instance"]["tags"] == ["family:f1"]
    assert rows["Network premium egress global"]["tags"] == ["network:premium", "scope:global"]
    busy = rows["Tesla GPU standard regional network premium vm n1-a 3 year global"]
    assert busy["tags"] == [
        "family:n1", "gpu:tesla-gpu", "commitment:3-year", "network:premium", "scope:regional"
    ]
    assert rows["Storage PD Capacity standard"]["tags"] == ["storage:standard"]
    no_tags = classified(spark, ["plain vm"])["plain vm"]
    assert no_tags["tags"] == []


def test_adhoc_classification(spark):
    rows = classified(spark, DAILY, "adhoc")
    kept = [text for text in DAILY if any(word in text.lower() for word in ("instance", "disk", "gpu"))]
    assert set(rows) == set(kept) and len(kept) == 7
    first = rows["N1-Standard-4 Instance 4 vCPU 15 GB running in Americas"]
    assert (first["category"], first["disk_type"]) == ("storage", "pd-standard")
    assert "tags" not in first and len(first) == 24


def test_adhoc_knows_fewer_families(spark):
    text = "t2d-standard-1 instance"
    assert classified(spark, [text])[text]["machine_family"] == "t2d"
    assert classified(spark, [text], "adhoc")[text]["machine_family"] is None


def test_daily_row_width(spark):
    feed = feed_of(spark, sku())
    assert catalogs.build_catalog(feed, TODAY, NOW).columns == [c for c in schemas.CATALOG.names if c != "zone"]
