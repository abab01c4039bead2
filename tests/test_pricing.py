"""Price lookup against a brute-force search, on every route."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from costloom.operators import joins, pricing, reports
from samples import TODAY, catalog_of, price, spec, specs_of

REGIONS = ["us-east1", "us-west1", None]
TYPES = ["n1-standard-4", "n1-standard-8", "e2-medium", "c2-standard-8", "odd"]
DISKS = ["pd-ssd", "pd-standard", "pd-extreme"]
GPUS = ["tesla-t4", "tesla-p4"]
USAGE = {"spot": "Preemptible", "cud-1-year": "Committed", "on-demand": "OnDemand", "mystery": "OnDemand"}


def random_catalog(rng, size):
    rows = []
    for i in range(size):
        kind = rng.choice(["compute", "compute", "storage", "gpu", "network"])
        machine = rng.choice(TYPES + [None])
        rows.append(
            dict(
                sku_id=f"s{rng.randrange(size)}",
                category=kind,
                usage_type=rng.choice(["OnDemand", "Preemptible", "Committed"]),
                machine_type=machine if kind == "compute" else None,
                machine_family=machine.split("-")[0] if machine and kind == "compute" else None,
                disk_type=rng.choice(DISKS[:2]) if kind == "storage" else None,
                gpu_type=rng.choice(GPUS + [None]) if kind == "gpu" else None,
                region=rng.choice(REGIONS),
                price_per_unit=float(rng.randrange(0, 50)) / 8,
                effective_date=TODAY - timedelta(days=rng.randrange(3)),
                is_active=rng.random() < 0.8,
                service_name=rng.choice(["Compute Engine"] * 4 + ["Cloud Storage"]),
            )
        )
    return rows


def best(rows, matches, order):
    hits = [r for r in rows if r["is_active"] and r["service_name"] == "Compute Engine" and matches(r)]
    hits.sort(key=lambda r: (*order(r), -r["effective_date"].toordinal(), r["sku_id"], r["price_per_unit"]))
    return hits[0]["price_per_unit"] if hits else None


def expected(rows, s):
    here = lambda r: r["region"] in (s["region"], None)
    away = lambda r: 0 if r["region"] == s["region"] else 1
    family = s["machine_type"].split("-")[0]
    compute = best(
        rows,
        lambda r: r["category"] == "compute"
        and r["usage_type"] == USAGE[s["pricing_model"]]
        and here(r)
        and (r["machine_type"] == s["machine_type"] or r["machine_family"] == family),
        lambda r: (0 if r["machine_type"] == s["machine_type"] else 1, away(r)),
    )
    storage = best(
        rows,
        lambda r: r["category"] == "storage" and r["disk_type"] == s["disk_type"] and here(r),
        lambda r: (away(r),),
    )
    gpu = None
    if s["gpu_count"]:
        gpu = best(
            rows,
            lambda r: r["category"] == "gpu" and r["gpu_type"] is not None and r["gpu_type"] == s["gpu_type"] and here(r),
            lambda r: (away(r),),
        )
    return (
        compute if compute is not None else s["vcpu_count"] * 0.0475 + s["memory_gb"] * 0.0063,
        storage if storage is not None else {"pd-ssd": 0.17}.get(s["disk_type"], 0.04),
        gpu or 0.0,
    )


ROUTES = {
    "broadcast book": {},
    "broadcast sheet": "book only",
    "sliced": {"max_rows": 0},
}


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("seed,size", [(1, 0), (2, 15), (3, 120)])
def test_against_brute_force(spark, monkeypatch, route, seed, size):
    rng = random.Random(seed)
    rows = random_catalog(rng, size)
    resources = [
        dict(
            resource_id=f"r{i}",
            machine_type=rng.choice(TYPES),
            region=rng.choice(["us-east1", "us-west1", "mars"]),
            pricing_model=rng.choice(list(USAGE)),
            disk_type=rng.choice(DISKS),
            gpu_type=rng.choice(GPUS + [None]),
            gpu_count=rng.choice([None, 0, 1, 4]),
            vcpu_count=rng.randrange(1, 9),
            memory_gb=rng.randrange(1, 60) * 0.5,
        )
        for i in range(80)
    ]
    bounds = ROUTES[route]
    if bounds == "book only":
        # The book is taken as too large, the priced combinations as small enough.
        answers = iter([False, True, True, True])
        monkeypatch.setattr(joins.Size, "fits", lambda *a, **k: next(answers))
        bounds = {}
    specs = specs_of(spark, *[spec(**r) for r in resources])
    priced = pricing.price_all(specs, catalog_of(spark, *[price(**r) for r in rows]), **bounds)
    got = {
        row["resource_id"]: (row["compute_price_per_hour"], row["storage_price_per_gb_month"], row["gpu_price_per_hour"])
        for row in priced.collect()
    }
    assert len(got) == len(resources)
    for resource in resources:
        assert got[resource["resource_id"]] == pytest.approx(expected(rows, resource)), resource


def one(spark, catalog_rows, **changes):
    rows = pricing.price_all(specs_of(spark, spec(**changes)), catalog_of(spark, *catalog_rows)).collect()
    assert len(rows) == 1
    return rows[0]


def test_order_of_preference(spark):
    family = dict(machine_family="n1", machine_type="n1-highmem-2")
    exact = dict(machine_family="n1", machine_type="n1-standard-4")
    ladder = [
        price(sku_id="a", price_per_unit=4.0, **family),
        price(sku_id="b", price_per_unit=3.0, region="us-central1", **family),
        price(sku_id="c", price_per_unit=2.0, **exact),
        price(sku_id="d", price_per_unit=1.0, region="us-central1", **exact),
    ]
    for count, wanted in enumerate([4.0, 3.0, 2.0, 1.0], start=1):
        assert one(spark, ladder[:count])["compute_price_per_hour"] == wanted


def test_latest_date_then_smallest_sku_wins(spark):
    exact = dict(machine_family="n1", machine_type="n1-standard-4")
    rows = [
        price(sku_id="a", price_per_unit=1.0, effective_date=date(2024, 1, 1), **exact),
        price(sku_id="c", price_per_unit=2.0, effective_date=date(2024, 2, 1), **exact),
        price(sku_id="b", price_per_unit=3.0, effective_date=date(2024, 2, 1), **exact),
    ]
    assert one(spark, rows)["compute_price_per_hour"] == 3.0


def test_a_zero_price_is_a_hit(spark):
    rows = [price(machine_family="n1", machine_type="n1-standard-4", price_per_unit=0.0)]
    assert one(spark, rows)["compute_price_per_hour"] == 0.0


def test_inactive_rows_are_ignored(spark):
    rows = [price(machine_family="n1", machine_type="n1-standard-4", is_active=False)]
    assert one(spark, rows)["compute_price_per_hour"] == pytest.approx(4 * 0.0475 + 15 * 0.0063)


def test_gpu_needs_a_count(spark):
    rows = [price(category="gpu", gpu_type="tesla-t4", price_per_unit=0.5)]
    assert one(spark, rows, gpu_type="tesla-t4", gpu_count=2)["gpu_price_per_hour"] == 0.5
    assert one(spark, rows, gpu_type="tesla-t4", gpu_count=0)["gpu_price_per_hour"] == 0.0
    assert one(spark, rows, gpu_type="tesla-t4", gpu_count=None)["gpu_price_per_hour"] == 0.0


def test_size_check(spark):
    table = spark.range(10).selectExpr("id", "repeat('x', 100) as text", "array(repeat('y', 1000)) as list")
    size = joins.measure(table)
    assert size.rows == 10 and 11_000 < size.bytes < 13_000
    assert size.fits() and not size.fits(max_rows=9) and not size.fits(max_bytes=5000)
    assert joins.measure(table.limit(0)) == (0, 0)


def test_sliced_lookup_spreads_a_hot_key(spark):
    rows = spark.range(2000).selectExpr("'hot' as k", "id")
    table = spark.createDataFrame([("hot", 7), ("cold", 8)], "k string, v int")
    joined = joins.lookup(rows, table, ["k"], spread_by=["id"], hot_rows=400, max_rows=0)
    assert joined.where("v = 7").count() == 2000 and joined.columns == ["k", "id", "v"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 3 and max(parts) <= 1200
    missing = joins.lookup(rows, table.where("k = 'cold'"), ["k"], spread_by=["id"], hot_rows=400, max_rows=0)
    assert missing.where("v is null").count() == 2000


@pytest.mark.parametrize("hot_rows", [100, 1000])
def test_only_hot_keys_are_repeated(spark, hot_rows):
    """One hot key among many, and many more partitions than rows of it."""
    rows = spark.range(3000).selectExpr("if(id < 900, 'hot', cast(id as string)) as k", "id")
    table = spark.range(5000).selectExpr("if(id = 0, 'hot', cast(id as string)) as k", "id as v")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        joined = joins.lookup(rows, table, ["k"], spread_by=["id"], hot_rows=hot_rows, max_rows=0)
        text = joined._jdf.queryExecution().optimizedPlan().toString()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert joined.count() == 3000 and joined.where("k = 'hot' and v = 0").count() == 900
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ("_slice" in text) == (hot_rows < 900) and "2000" not in text


def test_anomalies_by_both_routes(spark):
    rows = [("p1", f"r{i}", 10.0) for i in range(30)] + [("p1", "big", 1000.0), ("p2", "alone", 5.0)]
    lines = spark.createDataFrame(rows, "project_id string, resource_id string, total_cost_usd double")
    for bounds in ({}, {"max_rows": 0}):
        assert [r["resource_id"] for r in reports.cost_anomalies(lines, 3.0, **bounds).collect()] == ["big"]
