"""Cost rules: thresholds, nulls, and properties of random resources."""

import random

import pytest

from costloom.functions import display
from costloom.operators import costing, reports
from pyspark.sql import functions as F
from samples import NOW, catalog_of, price, spec, specs_of


def lines(spark, *specs, prices=()):
    return costing.boq_lines(specs_of(spark, *specs), catalog_of(spark, *prices), "b", NOW)


def test_sustained_steps(spark):
    hours = {183: 0, 184: 0, 255: 0, 256: 5, 328: 5, 329: 10, 620: 25, 621: 30, 730: 30, 731: 30, 5000: 30}
    rows = lines(spark, *[spec(resource_id=str(h), usage_duration_hours=h) for h in hours]).collect()
    assert {int(r["resource_id"]): r["sustained_use_discount_percent"] for r in rows} == hours


def test_sustained_needs_the_continuous_pattern_and_no_other_discount(spark):
    rows = lines(
        spark,
        spec(resource_id="null", usage_pattern=None),
        spec(resource_id="scheduled", usage_pattern="scheduled"),
        spec(resource_id="spot", pricing_model="spot"),
        spec(resource_id="1y", pricing_model="cud-1-year"),
        spec(resource_id="odd", pricing_model="reserved"),
    ).collect()
    got = {
        r["resource_id"]: (
            r["sustained_use_discount_percent"], r["committed_use_discount_percent"], r["spot_discount_percent"]
        )
        for r in rows
    }
    assert got == {
        "null": (0, 0, 0), "scheduled": (0, 0, 0), "spot": (0, 0, 60), "1y": (0, 25, 0), "odd": (30, 0, 0)
    }


def test_committed_price_is_discounted_again(spark):
    catalog = [price(usage_type="Committed", machine_family="n1", machine_type="n1-standard-4", price_per_unit=0.5)]
    row = lines(spark, spec(pricing_model="cud-3-year", usage_duration_hours=100), prices=catalog).first()
    assert row["compute_cost_usd"] == 50.0 and row["total_discount_usd"] == pytest.approx(18.5)


def test_gpu_cost_is_discounted_and_storage_is_not(spark):
    catalog = [price(category="gpu", gpu_type="tesla-t4", price_per_unit=0.25)]
    row = lines(
        spark, spec(gpu_type="tesla-t4", gpu_count=2, pricing_model="spot", usage_duration_hours=100), prices=catalog
    ).first()
    assert row["gpu_cost_usd"] == 50.0
    assert row["total_discount_usd"] == pytest.approx((row["compute_cost_usd"] + 50.0) * 0.6)


def test_unknown_disk_and_null_numbers(spark):
    rows = lines(
        spark,
        spec(resource_id="odd disk", disk_type="tape"),
        spec(resource_id="no hours", usage_duration_hours=None),
        spec(resource_id="no ip", external_ip=None),
    ).collect()
    by_id = {r["resource_id"]: r for r in rows}
    assert by_id["odd disk"]["storage_price_per_gb_month"] == 0.04
    assert by_id["no hours"]["total_cost_usd"] == 0.0
    assert by_id["no hours"]["sustained_use_discount_percent"] == 0.0
    assert by_id["no ip"]["network_cost_usd"] == 0.0


def test_extra_disks(spark):
    rows = lines(
        spark,
        spec(resource_id="none"),
        spec(resource_id="empty", additional_disks=[]),
        spec(resource_id="odd", additional_disks=[("tape", 10, None)], usage_duration_hours=365),
    ).collect()
    by_id = {r["resource_id"]: r["additional_storage_costs"] for r in rows}
    assert by_id["none"] == [] and by_id["empty"] == []
    assert [tuple(d) for d in by_id["odd"]] == [("tape", 10, pytest.approx(0.2), 0.04)]


def test_random_resources_keep_the_rules(spark):
    rng = random.Random(4)
    models = ["on-demand", "spot", "preemptible", "cud-1-year", "cud-3-year", "other"]
    specs = [
        spec(
            resource_id=str(i),
            project_id=f"p{rng.randrange(3)}",
            vcpu_count=rng.randrange(1, 97),
            memory_gb=rng.random() * 600,
            disk_size_gb=rng.randrange(0, 4000),
            usage_duration_hours=rng.randrange(0, 900),
            usage_pattern=rng.choice([None, "continuous", "scheduled"]),
            pricing_model=rng.choice(models),
            external_ip=rng.choice([None, True, False]),
        )
        for i in range(400)
    ]
    result = lines(spark, *specs).cache()
    total = 0
    for r in result.collect():
        base = r["compute_cost_usd"] + r["gpu_cost_usd"]
        assert 0 <= r["total_cost_usd"] <= r["subtotal_usd"]
        assert r["total_discount_usd"] <= base + 1e-9
        assert r["sustained_use_discount_percent"] in {0, 5, 10, 15, 20, 25, 30}
        assert r["total_cost_usd"] == pytest.approx(r["subtotal_usd"] - r["total_discount_usd"])
        total += round(r["total_cost_usd"] * 1e6)
    by_project = reports.cost_by(result, "project_id").agg(F.sum("total_cost_usd")).first()[0]
    assert by_project == pytest.approx(total / 1e6)
    assert reports.boq_summary(result).first()["total_cost_usd"] == total / 1e6


def test_sums_do_not_overflow(spark):
    lines = spark.range(4).selectExpr("9e12 as total_cost_usd", "0e0 as total_discount_usd", "id")
    assert reports.boq_summary(lines).first()["total_cost_usd"] == 3.6e13


def test_empty_input(spark):
    empty = reports.with_calc_date(lines(spark))
    assert reports.boq_summary(empty).collect() == []
    assert reports.cost_by(empty, "region").collect() == []
    row = reports.boq_summary_by_id(empty, "b").first()
    assert (row["total_resources"], row["total_cost"], row["projects_count"]) == (0, None, 0)
    stats = reports.dashboard(specs_of(spark), empty, NOW.date()).first()
    assert (stats["total_resources"], stats["total_boq_items"], stats["avg_cost"]) == (0, 0, None)


def test_history_window_and_order(spark):
    rows = [("b1", "2024-05-06"), ("b2", "2024-05-06"), ("b2", "2024-05-06"), ("b3", "2024-04-06"), ("b4", "2024-04-05")]
    data = spark.createDataFrame(rows, "boq_id string, d string").selectExpr(
        "boq_id", "cast(d as date) as calc_date", "1.5e0 as total_cost_usd"
    )
    got = [tuple(map(str, r)) for r in reports.cost_history(data, NOW.date()).collect()]
    assert got == [("2024-05-06", "2", "3", "4.5"), ("2024-04-06", "1", "1", "1.5")]


def test_display(spark):
    values = [(1234.5,), (-1.005,), (0.125,), (2.675,), (None,), (0.0,), (1e9,), (0.375,), (-0.125,)]
    frame = spark.createDataFrame(values, "v double")
    rows = frame.select(
        display.as_currency(F.col("v")), display.as_fixed(F.col("v")), display.as_fixed(F.col("v"), 0)
    ).collect()
    assert [r[0] for r in rows] == [
        "$1,234.50", "-$1.01", "$0.13", "$2.68", "$0.00", "$0.00", "$1,000,000,000.00", "$0.38", "-$0.13"
    ]
    assert [r[1] for r in rows] == [
        "1234.50", "-1.00", "0.13", "2.67", "0.00", "0.00", "1000000000.00", "0.38", "-0.13"
    ]
    assert [r[2] for r in rows][:3] == ["1235", "-1", "0"]
    shown = spark.sql("select timestamp '2024-05-06 07:08:09' as t, null as n, 1 as i").select(
        display.as_short_date(F.col("t")), display.as_json(F.struct("n", "i"))
    )
    assert tuple(shown.first()) == ("5/6/2024", '{"n":null,"i":1}')
