"""Defaults, required columns, maintenance, snapshots and jobs."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from costloom import schemas
from costloom.operators import catalog as catalogs
from costloom.operators import maintenance, quality, reports
from costloom.plans import jobs
from costloom.sources import tables
from samples import NOW, TODAY, catalog_of, feed_of, price, seed_specs, sku, spec, specs_of

LATER = datetime(2024, 5, 7, 2, tzinfo=timezone.utc)


def test_defaults_fill_absent_columns_only(spark):
    given = spark.createDataFrame([("p", None, 5)], "project_id string, external_ip boolean, extra int")
    row = quality.apply_defaults(given, "specs", NOW).first()
    assert (row["usage_pattern"], row["pricing_model"], row["gpu_count"], row["network_tier"]) == (
        "continuous", "on-demand", 0, "standard"
    )
    assert row["external_ip"] is None and row["zone"] is None and row["extra"] == 5
    assert row["created_at"] == row["updated_at"] is not None
    for table in schemas.SCHEMAS:
        filled = quality.apply_defaults(spark.range(1).drop("id"), table, NOW)
        assert filled.schema.names == schemas.SCHEMAS[table].names


def test_rejects_name_the_missing_columns(spark):
    specs = specs_of(spark, spec(resource_id="ok"), spec(resource_id="bad", machine_type=None, region=None))
    valid, rejects = quality.split_valid(specs, "specs")
    assert [r["resource_id"] for r in valid.collect()] == ["ok"]
    assert [(r["resource_id"], r["missing_columns"]) for r in rejects.collect()] == [("bad", ["machine_type", "region"])]


def stock(spark):
    day = lambda n: TODAY - timedelta(days=n)
    return catalog_of(
        spark,
        price(sku_id="today"),
        price(sku_id="yesterday", effective_date=day(1)),
        price(sku_id="ancient active", effective_date=day(200)),
        price(sku_id="retired 90", effective_date=day(90), is_active=False),
        price(sku_id="retired 91", effective_date=day(91), is_active=False),
        price(sku_id="unknown", effective_date=day(91), is_active=None),
    )


def active(frame):
    return {r["sku_id"]: r["is_active"] for r in frame.collect()}


def test_deactivate_keeps_the_same_day_and_is_idempotent(spark):
    once = maintenance.deactivate(stock(spark), TODAY, LATER)
    assert active(once) == {
        "today": True, "yesterday": False, "ancient active": False, "retired 90": False, "retired 91": False,
        "unknown": None,
    }
    touched = once.where(F.col("last_updated") == F.lit(LATER))
    assert {r["sku_id"] for r in touched.collect()} == {"yesterday", "ancient active"}
    again = maintenance.deactivate(once, TODAY, LATER + timedelta(days=1))
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_expiry_is_null_safe_and_idempotent(spark):
    once = maintenance.drop_expired(stock(spark), TODAY)
    assert set(active(once)) == {"today", "yesterday", "ancient active", "retired 90", "unknown"}
    assert maintenance.drop_expired(once, TODAY).count() == once.count()


def test_two_refreshes_in_a_day_duplicate(spark):
    fetched = catalogs.build_catalog(feed_of(spark, sku("new")), TODAY, NOW)
    once = maintenance.refresh(stock(spark), fetched, TODAY, NOW)
    # The active row of long ago is retired first and then expires.
    assert set(active(once)) == {"today", "yesterday", "retired 90", "unknown", "new"}
    twice = maintenance.refresh(once, fetched, TODAY, NOW)
    assert twice.where("sku_id = 'new' and is_active").count() == 2


def test_backdate(spark):
    specs = specs_of(spark, *[spec(resource_id=f"r{i}-00{i % 3}") for i in range(60)])
    moved = {r["resource_id"]: r["created_at"] for r in maintenance.backdate(specs, LATER).collect()}
    stamps = {r["resource_id"]: r["created_at"] for r in specs.collect()}
    top = spark.range(1).select(F.lit(LATER)).first()[0]
    for name, when in moved.items():
        days = (top - when).total_seconds() / 86400
        if name.endswith("-001"):
            assert days in range(31)
        elif name.endswith("-002"):
            assert days in range(8)
        else:
            assert when == stamps[name]
    assert len({v for k, v in moved.items() if k.endswith("-001")}) > 5


def test_staleness(spark):
    row = reports.catalog_staleness(stock(spark), NOW + timedelta(hours=24)).first()
    assert (row["age_hours"], row["is_stale"]) == (24.0, False)
    assert reports.catalog_staleness(stock(spark), NOW + timedelta(hours=25)).first()["is_stale"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "catalog")
    assert tables.snapshots(spark, path) == [] and tables.read_snapshot(spark, path).isEmpty()
    assert tables.write_snapshot(stock(spark).where("sku_id <> 'unknown'"), path) == 0
    assert tables.write_snapshot(tables.read_snapshot(spark, path).where("is_active"), path) == 1
    assert tables.read_snapshot(spark, path, 0).count() == 5
    assert set(active(tables.read_snapshot(spark, path))) == {"today", "yesterday", "ancient active"}
    assert tables.read_snapshot(spark, path).schema.names == schemas.CATALOG.names[:23] + [
        n for n in schemas.CATALOG.names[23:] if n != "effective_date"
    ] + ["effective_date"] or set(tables.read_snapshot(spark, path).columns) == set(schemas.CATALOG.names)
    with pytest.raises(ValueError):
        tables.write_snapshot(stock(spark), path, 1)


def test_an_unfinished_snapshot_is_ignored_and_overwritten(spark, tmp_path):
    path = str(tmp_path / "catalog")
    tables.write_snapshot(stock(spark), path)
    stock(spark).write.parquet(tables.snapshot_path(path, 1))
    # No manifest names these folders.
    assert tables.snapshots(spark, path) == [0]
    assert tables.write_snapshot(stock(spark).limit(2), path) == 1
    assert tables.read_snapshot(spark, path).count() == 2


def test_append_drops_unknown_columns_and_returns_rejects(spark, tmp_path):
    path = str(tmp_path / "specs")
    rows = specs_of(spark, spec(resource_id="ok"), spec(resource_id="bad", disk_type=None)).withColumn("x", F.lit(1))
    rejects = tables.append(rows, path, "specs", now=NOW)
    assert [r["missing_columns"] for r in rejects.collect()] == [["disk_type"]]
    stored = tables.read(spark, path, "specs")
    assert [r["resource_id"] for r in stored.collect()] == ["ok"]
    assert set(stored.columns) == {*schemas.SPECS.names, "created_date"}
    assert [p.name for p in (tmp_path / "specs").glob("created_date=*")] == ["created_date=2024-05-06"]


def test_rows_are_sorted_inside_files(spark, tmp_path):
    path = str(tmp_path / "specs")
    rows = specs_of(spark, *[spec(resource_id=str(i), project_id=f"p{i * 7 % 10}") for i in range(40)]).coalesce(1)
    tables.append(rows, path, "specs", now=NOW)
    stored = [r["project_id"] for r in tables.read(spark, path, "specs").collect()]
    assert stored == sorted(stored)


def test_rollup_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "rollup")

    def lines(*rows):
        return spark.createDataFrame(rows, "d string, total_cost_usd double").selectExpr(
            "cast(d as date) as calc_date", "'p' as project_id", "'r' as region", "'spot' as pricing_model",
            "total_cost_usd", "0e0 as total_discount_usd",
        )

    jobs.update_rollup(lines(("2024-05-05", 1.0), ("2024-05-06", 2.0)), path)
    jobs.update_rollup(lines(("2024-05-06", 2.0), ("2024-05-06", 3.0)), path)
    rows = spark.read.parquet(path).orderBy("calc_date").collect()
    assert [(r["line_count"], int(r["cost_micros"])) for r in rows] == [(1, 1000000), (2, 5000000)]
    months = reports.monthly_cost(spark.read.parquet(path)).collect()
    assert [(str(r["month"]), r["line_count"], r["total_cost_usd"]) for r in months] == [("2024-05-01", 3, 6.0)]


def test_run_boq(spark, tmp_path):
    path = str(tmp_path / "results")
    specs = seed_specs(spark).unionByName(specs_of(spark, spec(resource_id="broken", region="us-west1", disk_type=None)))
    catalog = catalog_of(spark)
    run = jobs.run_boq(specs, catalog, path, regions=["us-west1", "us-east1"], requested_by="me", now=NOW)
    assert {r["resource_id"] for r in run.lines.collect()} == {"batch-002", "prod-db-002"}
    assert [r["resource_id"] for r in run.rejects.collect()] == ["broken"]
    summary = run.summary.first()
    assert summary["total_resources"] == 2
    assert summary["total_cost_usd"] == pytest.approx(278.7055 + 20.038948, abs=1e-5)
    assert {r["region"] for r in run.cost_by_region.collect()} == {"us-west1", "us-east1"}
    assert run.cost_by_project.count() == 1
    overview = run.overview.first()
    assert overview["resources_processed"] == 2 and set(overview["cost_by_region"]) == {"us-west1", "us-east1"}
    assert sum(overview["cost_by_project_id"].values()) == pytest.approx(overview["total_cost_usd"])
    # A run with the same id replaces its lines.
    run = jobs.run_boq(specs, catalog, path, regions=["us-west1", "us-east1"], boq_id=run.boq_id, now=NOW)
    assert tables.read(spark, path, "results").count() == 2
    # A second run appends beside the first and has its own id.
    other = jobs.run_boq(specs, catalog, path, regions=["us-west1"], now=NOW)
    assert other.boq_id != run.boq_id
    assert other.lines.count() == 1 and run.lines.count() == 2
    assert tables.read(spark, path, "results").where("notes is null").count() == 3


def test_nothing_found_raises_and_writes_nothing(spark, tmp_path):
    path = tmp_path / "results"
    with pytest.raises(jobs.NothingFound):
        jobs.run_boq(seed_specs(spark), catalog_of(spark), str(path), project_ids=["none"])
    assert not path.exists()


def test_refresh_job(spark, tmp_path):
    path = str(tmp_path / "catalog")
    tables.write_snapshot(stock(spark), path)
    feed = feed_of(spark, sku("new", nanos="0", units="3"), sku("newer", "SSD disk", nanos="0", units="1"))
    report = jobs.refresh_catalog(feed, path, TODAY, NOW).report
    rows = {r["category"]: r for r in report.collect()}
    assert rows["compute"]["record_count"] == 2 and rows["compute"]["avg_price"] == 2.0
    assert rows["storage"]["record_count"] == 1 and rows["storage"]["total_records"] == 2
    assert tables.snapshots(spark, path) == [0, 1]
    assert rows["compute"]["update_time"] is not None and str(rows["compute"]["effective_date"]) == str(TODAY)


def test_a_report_without_categories_keeps_its_envelope(spark):
    rows = reports.update_report(catalog_of(spark), TODAY, 7, NOW).collect()
    assert [(r["category"], r["total_records"], str(r["effective_date"])) for r in rows] == [(None, 7, str(TODAY))]


def test_a_feed_of_invalid_rows_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "catalog")
    tables.write_snapshot(stock(spark), path)
    broken = feed_of(spark, sku("x")).withColumn("skuId", F.lit(None).cast("string"))
    with pytest.raises(jobs.EmptyFeed):
        jobs.refresh_catalog(broken, path, TODAY, NOW)
    assert tables.snapshots(spark, path) == [0]
    both = jobs.refresh_catalog(broken.unionByName(feed_of(spark, sku("ok"))), path, TODAY, NOW)
    assert [r["missing_columns"] for r in both.rejects.collect()] == [["sku_id"]]
    assert {r["total_records"] for r in both.report.collect()} == {1}


def test_a_refresh_writes_only_days_that_change(spark, tmp_path):
    path = tmp_path / "catalog"
    tables.write_snapshot(stock(spark), str(path))
    jobs.refresh_catalog(feed_of(spark, sku("new")), str(path), TODAY, NOW)
    old, new = tables.folders(spark, str(path), 0), tables.folders(spark, str(path), 1)
    day = lambda n: f"effective_date={TODAY - timedelta(days=n)}"
    assert set(new) - set(old) == {f"v=1/{day(0)}", f"v=1/{day(1)}"} | ({f"v=1/{day(91)}"} & set(new))
    assert {f"v=0/{day(0)}", f"v=0/{day(90)}"} <= set(new) and f"v=0/{day(1)}" not in new
    assert set(active(tables.read_snapshot(spark, str(path)))) == {"today", "yesterday", "retired 90", "unknown", "new"}
    assert set(active(tables.read_snapshot(spark, str(path), 0))) == set(active(stock(spark)))


def test_a_claimed_number_is_refused_and_skipped(spark, tmp_path):
    path = tmp_path / "catalog"
    tables.write_snapshot(stock(spark), str(path))
    (path / "_claim-1").touch()  # of a writer that works still or has died
    with pytest.raises(ValueError):
        tables.write_snapshot(stock(spark), str(path), 1)
    assert tables.write_snapshot(stock(spark).limit(1), str(path)) == 2
    assert tables.snapshots(spark, str(path)) == [0, 2]


def test_an_append_leaves_older_snapshots_as_they_are(spark, tmp_path):
    path = str(tmp_path / "catalog")
    tables.write_snapshot(stock(spark), path)
    before = sorted(map(str, tables.read_snapshot(spark, path, 0).collect()))
    stored, rejects = tables.append_catalog(catalog_of(spark, price(sku_id="more"), price(sku_id=None)), path, NOW)
    assert [r["sku_id"] for r in stored.collect()] == ["more"] and rejects.count() == 1
    assert sorted(map(str, tables.read_snapshot(spark, path, 0).collect())) == before
    assert tables.read_snapshot(spark, path).count() == len(before) + 1


def test_old_snapshots_expire_with_their_own_folders(spark, tmp_path):
    path = tmp_path / "catalog"
    tables.write_snapshot(stock(spark), str(path))
    for n in range(3):
        jobs.refresh_catalog(feed_of(spark, sku(f"new {n}")), str(path), TODAY + timedelta(days=n), NOW)
    latest = sorted(map(str, tables.read_snapshot(spark, str(path)).collect()))
    tables.expire_snapshots(spark, str(path), keep=1)
    assert tables.snapshots(spark, str(path)) == [3]
    assert sorted(map(str, tables.read_snapshot(spark, str(path)).collect())) == latest
    assert {f"{p.parent.name}/{p.name}" for p in path.glob("v=*/*=*")} == set(tables.folders(spark, str(path), 3))


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_days_are_those_of_utc_in_any_session(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        early = datetime(2024, 5, 6, 2, tzinfo=timezone.utc)
        run = jobs.run_boq(seed_specs(spark), catalog_of(spark), str(tmp_path / "r"), regions=["us-west1"], now=early)
        row = run.lines.first()
        assert (str(row["calc_date"]), str(row["pricing_date"])) == ("2024-05-06", "2024-05-06")
        assert [p.name for p in (tmp_path / "r").glob("calc_date=*")] == ["calc_date=2024-05-06"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_an_empty_feed_does_not_retire_the_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog")
    tables.write_snapshot(stock(spark), path)
    with pytest.raises(jobs.EmptyFeed):
        jobs.refresh_catalog(feed_of(spark), path, TODAY, NOW)
    assert tables.snapshots(spark, path) == [0]
    jobs.refresh_catalog(feed_of(spark), path, TODAY, NOW, require_nonempty=False)
    assert tables.read_snapshot(spark, path).where("is_active and sku_id = 'yesterday'").isEmpty()


def test_fetch_prices_saves_only_when_asked(spark, tmp_path):
    path = str(tmp_path / "catalog")
    feed = feed_of(spark, sku("a", regions=["x"]), sku("b", regions=["y"]))
    assert jobs.fetch_prices(feed, TODAY, region="x", now=NOW).count() == 1
    assert tables.snapshots(spark, path) == []
    jobs.fetch_prices(feed, TODAY, save_to=path, now=NOW)
    jobs.fetch_prices(feed, TODAY, save_to=path, now=NOW)
    stored = tables.read_snapshot(spark, path)
    assert stored.count() == 4 and stored.where("discount_percent = 0 and pricing_source is not null").count() == 4


def test_results_keep_a_year(spark):
    lines = spark.createDataFrame([(date(2023, 5, 7),), (date(2023, 5, 6),), (TODAY,)], "calc_date date")
    assert reports.results_retention(lines, TODAY).count() == 2


def test_a_hot_day_is_split_over_files(spark, tmp_path):
    path = tmp_path / "specs"
    days = F.when(F.col("id") % 3 == 0, F.lit("2024-05-06")).otherwise(F.concat(F.lit("2024-04-0"), F.col("id") % 9 + 1))
    rows = spark.range(30_000).repartition(4).select(
        F.lit("p").alias("project_id"), F.md5(F.col("id").cast("string")).alias("resource_id"),
        F.sha2(F.col("id").cast("string"), 512).alias("description"), days.cast("timestamp").alias("created_at"),
        F.lit("n1-standard-1").alias("machine_type"), F.lit(1).alias("vcpu_count"), F.lit(1.0).alias("memory_gb"),
        F.lit("pd-ssd").alias("disk_type"), F.lit(1).alias("disk_size_gb"), F.lit("r").alias("region"),
        F.lit(1).alias("usage_duration_hours"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        tables.append(rows, str(path), "specs", many_days=True, now=NOW)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {day.name: len(list(day.glob("*.parquet"))) for day in path.glob("created_date=*")}
    assert files["created_date=2024-05-06"] > 2
    assert sum(files.values()) < 40
    assert tables.read(spark, str(path), "specs").count() == 30_000
