"""The registered queries: name -> (session, folder of test tables) -> DataFrame.

Every query reads its tables whole. Dates, times and nested values are shown as text so that any engine can compare
them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costloom import constants as K, schemas
from costloom.functions import display, rates
from costloom.operators import catalog as catalogs
from costloom.operators import best_prices, costing, filters, maintenance, paging, pricing, quality, reports, requests
from costloom.plans import jobs, listings
from costloom.session import scratch_path, settle
from costloom.sources import books, rollups, tables
from costloom.sources import feed as feeds
from costloom.streaming import anomalies
from costloom.streaming import jobs as streams
from workload import inputs
from workload.inputs import AS_OF, BOQ_ID, NOW, REFRESH_DAY, REFRESH_TIME, catalog, feed, lines, specs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPEC_COLUMNS = [
    "project_id", "resource_id", "machine_type", "vcpu_count", "memory_gb", "disk_type", "disk_size_gb", "region",
    "usage_duration_hours", "usage_pattern", "pricing_model", "gpu_type", "gpu_count", "external_ip",
    "cost_center", "environment",
]
LINE_COLUMNS = [
    "boq_id", "resource_id", "project_id", "region", "pricing_model", "subtotal_usd", "total_discount_usd",
    "total_cost_usd",
]
ANOMALY_SIGMAS = 3.0
BUDGETS = {"automobile": 1e5, "building": 1e6, "furniture": 1e7, "household": 1e8}
CROSSED_BUDGETS = {"automobile": 1e3, "building": 2e4, "furniture": 3e4, "household": 1e8}
EPOCH = date(1970, 1, 1)
PERIODS = ["1996-01-01", "1997-07-01", "1999-01-01"]  # where the later batches of streamed lines begin
FILTER_REGIONS = ["us-central1", "us-east1"]
FILTER_MODELS = ["spot", "cud-1-year"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def time(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def tiers_text(name: str) -> Column:
    tier = F.transform(
        name,
        lambda t: F.concat_ws(
            "|",
            t["start_usage_amount"].cast("string"),
            rates.in_units(t["price_per_unit"], rates.NANOS).cast("string"),
            t["currency_code"],
        ),
    )
    return F.array_join(tier, ";").alias(name)


def disks_text(name: str) -> Column:
    disk = F.transform(
        name,
        lambda d: F.concat_ws(
            "|",
            d["disk_type"],
            d["size_gb"].cast("string"),
            rates.in_units(d["cost_usd"]).cast("string"),
            rates.in_units(d["price_per_gb_month"]).cast("string"),
        ),
    )
    return F.array_join(disk, ";").alias(name)


def tags_text(name: str) -> Column:
    return F.array_join(name, ";").alias(name)


# Price feed and catalog.


@query
def sku_relevant(spark, sf_dir):
    return catalogs.select_skus(feed(spark, sf_dir)).select(F.col("skuId").alias("sku_id"), "description")


@query
def sku_prefilter(spark, sf_dir):
    return catalogs.select_skus(feed(spark, sf_dir), "adhoc").select(F.col("skuId").alias("sku_id"), "description")


@query
def sku_prefilter_region(spark, sf_dir):
    rows = catalogs.build_catalog(feed(spark, sf_dir), AS_OF, NOW, "adhoc", region="us-west1")
    return rows.select("sku_id", "region", "category")


@query
def sku_base_price(spark, sf_dir):
    return catalogs.price_skus(feed(spark, sf_dir)).select(F.col("skuId").alias("sku_id"), "price_per_unit")


@query
def sku_tiers(spark, sf_dir):
    return catalog(spark, sf_dir).where("tiered_rates is not null").select("sku_id", tiers_text("tiered_rates"))


@query
def catalog_tags(spark, sf_dir):
    return catalog(spark, sf_dir).select("sku_id", tags_text("tags"))


@query
def catalog_daily(spark, sf_dir):
    rows = catalogs.build_catalog(feed(spark, sf_dir), AS_OF, NOW)
    shown = {
        "effective_date": day("effective_date"),
        "last_updated": time("last_updated"),
        "tiered_rates": tiers_text("tiered_rates"),
        "tags": tags_text("tags"),
    }
    return rows.select([shown.get(name, F.col(name)) for name in rows.columns])


@query
def catalog_adhoc(spark, sf_dir):
    rows = catalogs.build_catalog(feed(spark, sf_dir), AS_OF, NOW, profile="adhoc")
    shown = {"effective_date": day("effective_date"), "last_updated": time("last_updated")}
    return rows.select([shown.get(name, F.col(name)) for name in rows.columns])


# Resource specs.


@query
def specs_filter(spark, sf_dir):
    found = filters.list_specs(specs(spark, sf_dir), regions=FILTER_REGIONS, pricing_models=FILTER_MODELS)
    return found.select(SPEC_COLUMNS)


@query
def spec_defaults(spark, sf_dir):
    partial = specs(spark, sf_dir).drop("usage_pattern", "external_ip", "pricing_model", "boq_id")
    filled = quality.apply_defaults(partial, "specs", NOW)
    return filled.select(
        "resource_id", "usage_pattern", "pricing_model", "gpu_count", "network_tier", "external_ip", "zone",
        time("updated_at"),
    )


@query
def spec_rejects(spark, sf_dir):
    broken = specs(spark, sf_dir).withColumns(
        {
            "machine_type": F.nullif("machine_type", F.lit("x9-odd-1")),
            "disk_size_gb": F.when(F.col("disk_size_gb") < 500, F.col("disk_size_gb")),
        }
    )
    _, rejects = quality.split_valid(broken, "specs")
    return rejects.select("resource_id", tags_text("missing_columns"))


@query
def spec_backdate(spark, sf_dir):
    moved = maintenance.backdate(specs(spark, sf_dir), NOW, {"1": 30, "2": 7})
    return moved.select("resource_id", time("created_at"))


@query
def projects(spark, sf_dir):
    return listings.choices(specs(spark, sf_dir))[0]


@query
def regions(spark, sf_dir):
    return listings.choices(specs(spark, sf_dir))[1]


@query
def resource_count(spark, sf_dir):
    return reports.count_rows(filters.where_equal(specs(spark, sf_dir), project_id="proj-3", region=""))


@query
def resources_page(spark, sf_dir):
    found = listings.resources(specs(spark, sf_dir), region="us-east1", number=2).rows
    return found.select(*SPEC_COLUMNS, time("created_at"))


@query
def resources_deep_page(spark, sf_dir):
    """The same page by the route deep pages take."""
    rows = filters.where_equal(specs(spark, sf_dir), region="us-east1")
    found = paging.page(rows, paging.SPEC_ORDER, 2, K.RESOURCE_PAGE_SIZE, top_rows=0)
    return found.select(*SPEC_COLUMNS, time("created_at"))


@query
def resources_stored_page(spark, sf_dir):
    """The same page out of the stored list."""
    folder = listings.store_resources(specs(spark, sf_dir), scratch_path(spark, "lists"), region="us-east1")
    found = listings.stored_resources(spark, folder, 2).rows
    return found.select(*SPEC_COLUMNS, time("created_at"))


@query
def page_info(spark, sf_dir):
    return listings.resources(specs(spark, sf_dir), number=2).info


# Price lookup.


@query
def price_compute(spark, sf_dir):
    priced = pricing.price_all(specs(spark, sf_dir), catalog(spark, sf_dir), kinds=["compute"])
    return priced.select("resource_id", "compute_price_per_hour")


@query
def price_storage(spark, sf_dir):
    priced = pricing.price_all(specs(spark, sf_dir), catalog(spark, sf_dir), kinds=["storage"])
    return priced.select("resource_id", "storage_price_per_gb_month")


@query
def price_gpu(spark, sf_dir):
    priced = pricing.price_all(specs(spark, sf_dir), catalog(spark, sf_dir), kinds=["gpu"])
    return priced.select("resource_id", "gpu_price_per_hour")


PRICES = [
    "resource_id", "compute_price_per_hour", "memory_price_per_gb_hour", "storage_price_per_gb_month",
    "gpu_price_per_hour",
]


@query
def price_all(spark, sf_dir):
    return pricing.price_all(specs(spark, sf_dir), catalog(spark, sf_dir)).select(PRICES)


@query
def price_all_large_book(spark, sf_dir):
    """The same prices by the route a price book beyond the broadcast bounds takes."""
    return pricing.price_all(specs(spark, sf_dir), catalog(spark, sf_dir), max_rows=0).select(PRICES)


@query
def price_all_stored(spark, sf_dir):
    """The same prices from a stored book that followed the catalog: prices arrived in three parts, all of them active;
    then those went that are not active now."""
    now, path = catalog(spark, sf_dir), scratch_path(spark, "books")
    arrived, part = now.withColumn("is_active", F.lit(True)), F.crc32("sku_id") % 3
    books.write(best_prices.build(arrived.where(part == 0)), path, 0)
    for state in (1, 2):
        books.follow(spark, path, state - 1, state, arrived.where(part <= state), added=arrived.where(part == state))
    book = books.follow(spark, path, 2, 3, now, retired=now.where("not is_active"))
    return pricing.price_from(specs(spark, sf_dir), book.prices, book.size).select(PRICES)


# Cost lines.


@query
def boq_base_costs(spark, sf_dir):
    priced = pricing.price_all(specs(spark, sf_dir), catalog(spark, sf_dir))
    return costing.add_base_costs(priced).select(
        "resource_id", "compute_cost_usd", "memory_cost_usd", "storage_cost_usd", "network_cost_usd", "gpu_cost_usd"
    )


@query
def boq_discounts(spark, sf_dir):
    priced = pricing.price_all(specs(spark, sf_dir), catalog(spark, sf_dir))
    return costing.add_discounts(costing.add_base_costs(priced)).select(
        "resource_id",
        "sustained_use_discount_percent",
        "committed_use_discount_percent",
        "spot_discount_percent",
        "sustained_use_discount_usd",
        "committed_use_discount_usd",
        "spot_discount_usd",
    )


@query
def boq_totals(spark, sf_dir):
    return lines(spark, sf_dir).select("resource_id", "subtotal_usd", "total_discount_usd", "total_cost_usd")


@query
def boq_disks(spark, sf_dir):
    rows = inputs.specs_with_disks(spark, sf_dir)
    costs = costing.extra_disk_costs(F.col("additional_disks"), F.col("usage_duration_hours"))
    disk = F.posexplode_outer(costs).alias("disk_no", "disk")
    return rows.select("resource_id", disk).select("resource_id", F.col("disk_no").cast("bigint"), "disk.*")


@query
def boq_lines(spark, sf_dir):
    rows = inputs.specs_with_disks(spark, sf_dir)
    result = costing.boq_lines(rows, catalog(spark, sf_dir), F.col("boq_id"), F.col("created_at"), "tester")
    shown = {
        "calculation_timestamp": time("calculation_timestamp"),
        "pricing_date": day("pricing_date"),
        "additional_storage_costs": disks_text("additional_storage_costs"),
    }
    return result.select([shown.get(name, F.col(name)) for name in result.columns])


@query
def boq_lines_by_id(spark, sf_dir):
    return filters.where_equal(lines(spark, sf_dir), boq_id=BOQ_ID).select(LINE_COLUMNS)


@query
def results_page(spark, sf_dir):
    found = listings.results(lines(spark, sf_dir), boq_id=BOQ_ID).rows
    return found.select(*LINE_COLUMNS, time("calculation_timestamp"))


@query
def results_count(spark, sf_dir):
    return reports.count_rows(filters.where_equal(lines(spark, sf_dir), boq_id=BOQ_ID))


@query
def recent_results_page(spark, sf_dir):
    found = listings.results(lines(spark, sf_dir), project="proj-3", number=2).rows
    return found.select(*LINE_COLUMNS, time("calculation_timestamp"))


@query
def recent_count(spark, sf_dir):
    return reports.count_rows(filters.where_equal(lines(spark, sf_dir), project_id="proj-3"))


@query
def boq_requests(spark, sf_dir):
    """Requests by project, by region with a pricing model, and one for everything, all in one pass."""
    own = specs(spark, sf_dir).drop("boq_id")
    result = requests.boq_for_requests(own, catalog(spark, sf_dir), request_rows(spark, sf_dir))
    return result.select(*LINE_COLUMNS, "requested_by")


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    nations, areas = inputs.table(spark, sf_dir, "nation"), inputs.table(spark, sf_dir, "region")

    def row(boq_id, project_ids=none, regions=none, pricing_models=none):
        return [
            boq_id.alias("boq_id"),
            project_ids.alias("project_ids"),
            none.alias("resource_ids"),
            regions.alias("regions"),
            pricing_models.alias("pricing_models"),
            F.lit("batch").alias("requested_by"),
            F.lit(NOW).alias("requested_at"),
        ]

    key = F.col("n_nationkey").cast("string")
    by_project = nations.select(row(F.concat(F.lit("p"), key), F.array(F.concat(F.lit("proj-"), key))))
    region_key = F.col("r_regionkey")
    by_region = areas.select(
        row(
            F.concat(F.lit("r"), region_key.cast("string")),
            regions=F.array(F.lit("us-east1"), F.when(region_key > 1, F.lit("europe-west1"))),
            pricing_models=F.when(region_key > 2, F.array(F.lit("spot"))),
        )
    )
    everything = areas.where("r_regionkey = 0").select(row(F.lit("all"), project_ids=F.array().cast("array<string>")))
    return by_project.unionByName(by_region).unionByName(everything)


# Summaries and reports.


@query
def boq_summary(spark, sf_dir):
    return reports.boq_summary(lines(spark, sf_dir))


@query
def cost_by_project(spark, sf_dir):
    return reports.cost_by(lines(spark, sf_dir), "project_id")


@query
def cost_by_region(spark, sf_dir):
    return reports.cost_by(lines(spark, sf_dir), "region")


@query
def boq_summary_by_id(spark, sf_dir):
    return listings.results(lines(spark, sf_dir), boq_id=BOQ_ID).summary


@query
def dash_resources(spark, sf_dir):
    return reports.resource_stats(specs(spark, sf_dir))


@query
def dash_results(spark, sf_dir):
    return reports.result_stats(lines(spark, sf_dir), AS_OF)


@query
def dashboard(spark, sf_dir):
    return reports.dashboard(specs(spark, sf_dir), lines(spark, sf_dir), AS_OF)


@query
def cost_history(spark, sf_dir):
    history = reports.cost_history(lines(spark, sf_dir), AS_OF)
    return history.select(day("date"), "calculations", "total_resources", "total_cost")


@query
def today_by_project(spark, sf_dir):
    return reports.today_by_project(lines(spark, sf_dir), AS_OF)


@query
def report_format(spark, sf_dir):
    cost = F.col("total_cost_usd")
    return lines(spark, sf_dir).select(
        "resource_id",
        display.as_currency(cost).alias("currency"),
        display.as_fixed(cost).alias("fixed"),
        display.as_short_date(F.col("calculation_timestamp")).alias("date"),
        display.as_json(F.struct("resource_id", "vcpu_count", "usage_pattern")).alias("json"),
    )


# Catalog reports and maintenance.

CATALOG_COLUMNS = [
    "sku_id", "sku_name", "service_name", "category", "region", "usage_type", "price_per_unit", "is_active"
]


@query
def catalog_page(spark, sf_dir):
    found = listings.prices(catalog(spark, sf_dir), number=2).rows
    return found.select(*CATALOG_COLUMNS, day("effective_date"))


@query
def catalog_count(spark, sf_dir):
    rows = filters.filter_catalog(
        catalog(spark, sf_dir), service=K.COMPUTE_SERVICE_NAME, category="compute", region="us-central1"
    )
    return reports.count_rows(rows)


@query
def update_report(spark, sf_dir):
    report = reports.update_report(catalog(spark, sf_dir), REFRESH_DAY, total_records=0)
    return report.select("category", "service_name", "record_count", "avg_price", "min_price", "max_price")


def catalog_rows(rows: DataFrame) -> DataFrame:
    return rows.select("sku_id", "price_per_unit", "is_active", day("effective_date"), time("last_updated"))


@query
def catalog_deactivate(spark, sf_dir):
    return catalog_rows(maintenance.deactivate(catalog(spark, sf_dir), REFRESH_DAY, REFRESH_TIME))


@query
def catalog_retention(spark, sf_dir):
    return catalog_rows(maintenance.drop_expired(catalog(spark, sf_dir), AS_OF))


@query
def catalog_refresh(spark, sf_dir):
    fetched = catalogs.build_catalog(feed(spark, sf_dir), REFRESH_DAY, REFRESH_TIME)
    return catalog_rows(maintenance.refresh(catalog(spark, sf_dir), fetched, REFRESH_DAY, REFRESH_TIME))


# Jobs that write tables, read back from the shared folder.


@query
def run_boq(spark, sf_dir):
    run = jobs.run_boq(
        specs(spark, sf_dir),
        catalog(spark, sf_dir),
        scratch_path(spark, "results"),
        regions=FILTER_REGIONS,
        pricing_models=FILTER_MODELS,
        requested_by=K.DEFAULT_WEB_REQUESTER,
        now=NOW,
    )
    return run.summary


@query
def results_append(spark, sf_dir):
    """All lines, calculated when their resource was created, stored by day and read back whole."""
    return _stored_history(spark, sf_dir, (AS_OF - EPOCH).days)


@query
def results_pruned(spark, sf_dir):
    """The last year of the same table: the date filter prunes folders."""
    return _stored_history(spark, sf_dir, 365)


def _stored_history(spark, sf_dir, days):
    path = scratch_path(spark, "results")
    tables.append_lines(_all_lines(spark, sf_dir), path, "all", many_days=True)
    stored = tables.read(spark, path, "results")
    return reports.cost_history(stored, AS_OF, days).select(day("date"), "calculations", "total_resources", "total_cost")


def _all_lines(spark, sf_dir):
    return costing.boq_lines(specs(spark, sf_dir), catalog(spark, sf_dir), F.col("boq_id"), F.col("created_at"), "tester")


def _kept_rollup(spark, sf_dir):
    """A rollup of all lines, which two writers bring, each half of the runs; then the second runs again and has fewer:
    only lines of resources with an even number."""
    rollup = scratch_path(spark, "rollup")
    number = lambda name: F.substring(name, 5, 20).cast("bigint")
    whole = reports.with_calc_date(_all_lines(spark, sf_dir))
    whole = settle(whole.select(*rollups.LINE_FIELDS, "resource_id"))  # the other columns would be stored for nothing
    of = F.pmod(number("boq_id"), F.lit(2))
    for writer in range(2):
        rollups.update(whole.where(of == writer), rollup, f"w{writer}")
    rollups.update(whole.where((of == 1) & (number("resource_id") % 2 == 0)), rollup, "w1")
    return rollup


@query
def rollup_updates(spark, sf_dir):
    """The stored daily rollup after two writers, of which one ran again."""
    rollup = _kept_rollup(spark, sf_dir)
    return rollups.by_group(spark, rollup).select(
        day("calc_date"), "project_id", "region", "pricing_model", "line_count",
        F.col("cost_micros").cast("bigint"), F.col("discount_micros").cast("bigint"),
    )


@query
def rollup_history(spark, sf_dir):
    """The daily history of a year from stored sums and bitmaps of runs."""
    rollup = _kept_rollup(spark, sf_dir)
    return rollups.history(spark, rollup, AS_OF, 365).select(day("date"), "calculations", "total_resources", "total_cost")


@query
def rollup_stats(spark, sf_dir):
    """Key figures of a year from stored sums and merged bitmaps."""
    rollup = _kept_rollup(spark, sf_dir)
    return rollups.result_stats(spark, rollup, AS_OF, 365)


@query
def stored_run(spark, sf_dir):
    """The lines of one run in a table of many, found by the register."""
    path = scratch_path(spark, "results")
    tables.append_lines(_all_lines(spark, sf_dir), path, "all", many_days=True)
    return tables.run_lines(spark, path, BOQ_ID).select(*LINE_COLUMNS, day("calc_date"))


@query
def table_layout(spark, sf_dir):
    """All resources, stored by the day of their creation and read back whole."""
    path = scratch_path(spark, "specs")
    tables.append(specs(spark, sf_dir), path, "specs", many_days=True, now=NOW)
    stored = tables.read(spark, path, "specs")
    return stored.groupBy(day("created_date"), "region").agg(F.count(F.lit(1)).alias("resources"))


@query
def specs_clustered(spark, sf_dir):
    """Resources of one project and region out of a day that holds all of them, dealt anew over 16 files."""
    path = scratch_path(spark, "specs")
    rows = specs(spark, sf_dir).withColumn("created_at", F.lit(NOW))
    tables.append(rows, path, "specs", now=NOW)
    tables.recluster(spark, path, [AS_OF], files=16)
    found = filters.where_equal(tables.read(spark, path, "specs"), project_id="proj-5", region=None)
    return found.where(F.col("pricing_model").isin(FILTER_MODELS)).select(*SPEC_COLUMNS)


@query
def catalog_append(spark, sf_dir):
    path = scratch_path(spark, "catalog")
    tables.write_snapshot(catalog(spark, sf_dir), path)
    jobs.fetch_prices(feed(spark, sf_dir), AS_OF, save_to=path, now=NOW)
    stored = tables.read_snapshot(spark, path)
    return stored.groupBy("category", day("effective_date")).agg(F.count(F.lit(1)).alias("skus"))


@query
def refresh_job(spark, sf_dir):
    path = scratch_path(spark, "catalog")
    tables.write_snapshot(catalog(spark, sf_dir), path)
    report = jobs.refresh_catalog(feed(spark, sf_dir), path, REFRESH_DAY, REFRESH_TIME).report
    return report.drop("update_time").withColumn("effective_date", day("effective_date"))


@query
def stream_refresh(spark, sf_dir):
    """Feed files through the streaming refresh; equals ``catalog_refresh``."""
    inbox, path = scratch_path(spark, "feed"), scratch_path(spark, "catalog")
    feed(spark, sf_dir).select(schemas.RAW_SKU.names).write.json(inbox)
    tables.write_snapshot(catalog(spark, sf_dir), path, 0)
    stream = streams.start_refresh(
        spark, inbox, path, scratch_path(spark, "progress"), as_of=lambda _: REFRESH_DAY, now=REFRESH_TIME
    )
    stream.awaitTermination()
    return catalog_rows(tables.read_snapshot(spark, path))


@query
def stream_boq(spark, sf_dir):
    """Request files through the streaming calculation; equals ``boq_requests``."""
    inbox, path = scratch_path(spark, "requests"), scratch_path(spark, "results")
    request_rows(spark, sf_dir).write.json(inbox)
    stream = streams.start_boq(
        spark,
        inbox,
        lambda: specs(spark, sf_dir).drop("boq_id"),
        lambda: catalog(spark, sf_dir),
        path,
        scratch_path(spark, "progress"),
    )
    stream.awaitTermination()
    return tables.read(spark, path, "results").select(*LINE_COLUMNS, "requested_by")


@query
def stream_and_run(spark, sf_dir):
    """Streamed requests and a run in one results table, counted and added up by run."""
    inbox, path = scratch_path(spark, "requests"), scratch_path(spark, "results")
    request_rows(spark, sf_dir).write.json(inbox)
    own = specs(spark, sf_dir).drop("boq_id")
    streams.start_boq(
        spark, inbox, lambda: own, lambda: catalog(spark, sf_dir), path, scratch_path(spark, "progress")
    ).awaitTermination()
    jobs.run_boq(own, catalog(spark, sf_dir), path, regions=FILTER_REGIONS, boq_id="run", now=NOW)
    return tables.read(spark, path, "results").groupBy("boq_id").agg(
        F.count(F.lit(1)).alias("lines"), rates.exact_sum(F.col("total_cost_usd")).alias("total_cost_usd")
    )


# Declared reports.


@query
def budget_check(spark, sf_dir):
    return reports.budget_check(lines(spark, sf_dir), BUDGETS)


@query
def budget_crossings(spark, sf_dir):
    """Where each cost center's running cost passes its budget."""
    found = reports.budget_crossings(lines(spark, sf_dir), CROSSED_BUDGETS)
    return found.withColumn("calc_date", day("calc_date"))


@query
def results_retention(spark, sf_dir):
    return reports.results_retention(lines(spark, sf_dir), AS_OF).select(*LINE_COLUMNS, day("calc_date"))


@query
def daily_rollup(spark, sf_dir):
    rollup = reports.daily_rollup(lines(spark, sf_dir))
    return rollup.select(
        day("calc_date"), "project_id", "region", "pricing_model", "line_count",
        F.col("cost_micros").cast("bigint"), F.col("discount_micros").cast("bigint"),
    )


@query
def monthly_cost(spark, sf_dir):
    months = reports.monthly_cost(reports.daily_rollup(lines(spark, sf_dir)))
    return months.select(day("month"), "project_id", "line_count", "total_cost_usd")


@query
def cost_anomaly(spark, sf_dir):
    return reports.cost_anomalies(lines(spark, sf_dir), ANOMALY_SIGMAS).select(
        "resource_id", "project_id", "total_cost_usd", "cost_limit"
    )


@query
def stream_anomalies(spark, sf_dir):
    """All lines in four periods, each of which arrives in files and is judged by the periods before."""
    inbox, path, progress = (scratch_path(spark, name) for name in ("lines", "flags", "progress"))
    period = sum(((F.col("calc_date") >= F.lit(start).cast("date")).cast("int") for start in PERIODS), F.lit(0))
    shown = lines(spark, sf_dir).select("resource_id", "project_id", "total_cost_usd", period.alias("period"))
    whole = settle(shown)
    for number in range(len(PERIODS) + 1):
        whole.where(F.col("period") == number).drop("period").write.mode("append").parquet(inbox)
        anomalies.start_anomalies(feeds.stream_lines(spark, inbox), path, progress, ANOMALY_SIGMAS).awaitTermination()
    return anomalies.flagged(spark, path).select("resource_id", "project_id", "total_cost_usd", "cost_limit")


@query
def catalog_staleness(spark, sf_dir):
    return reports.catalog_staleness(catalog(spark, sf_dir), NOW).select(
        "service_name", time("last_updated"), "age_hours", "is_stale"
    )


@query
def cost_by_machine_class(spark, sf_dir):
    return reports.cost_by_machine_class(lines(spark, sf_dir))
