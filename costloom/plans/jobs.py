"""The three jobs: calculate a bill of quantity, refresh the catalog, fetch prices on demand."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from costloom.functions import utc_day
from costloom.operators import catalog as catalogs
from costloom.operators import costing, filters, maintenance, quality, reports
from costloom.session import settle
from costloom.sources import rollups, tables


class NothingFound(LookupError):
    """No resource matches the filters."""


class EmptyFeed(RuntimeError):
    """A feed without a usable price would retire the whole older catalog."""


@dataclass
class Refresh:
    number: int
    report: DataFrame
    rejects: DataFrame


@dataclass
class BoqRun:
    boq_id: str
    lines: DataFrame
    rejects: DataFrame

    @property
    def summary(self) -> DataFrame:
        return reports.boq_summary(self.lines)

    @property
    def overview(self) -> DataFrame:
        """The whole answer as one row: resources processed, totals, and cost by project and by region as maps."""
        return reports.run_summary(self.lines)

    @property
    def cost_by_project(self) -> DataFrame:
        return reports.cost_by(self.lines, "project_id")

    @property
    def cost_by_region(self) -> DataFrame:
        return reports.cost_by(self.lines, "region")


def run_boq(
    specs: DataFrame,
    catalog: DataFrame,
    results_path: str,
    project_ids: Sequence[str] | None = None,
    resource_ids: Sequence[str] | None = None,
    regions: Sequence[str] | None = None,
    pricing_models: Sequence[str] | None = None,
    requested_by: str | None = None,
    boq_id: str | None = None,
    now: datetime | None = None,
) -> BoqRun:
    """Price the matching resources, store their lines, and return the stored lines with their summaries.

    A run with an id that was used before on the same UTC day replaces those lines.
    """
    boq_id, now = boq_id or str(uuid.uuid4()), now or tables.utc_now()
    chosen = filters.filter_specs(specs, project_ids, resource_ids, regions, pricing_models)
    if chosen.isEmpty():
        raise NothingFound("no resource specifications match the filters")
    valid, rejects = quality.split_valid(chosen, "specs")
    lines = costing.boq_lines(valid, catalog, boq_id, now, requested_by)
    tables.append_lines(lines, results_path, boq_id, now=now)
    # Read the stored lines back, from one day's folder, instead of computing them again for each summary.
    stored = tables.read(specs.sparkSession, results_path, "results")
    mine = (F.col("calc_date") == utc_day(F.lit(now).cast("timestamp"))) & (F.col(tables.WRITER) == boq_id)
    return BoqRun(boq_id, stored.where(mine), rejects)


def refresh_catalog(
    feed: DataFrame,
    catalog_path: str,
    as_of: date,
    now: datetime | None = None,
    require_nonempty: bool = True,
    key: str = "",
) -> Refresh:
    """Retire, append and expire into a new snapshot. Only days with a row that changes are written again.

    Prices without a required column are returned as rejects; a feed without any valid price raises ``EmptyFeed``.
    """
    spark, now = feed.sparkSession, now or tables.utc_now()
    # Used for the check, the write and the report, so it is computed once.
    fetched = settle(quality.apply_defaults(catalogs.build_catalog(feed, as_of, now), "catalog", now))
    valid, rejects = quality.split_valid(fetched, "catalog")
    records = valid.count()
    if require_nonempty and not records:
        raise EmptyFeed("the feed has no usable price; nothing was written")
    done = tables.snapshots(spark, catalog_path)
    folders = tables.folders(spark, catalog_path, done[-1]) if done else []
    current = tables.read_folders(spark, catalog_path, folders)
    # At most one row per day of the catalog.
    days = maintenance.changing(current, as_of).select(F.col("effective_date").cast("string")).distinct().collect()
    touched = {row[0] for row in days}
    old = tables.read_folders(spark, catalog_path, [f for f in folders if tables.day_of(f) in touched])
    keep = [f for f in folders if tables.day_of(f) not in touched]
    rows = maintenance.refresh(old, valid, as_of, now)
    number = tables.write_snapshot(rows, catalog_path, now=now, keep=keep, key=key)
    written = tables.read_snapshot(spark, catalog_path, number)
    return Refresh(number, reports.update_report(written, as_of, records, now), rejects)


def fetch_prices(
    feed: DataFrame,
    as_of: date,
    region: str | None = None,
    save_to: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Catalog rows of the on-demand profile. With ``save_to``, they are added to that catalog, and the stored rows are
    returned; those without a required column are kept below ``<save_to>_rejected``."""
    now = now or tables.utc_now()
    rows = catalogs.build_catalog(feed, as_of, now, profile="adhoc", region=region)
    if not save_to:
        return rows
    stored, rejects = tables.append_catalog(settle(rows), save_to, now)
    if not rejects.isEmpty():
        rejects.write.mode("append").parquet(f"{save_to.rstrip('/')}_rejected")
    return stored


def roll_up(spark: SparkSession, results_path: str, rollup_path: str, writer: str) -> list[date]:
    """Bring the stored rollup up to date with what ``writer`` has stored; returns the days that changed."""
    mine = tables.read(spark, results_path, "results").where(F.col(tables.WRITER) == writer)
    return rollups.update(mine, rollup_path, writer)


def update_rollup(lines: DataFrame, rollup_path: str) -> None:
    """Recompute the daily rollup for the days present in ``lines`` (whole days) and replace just those days."""
    tables.write_days(reports.daily_rollup(lines), rollup_path, "calc_date")
