"""Paged lists over the three tables. One filtered DataFrame feeds the page, its facts and the summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from costloom import constants as K
from costloom.operators import filters, paging, reports
from costloom.sources import ordered, tables


@dataclass
class Listing:
    rows: DataFrame
    info: DataFrame
    summary: DataFrame | None = None


def resources(specs: DataFrame, project: str | None = None, region: str | None = None, number: int = 1) -> Listing:
    """Resources, newest first."""
    chosen = filters.where_equal(specs, project_id=project, region=region)
    return _listing(chosen, paging.SPEC_ORDER, number, K.RESOURCE_PAGE_SIZE)


def results(lines: DataFrame, boq_id: str | None = None, project: str | None = None, number: int = 1) -> Listing:
    """The lines of one run with their summary, or the recent lines, optionally of one project. Newest first."""
    if boq_id:
        listing = _listing(
            filters.where_equal(lines, boq_id=boq_id), paging.RESULT_ORDER, number, K.RESULT_PAGE_SIZE
        )
        listing.summary = reports.boq_summary_by_id(lines, boq_id)
        return listing
    chosen = filters.where_equal(lines, project_id=project)
    return _listing(chosen, paging.RESULT_ORDER, number, K.RESULT_PAGE_SIZE)


def run_results(spark: SparkSession, path: str, boq_id: str, number: int = 1) -> Listing:
    """The lines of one stored run with their summary, from the folders that the register names alone."""
    lines = tables.run_lines(spark, path, boq_id)
    listing = _listing(lines, paging.RESULT_ORDER, number, K.RESULT_PAGE_SIZE)
    listing.summary = reports.boq_summary_by_id(lines, boq_id)
    return listing


def prices(
    catalog: DataFrame,
    service: str | None = None,
    category: str | None = None,
    region: str | None = None,
    number: int = 1,
) -> Listing:
    """Active catalog rows by service, category and name."""
    chosen = filters.filter_catalog(catalog, service, category, region)
    return _listing(chosen, paging.CATALOG_ORDER, number, K.CATALOG_PAGE_SIZE)


def stored_resources(spark: SparkSession, folder: str, number: int = 1) -> Listing:
    """A page of resources out of a list that :func:`store_resources` has stored: any depth from one state."""
    size = K.RESOURCE_PAGE_SIZE
    return Listing(ordered.page(spark, folder, number, size), ordered.page_info(spark, folder, number, size))


def store_resources(specs: DataFrame, path: str, project: str | None = None, region: str | None = None) -> str:
    """Store the list that :func:`resources` pages through and return its folder."""
    return ordered.store(filters.where_equal(specs, project_id=project, region=region), path, paging.SPEC_ORDER)


def choices(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The projects and regions a calculation can be limited to."""
    return filters.distinct_values(specs, "project_id"), filters.distinct_values(specs, "region")


def _listing(chosen: DataFrame, order: paging.Order, number: int, size: int) -> Listing:
    return Listing(paging.page(chosen, order, number, size), paging.page_info(chosen, number, size))
