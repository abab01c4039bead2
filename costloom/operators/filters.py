"""Optional filters. An absent, empty or blank filter lets every row through."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def where_in(df: DataFrame, **lists: Sequence[str] | None) -> DataFrame:
    for column, values in lists.items():
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def where_equal(df: DataFrame, **values: str | None) -> DataFrame:
    for column, value in values.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def filter_specs(
    specs: DataFrame,
    project_ids: Sequence[str] | None = None,
    resource_ids: Sequence[str] | None = None,
    regions: Sequence[str] | None = None,
    pricing_models: Sequence[str] | None = None,
) -> DataFrame:
    return where_in(
        specs, project_id=project_ids, resource_id=resource_ids, region=regions, pricing_model=pricing_models
    )


def filter_catalog(
    catalog: DataFrame, service: str | None = None, category: str | None = None, region: str | None = None
) -> DataFrame:
    """Active rows. A region filter is an equality, so it hides rows without a region."""
    return where_equal(catalog.where("is_active"), service_name=service, category=category, region=region)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def list_specs(specs: DataFrame, **filters: Sequence[str] | None) -> DataFrame:
    return filter_specs(specs, **filters).orderBy("project_id", "resource_id")
