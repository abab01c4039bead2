"""Many calculation requests against the resources, in one pass over the resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costloom.functions import cases
from costloom.operators import joins
from costloom.operators.costing import cost_lines
from costloom.operators.pricing import price_all
from costloom.session import settle

# Request lists and the resource column each one filters, the most selective first.
FILTERS = {
    "resource_ids": "resource_id",
    "project_ids": "project_id",
    "regions": "region",
    "pricing_models": "pricing_model",
}
EVERYTHING = "*"


def match_requests(specs: DataFrame, requests: DataFrame, **bounds: int) -> DataFrame:
    """One row per request and resource that passes its filters.

    Each request is joined by equality on its most selective list; its other lists are checked on the matches. A
    request without any list selects every resource, through a key that all resources share.
    """

    def scope(dimension: str, values: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), values.alias("values"))

    scopes = [
        (_given(name), scope(column, F.array_distinct(F.array_compact(name)))) for name, column in FILTERS.items()
    ]
    everything = scope(EVERYTHING, F.array(F.lit(EVERYTHING)))
    dimension = F.col("scope.dimension")
    # A list that has become join values is not carried along, or a list of n values would be stored n times.
    others = [F.when(dimension != column, F.col(name)).alias(f"_{name}") for name, column in FILTERS.items()]
    wanted = settle(
        requests.withColumn("scope", cases(scopes, everything)).select(
            "boq_id",
            "requested_by",
            "requested_at",
            *others,
            dimension.alias("_dimension"),
            F.explode("scope.values").alias("_value"),
        )
    )
    # At most one dimension per filter and one for everything.
    dimensions = sorted(row[0] for row in wanted.select("_dimension").distinct().collect())
    if not dimensions:
        dimensions = [EVERYTHING]
    keys = [
        F.struct(
            F.lit(name).alias("_dimension"),
            (F.lit(EVERYTHING) if name == EVERYTHING else F.col(name)).alias("_value"),
        )
        for name in dimensions
    ]
    own = [name for name in specs.columns if name not in ("boq_id", "requested_by", "requested_at")]
    keyed = specs.select(*own, F.inline(F.array(*keys)))
    matched = joins.lookup(
        keyed, wanted, ["_dimension", "_value"], "inner", spread_by=["project_id", "resource_id"], **bounds
    )
    for name, column in FILTERS.items():
        matched = matched.where(~_given(f"_{name}") | F.array_contains(f"_{name}", F.col(column)))
    return matched.select(*own, "boq_id", "requested_by", "requested_at")


def boq_for_requests(specs: DataFrame, catalog: DataFrame, requests: DataFrame, **bounds: int) -> DataFrame:
    """The lines of all requests. Resources are priced once, before requests multiply them."""
    priced = price_all(specs, catalog, **bounds)
    matched = match_requests(priced, requests, **bounds)
    return cost_lines(matched, F.col("boq_id"), F.col("requested_at"), F.col("requested_by"))


def _given(name: str) -> Column:
    return F.coalesce(F.size(F.array_compact(name)) > 0, F.lit(False))
