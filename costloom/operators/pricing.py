"""The best catalog price of every resource.

The catalog is reduced to a *price book* before it meets the resources: one price per kind of lookup, usage type,
item and region. Resources then look their prices up by equality, so no rows multiply and nothing is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from costloom import constants as K
from costloom.functions import rates
from costloom.operators import joins
from costloom.session import settle

# One item of a family prices the whole family; a disk or GPU price does not depend on the usage type.
ANY_USAGE = ""

KINDS = ("compute", "storage", "gpu")
PRICE_COLUMNS = {
    "compute": "compute_price_per_hour",
    "storage": "storage_price_per_gb_month",
    "gpu": "gpu_price_per_hour",
}
# The columns that decide a price, beside the region, and the column it is found in.
COMBINATIONS = {
    "compute": (["_usage", "machine_type", "_family"], "_compute"),
    "storage": (["disk_type"], "_storage"),
    "gpu": (["_gpu"], "_gpu_price"),
}


def lookup_entries(catalog: DataFrame, kinds: Sequence[str], *extra: Column) -> DataFrame:
    """``kind``, ``usage_type``, ``item``, ``region`` that each active price of the given kinds is looked up by; a null
    region is a global price."""
    category = F.col("category")

    def entry(kind: str, wanted: str, usage: Column, item: str) -> Column:
        row = F.struct(F.lit(kind).alias("kind"), usage.alias("usage_type"), F.col(item).alias("item"))
        return F.when((category == wanted) & F.col(item).isNotNull(), row)

    of_kind = {
        "compute": [
            entry("machine", "compute", F.col("usage_type"), "machine_type"),
            entry("family", "compute", F.col("usage_type"), "machine_family"),
        ],
        "storage": [entry("disk", "storage", F.lit(ANY_USAGE), "disk_type")],
        "gpu": [entry("gpu", "gpu", F.lit(ANY_USAGE), "gpu_type")],
    }
    found = F.array_compact(F.array(*(e for kind in kinds for e in of_kind[kind])))
    return (
        catalog.where(F.col("is_active") & (F.col("service_name") == K.COMPUTE_SERVICE_NAME))
        .where(F.col("category").isin(*kinds))
        .select(F.inline(found), "region", *extra)
    )


def price_book(catalog: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(kind, usage_type, item, region, price) of the given kinds, one row per key.

    Among rows of the same key the latest effective date wins, then the smallest sku id.
    """
    rank = F.struct(-F.unix_date("effective_date"), "sku_id", "price_per_unit")
    rows = lookup_entries(catalog, kinds, F.col("price_per_unit"), rank.alias("rank"))
    return rows.groupBy("kind", "usage_type", "item", "region").agg(F.min_by("price_per_unit", "rank").alias("price"))


def price_all(specs: DataFrame, catalog: DataFrame, kinds: Sequence[str] = KINDS, **bounds: int) -> DataFrame:
    """Add the compute, storage and GPU price of each resource, or only the given kinds.

    Exact machine type before family, and regional before global; without a hit, compute and storage fall back to
    estimated rates and a GPU costs nothing.
    """
    book = settle(price_book(catalog, kinds))
    return price_from(specs, book, joins.measure(book), kinds, **bounds)


def price_from(specs: DataFrame, book: DataFrame, size: joins.Size, kinds: Sequence[str] = KINDS, **bounds: int) -> DataFrame:
    """:func:`price_all` with a book that is at hand and was measured; while it is small, no job runs here."""
    found = specs.withColumns(
        {
            "_usage": rates.usage_type_of(F.col("pricing_model")),
            "_family": rates.family_of(F.col("machine_type")),
            "_gpu": F.when(F.col("gpu_count") > 0, F.col("gpu_type")),
        }
    )
    small = size.fits(**bounds)
    for kind in kinds:
        found = _by_broadcast(found, book, kind) if small else _by_combination(found, book, kind, **bounds)
    prices = {
        "compute": F.coalesce("_compute", rates.estimated_compute_rate(F.col("vcpu_count"), F.col("memory_gb"))),
        "storage": F.coalesce("_storage", rates.default_disk_rate(F.col("disk_type"))),
        "gpu": F.coalesce("_gpu_price", F.lit(0.0)),
    }
    added = {PRICE_COLUMNS[kind]: prices[kind] for kind in kinds} | {"memory_price_per_gb_hour": F.lit(0.0)}
    return found.withColumns(added).drop("_usage", "_family", "_gpu", "_compute", "_storage", "_gpu_price")


def _probe(df: DataFrame, book: DataFrame, kind: str, keys: dict[str, str], name: str, hint: bool) -> DataFrame:
    """Add the regional, else the global, price of one kind; ``keys`` maps columns of ``df`` to columns of the book."""
    rows = book.where(F.col("kind") == kind).select(
        *[F.col(source).alias(target) for target, source in keys.items()], "region", "price"
    )
    regional = rows.where("region is not null").withColumnRenamed("price", "_regional")
    everywhere = rows.where("region is null").drop("region").withColumnRenamed("price", "_global")
    if hint:
        regional, everywhere = F.broadcast(regional), F.broadcast(everywhere)
    found = df.join(regional, [*keys, "region"], "left").join(everywhere, list(keys), "left")
    return found.withColumn(name, F.coalesce("_regional", "_global")).drop("_regional", "_global")


def _probe_kind(df: DataFrame, book: DataFrame, kind: str, hint: bool) -> DataFrame:
    if kind == "storage":
        return _probe(df, book, "disk", {"disk_type": "item"}, "_storage", hint)
    if kind == "gpu":
        return _probe(df, book, "gpu", {"_gpu": "item"}, "_gpu_price", hint)
    found = _probe(df, book, "machine", {"_usage": "usage_type", "machine_type": "item"}, "_exact", hint)
    found = _probe(found, book, "family", {"_usage": "usage_type", "_family": "item"}, "_of_family", hint)
    return found.withColumn("_compute", F.coalesce("_exact", "_of_family")).drop("_exact", "_of_family")


def _by_broadcast(df: DataFrame, book: DataFrame, kind: str) -> DataFrame:
    """Hash probes of parts of a book measured to be small; the resources are not shuffled."""
    return _probe_kind(df, book, kind, hint=True)


def _by_combination(df: DataFrame, book: DataFrame, kind: str, **bounds: int) -> DataFrame:
    """For a book too large to broadcast: price each distinct combination once, then look that up.

    Distinct combinations are found with map-side aggregation, so hot combinations cost nothing extra.
    """
    by, name = COMBINATIONS[kind]
    sheet = _probe_kind(df.select(*by, "region").distinct(), book, kind, hint=False)
    priced = settle(sheet.select(*by, "region", name).where(F.col(name).isNotNull()))
    return joins.lookup(df, priced, [*by, "region"], spread_by=["project_id", "resource_id"], **bounds)
