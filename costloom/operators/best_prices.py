"""The best few prices of every lookup key, kept up to date as prices come and go.

A book has one row per (kind, usage type, item, region): ``best``, its ``KEPT`` best prices in order, and ``more``, whether
there may be others behind them. Retiring the winner promotes the next one without reading the catalog; only a key whose
whole list has gone while there may be more is filled again from the catalog.

Prices of one key with the same day, SKU and price are one entry, and go together.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom.operators.pricing import KINDS, lookup_entries

KEPT = 4
KEYS = ["kind", "usage_type", "item", "region"]
# Prices sort by their fields: the latest day first, then the least SKU id.
ENTRY = "struct<day:int,sku_id:string,price:double>"
BOOK = f"kind string, usage_type string, item string, region string, best array<{ENTRY}>, more boolean"


def entries(catalog: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """The keys that each active price is looked up by, with the price as an ``entry`` that sorts by rank."""
    entry = F.struct((-F.unix_date("effective_date")).alias("day"), "sku_id", F.col("price_per_unit").alias("price"))
    return lookup_entries(catalog, kinds, entry.cast(ENTRY).alias("entry"))


def build(catalog: DataFrame, kinds: Sequence[str] = KINDS, kept: int = KEPT) -> DataFrame:
    """The book of a catalog."""
    return _listed(entries(catalog, kinds), kept).select(
        *KEYS, F.slice("found", 1, kept).alias("best"), (F.size("found") > kept).alias("more")
    )


def _listed(rows: DataFrame, kept: int) -> DataFrame:
    """``found``: the first ``kept + 1`` different entries of each key, in order.

    Ranked rows are cut inside tasks before they are shuffled, so a key of very many prices costs no more than others.
    """
    place = F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("entry"))
    few = rows.distinct().withColumn("place", place).where(F.col("place") <= kept + 1)
    return few.groupBy(*KEYS).agg(F.sort_array(F.collect_list("entry")).alias("found"))


def advance(book: DataFrame, added: DataFrame | None = None, retired: DataFrame | None = None, kept: int = KEPT) -> DataFrame:
    """The book after prices have come and gone, both given as rows of :func:`entries`.

    A key with an empty list and ``more`` needs :func:`refill`. Only retired prices that stand in a list are joined.
    """
    rows = book.select(*KEYS, "best", "more")
    if retired is not None:
        listed = rows.select(*KEYS, F.explode("best").alias("entry"))
        gone = listed.intersect(retired.select(*KEYS, "entry")).groupBy(*KEYS).agg(F.collect_list("entry").alias("gone"))
        rows = _matched(rows, gone, "gone", "left")
        rows = rows.withColumn("best", F.array_except("best", F.coalesce("gone", _none()))).drop("gone")
    if added is not None:
        rows = _matched(rows, _listed(added, kept), "found", "full")
        best, found, more = F.coalesce("best", _none()), F.coalesce("found", _none()), F.coalesce("more", F.lit(False))
        # Behind the list there may be better prices than a new one that does not beat its last entry.
        last = F.get(best, F.size(best) - 1)
        fits = F.when(~more, found).when(F.size(best) == 0, _none()).otherwise(F.filter(found, lambda e: e <= last))
        merged = F.sort_array(F.array_union(best, fits))
        rows = rows.select(
            *KEYS, F.slice(merged, 1, kept).alias("best"), (more | (F.size(merged) > kept) | (F.size(found) > F.size(fits))).alias("more")
        )
    return rows.where("more or size(best) > 0")


def retire_before(book: DataFrame, as_of: date) -> DataFrame:
    """The book after all prices of days before ``as_of`` have gone. Entries behind a list are no younger than its last,
    so a list that loses an entry has none behind it, and nothing is filled again."""
    oldest = -F.unix_date(F.lit(as_of))
    left = F.filter("best", lambda e: e["day"].isNull() | (e["day"] <= oldest))
    return book.select(*KEYS, left.alias("best"), (F.col("more") & (F.size(left) == F.size("best"))).alias("more")).where("size(best) > 0")


def refill(book: DataFrame, catalog: DataFrame, kinds: Sequence[str] = KINDS, kept: int = KEPT) -> DataFrame:
    """Fill the keys whose list has gone from the catalog as it is now; the others are not looked up."""
    empty = book.where("size(best) = 0").select(*KEYS)
    wanted = _matched(entries(catalog, kinds), empty.withColumn("wanted", F.lit(True)), "wanted", "inner").drop("wanted")
    filled = _listed(wanted, kept).select(*KEYS, F.slice("found", 1, kept).alias("best"), (F.size("found") > kept).alias("more"))
    return book.where("size(best) > 0").unionByName(filled)


def prices(book: DataFrame) -> DataFrame:
    """The price book that lookups read: the first entry of every list."""
    return book.where("size(best) > 0").select(*KEYS, F.col("best")[0]["price"].alias("price"))


def _none() -> Column:
    return F.array().cast(f"array<{ENTRY}>")


def _matched(left: DataFrame, right: DataFrame, name: str, how: str) -> DataFrame:
    """Join on all keys, null regions with null regions; ``right`` brings ``name`` only."""
    other = right.select(*(F.col(k).alias(f"_{k}") for k in KEYS), name)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    found = left.join(other, same, how)
    if how == "full":
        here = F.col("best").isNotNull()
        keys = [F.when(here, F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in KEYS]
        return found.select(*keys, *(c for c in left.columns if c not in KEYS), name)
    return found.select(*left.columns, name)
