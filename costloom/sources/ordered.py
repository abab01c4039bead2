"""A list stored in its order, from which any page is one lookup and one range read.

``store`` sorts a list once, over ranges, and writes each range as a folder of its own with the row's place in it, beside
a small table of the ranges: where each begins in the list and how many rows it has. A page names its ranges from that
table, one row for each task of the sort, and reads only these folders; inside them, row groups and pages of the files
are skipped by the statistics of the place. All pages come from the one state of the list that was stored, whatever
happens to its source in between, so pages joined up are the list.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from costloom.operators import paging
from costloom.sources import tables

PART, PLACE = "_part", "_place"
BOUNDS = f"{PART} int, first bigint, rows bigint"


def store(df: DataFrame, path: str, order: paging.Order) -> str:
    """Store the list in ``order`` below ``path`` and return the folder that pages are read from.

    Every call makes a folder of its own, so readers of an older list are left alone. Rows equal in all columns of
    ``order`` keep the places they are given here.
    """
    spark, folder = df.sparkSession, f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    # The number of a row starts anew in each task and counts up in the task's order.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.orderBy(*paging.sort_columns(order)).withColumns({PART: F.spark_partition_id(), PLACE: number})
    placed.write.partitionBy(PART).parquet(f"{folder}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{folder}/rows")
    sizes = stored.groupBy(PART).agg(F.count(F.lit(1)).alias("rows")).collect()  # a row for each task of the sort
    bounds, first = [], 0
    for part, rows in sorted(tuple(size) for size in sizes):
        bounds.append((part, first, rows))
        first += rows
    spark.createDataFrame([], placed.schema).write.parquet(f"{folder}/like")  # an empty list has no other file
    spark.createDataFrame(bounds, BOUNDS).coalesce(1).write.parquet(f"{folder}/bounds")
    return folder


def page(spark: SparkSession, folder: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a stored list, in its order; a page behind the end has no rows."""
    first, behind = paging.page_range(number, size)
    return rows_between(spark, folder, first, behind)


def rows_between(spark: SparkSession, folder: str, first: int, behind: int) -> DataFrame:
    """The rows from place ``first`` (from 0) to before place ``behind`` of the whole list, in its order."""
    hit = (F.col("first") < behind) & (F.col("first") + F.col("rows") > first)
    ranges = _bounds(spark, folder).where(hit).collect()
    like = spark.read.parquet(f"{folder}/like")
    rows = spark.read.schema(like.schema).parquet(f"{folder}/rows") if ranges else like
    wanted = F.lit(False)
    for part, start, count in sorted(tuple(found) for found in ranges):
        low, high = max(first - start, 0), min(behind - start, count)
        here = F.col(PART) == part
        # A range that is wanted whole needs no test of places.
        wanted |= here if (low, high) == (0, count) else here & (F.col(PLACE) >= low) & (F.col(PLACE) < high)
    return rows.where(wanted).orderBy(PART, PLACE).drop(PART, PLACE)


def page_info(spark: SparkSession, folder: str, number: int, size: int) -> DataFrame:
    """One row like :func:`costloom.operators.paging.page_info`, from the table of ranges alone."""
    return paging.page_facts(F.coalesce(F.sum("rows"), F.lit(0)), _bounds(spark, folder), number, size)


def _bounds(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BOUNDS).parquet(f"{folder}/bounds")


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a stored list that nobody reads any more."""
    tables.delete(spark, folder)
