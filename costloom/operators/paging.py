"""Sorted pages, page facts, and pages by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from costloom.session import settle

# Sort orders. The columns at the end make the order total; without them, pages could overlap. Rows that are equal in
# all of a catalog order's columns are copies of one price.
SPEC_ORDER = [("created_at", "desc"), ("resource_id", "asc"), ("project_id", "asc")]
RESULT_ORDER = [("calculation_timestamp", "desc"), ("resource_id", "asc"), ("boq_id", "asc"), ("project_id", "asc")]
CATALOG_ORDER = [
    ("service_name", "asc"), ("category", "asc"), ("sku_name", "asc"), ("sku_id", "asc"), ("effective_date", "asc"),
    ("last_updated", "asc"), ("usage_type", "asc"), ("region", "asc"), ("price_per_unit", "asc"),
]

# A top-k plan keeps offset + size rows in every task, so deeper pages take another way.
TOP_ROWS = 50_000

Order = Sequence[tuple[str, str]]


def page(df: DataFrame, order: Order, number: int, size: int, top_rows: int = TOP_ROWS) -> DataFrame:
    """Page ``number`` (from 1) of the rows in ``order``."""
    offset, behind = page_range(number, size)
    if behind <= top_rows:
        return df.orderBy(*sort_columns(order)).offset(offset).limit(size)
    return _deep_page(df, order, offset, size)


def page_range(number: int, size: int) -> tuple[int, int]:
    """The places (from 0) of a page's first row and of the row behind it."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return (number - 1) * size, number * size


def _deep_page(df: DataFrame, order: Order, offset: int, size: int) -> DataFrame:
    """Sort only the keys, across tasks, find the keys at both ends of the page, and read the rows between them."""
    names = [name for name, _ in order]
    keys = settle(
        df.select(names)
        .orderBy(*sort_columns(order))
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    counts = keys.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("low")).collect()
    rows, before = [], 0
    for part in sorted(counts, key=lambda row: row["_part"]):
        first, last = max(offset - before, 0), min(offset + size - before, part["n"])
        if first < last:
            rows += [part["low"] + first, part["low"] + last - 1]
        before += part["n"]
    if not rows:
        return df.limit(0)
    ends = {row["_row"]: row for row in keys.where(F.col("_row").isin(rows[0], rows[-1])).collect()}
    first, last = ends[rows[0]], ends[rows[-1]]
    # Rows with the very same key as the page's first row, but on the page before.
    tied = keys.where((F.col("_row") < rows[0]) & _at_or_beyond(order, first)).count()
    between = _at_or_beyond(order, first) & ~_beyond(order, last)
    return df.where(between).orderBy(*sort_columns(order)).offset(tied).limit(size)


def page_after(df: DataFrame, order: Order, last: Mapping[str, object] | None, size: int) -> DataFrame:
    """The ``size`` rows after a known row: any depth at the cost of the first page."""
    if last is not None:
        df = df.where(_beyond(order, last))
    return df.orderBy(*sort_columns(order)).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: current page, number of pages, and whether there is a next and a previous one."""
    return page_facts(F.count(F.lit(1)), df, number, size)


def page_facts(total: Column, df: DataFrame, number: int, size: int) -> DataFrame:
    """The facts of a page, where the aggregate ``total`` over ``df`` is the number of rows of the list."""
    page_range(number, size)
    return df.agg(
        F.lit(number).cast("bigint").alias("current_page"),
        F.ceil(total / F.lit(size)).cast("bigint").alias("total_pages"),
        (F.lit(number * size) < total).alias("has_next"),
        F.lit(number > 1).alias("has_prev"),
    )


def sort_columns(order: Order) -> list[Column]:
    return [F.desc(name) if direction == "desc" else F.asc(name) for name, direction in order]


def _beyond(order: Order, row: Mapping[str, object]) -> Column:
    """The row sorts after the given one."""
    beyond, tied = F.lit(False), F.lit(True)
    for name, direction in order:
        step, same = _step(F.col(name), row[name], direction)
        beyond, tied = beyond | (tied & step), tied & same
    return beyond


def _at_or_beyond(order: Order, row: Mapping[str, object]) -> Column:
    same = F.lit(True)
    for name, _ in order:
        same = same & F.col(name).eqNullSafe(F.lit(row[name]))
    return same | _beyond(order, row)


def _step(column: Column, value: object, direction: str) -> tuple[Column, Column]:
    """(row sorts after the value, row ties with it); nulls come first ascending and last descending."""
    if value is None:
        return (column.isNotNull() if direction == "asc" else F.lit(False)), column.isNull()
    if direction == "asc":
        step = column > F.lit(value)
    else:
        step = (column < F.lit(value)) | column.isNull()
    return F.coalesce(step, F.lit(False)), column.eqNullSafe(F.lit(value))
