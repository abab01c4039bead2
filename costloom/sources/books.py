"""Price books stored per catalog state, in a folder for each.

The size of a book is part of the name of an empty file beside its rows, so whoever prices with it need not count first.
"""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from costloom.operators import best_prices, joins
from costloom.session import settle
from costloom.sources import tables

_SIZE = "_size-"


class Book(NamedTuple):
    rows: DataFrame  # see best_prices
    size: joins.Size  # of the prices looked up

    @property
    def prices(self) -> DataFrame:
        return best_prices.prices(self.rows)


def place(path: str, state: int) -> str:
    return f"{path.rstrip('/')}/state={state}"


def write(book: DataFrame, path: str, state: int) -> None:
    """Store the book of a state, by key, so that one kind is in few files; a state that exists is replaced."""
    folder, book = place(path, state), settle(book)
    size = joins.measure(best_prices.prices(book))
    book.repartitionByRange(*best_prices.KEYS).sortWithinPartitions(*best_prices.KEYS).write.mode("overwrite").parquet(folder)
    tables.mark(book.sparkSession, f"{folder}/{_SIZE}{size.rows}-{size.bytes}")


def read(spark: SparkSession, path: str, state: int) -> Book:
    """The book of a state; no job runs."""
    folder = place(path, state)
    names = [name for name in tables.names(spark, folder) if name.startswith(_SIZE)]
    if not names:
        raise LookupError(f"no price book of state {state} below {path}")
    rows, size = names[0][len(_SIZE) :].split("-")
    return Book(spark.read.schema(best_prices.BOOK).parquet(folder), joins.Size(int(rows), int(size)))


def follow(
    spark: SparkSession,
    path: str,
    state: int,
    new_state: int,
    catalog: DataFrame,
    added: DataFrame | None = None,
    retired: DataFrame | None = None,
    retired_before: date | None = None,
) -> Book:
    """Store the book of ``new_state`` from that of ``state``: prices ``retired`` (catalog rows as they were, or all of days
    before a date) go, ``added`` ones come. ``catalog``, as it is now, is only read for keys whose list has gone."""
    book = read(spark, path, state).rows
    if retired_before is not None:
        book = best_prices.retire_before(book, retired_before)
    gone = None if retired is None else best_prices.entries(retired.withColumn("is_active", F.lit(True)))
    new = None if added is None else best_prices.entries(added)
    book = settle(best_prices.advance(book, new, gone))
    if not book.where("size(best) = 0").isEmpty():
        book = best_prices.refill(book, catalog)
    write(book, path, new_state)
    return read(spark, path, new_state)
