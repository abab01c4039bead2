"""Rows dealt over the files of a day by their cluster columns, so that filters on any of them skip files.

A key interleaves the bits of one small number per column: the range of the column's values that the row's value lies in.
Rows sorted by it lie near each other if they are alike in all columns, so every file spans few ranges of each column, not
only of the first. Files are ranges of (day, key, cluster columns); a key that holds much of the data is cut further
by the columns themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from costloom import schemas

BITS = 6  # of each column's range number: 64 ranges
KEY = "_cluster"


def bounds(df: DataFrame, column: str, bits: int = BITS) -> list:
    """At most ``2 ** bits`` values, ascending, at which the ranges of a column's distinct values begin.

    Distinct values are found with map-side combine and dealt out into ranges of about the same number of values.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    ranges = values.repartitionByRange(2**bits, "value").withColumn("part", F.spark_partition_id())
    starts = ranges.groupBy("part").agg(F.min("value").alias("start")).collect()  # a row for each range
    return sorted(row["start"] for row in starts)


def cluster_key(ranges: dict[str, list], bits: int = BITS) -> Column:
    """The interleaved range numbers, the highest bits of all columns first. Null lies before all ranges."""
    key = F.lit(0).cast("bigint")
    numbers = [_range_number(column, starts, bits) for column, starts in ranges.items()]
    place = bits * len(numbers)
    for bit in reversed(range(bits)):
        for number in numbers:
            place -= 1
            one = F.shiftright(number, bit).bitwiseAND(F.lit(1).cast("bigint"))
            key = key.bitwiseOR(F.shiftleft(one, place))
    return key


def _range_number(column: str, starts: list, bits: int) -> Column:
    """The number of the range that the value lies in, found by halving. Numbers of a column with few ranges are spread
    over all bits, or its bits would come after those of a column with many."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low * 2**bits // max(len(starts), 1)).cast("bigint")
        middle = (low + high + 1) // 2
        return F.when(F.col(column) >= F.lit(starts[middle]), search(middle, high)).otherwise(search(low, middle - 1))

    return search(0, max(len(starts) - 1, 0))


def clustered(df: DataFrame, table: str, files: int, columns: Sequence[str] | None = None, bits: int = BITS) -> DataFrame:
    """Deal rows with their partition day out to ``files`` tasks by day and cluster key, sorted by it.

    ``files`` is the number of files over all days; a day gets a share by its rows. Ranges are found by sampling, so a
    day or key of any size spreads over as many tasks as its share.
    """
    day, order = schemas.LAYOUT[table]
    columns = list(columns or order)
    ranges = {column: bounds(df, column, bits) for column in columns}
    keyed = df.withColumn(KEY, cluster_key(ranges, bits))
    dealt = keyed.repartitionByRange(files, day, KEY, *order)
    return dealt.sortWithinPartitions(day, KEY, *order).drop(KEY)
