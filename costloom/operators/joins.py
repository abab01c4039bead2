"""Lookup joins of a large table with a keyed table, safe for hot keys and for a lookup side of any size."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from costloom.session import settle

# A lookup table is broadcast only when it is measured to be within both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
# Beyond them, a key with more rows than this is hot. There are at most rows / HOT_ROWS such keys.
HOT_ROWS = 1_000_000


class Size(NamedTuple):
    rows: int
    bytes: int

    def fits(self, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
        return self.rows <= max_rows and self.bytes <= max_bytes


def measure(df: DataFrame) -> Size:
    """Rows and text bytes, in one pass with partial aggregation. A table not settled is computed twice."""
    width = sum((_text_bytes(f) for f in df.schema), F.lit(16 * len(df.columns)))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width.cast("bigint"))).first()
    return Size(rows, size or 0)


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
    **bounds: int,
) -> DataFrame:
    """Join ``df`` with a settled table that holds few rows per key.

    A small table is broadcast and ``df`` is not shuffled. A large one is joined by one shuffle. Only hot keys, found
    by counting with map-side combine, are cut into slices of about ``hot_rows`` rows, and only their rows of the table
    are repeated: at most hot keys times slices. Adaptive execution splits what is still uneven.
    """
    if measure(table).fits(**bounds):
        return df.join(F.broadcast(table), list(on), how)
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = settle(counts.select(*on, F.ceil(F.col("n") / F.lit(hot_rows)).cast("int").alias("_slices")))
    if hot.isEmpty():
        return df.join(table, list(on), how)
    # The hot keys are joined by a broadcast only while they are few; each stands for more than hot_rows rows.
    keys = F.broadcast(hot) if measure(hot).fits() else hot
    slice_of = F.pmod(F.xxhash64(*(spread_by or df.columns)), F.coalesce("_slices", F.lit(1))).cast("int")
    spread = df.join(keys, list(on), "left").withColumn("_slice", slice_of).drop("_slices")
    sliced = table.join(keys, list(on), "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    )
    return spread.join(sliced.drop("_slices"), [*on, "_slice"], how).drop("_slice")


def _text_bytes(field: StructField) -> Column:
    if isinstance(field.dataType, StringType):
        return F.coalesce(F.octet_length(field.name), F.lit(0))
    if isinstance(field.dataType, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0))
    return F.lit(0)
