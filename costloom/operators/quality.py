"""Column defaults and required columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from costloom import schemas


def apply_defaults(df: DataFrame, table: str, now: datetime) -> DataFrame:
    """Bring rows to the declared schema. A column that is absent gets its default; an explicit null stays."""
    defaults = schemas.defaults(table, now)
    present = set(df.columns)
    declared = schemas.SCHEMAS[table]
    extra = [name for name in df.columns if name not in declared.names]
    return df.select(
        [
            (F.col(f.name) if f.name in present else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in declared
        ]
        + extra
    )


def with_missing(df: DataFrame, table: str) -> DataFrame:
    """Add ``missing_columns``: the required columns that are null in the row."""
    names = [F.when(F.col(name).isNull(), F.lit(name)) for name in schemas.REQUIRED[table]]
    return df.withColumn("missing_columns", F.array_compact(F.array(*names)))


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``missing_columns``)."""
    required = schemas.REQUIRED[table]
    valid = df.dropna(subset=required)
    rejects = with_missing(df, table).where(F.size("missing_columns") > 0)
    return valid, rejects
