"""The price feed, read from dumped JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costloom import schemas


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per line, any number of files. The schema is declared, so nothing is inferred."""
    return spark.read.schema(schemas.RAW_SKU).json(path)


def stream_feed(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return _file_stream(spark, schemas.RAW_SKU, path, files_per_trigger)


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return _file_stream(spark, schemas.REQUEST, path, files_per_trigger)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Result lines as their Parquet files arrive; columns that the files leave out are null."""
    return _file_stream(spark, schemas.RESULTS, path, files_per_trigger, "parquet")


def _file_stream(spark, schema, path, files_per_trigger, form="json"):
    reader = spark.readStream.schema(schema).format(form)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
