"""Event-driven forms of the jobs. Each micro-batch runs the batch operators and writes under a key made of the
stream's id and the batch id, so a batch that is run again replaces or skips its own output and adds no rows. The id
is kept in the checkpoint folder: a stream with a new checkpoint is another stream and touches nothing of the old."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from costloom.operators import quality
from costloom.operators.requests import boq_for_requests, match_requests
from costloom.plans import jobs
from costloom.session import settle
from costloom.sources import feed, tables


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream with this checkpoint, made when it first starts."""
    return _remembered(spark, f"{checkpoint.rstrip('/')}/_stream", uuid.uuid4().hex)


def _remembered(spark: SparkSession, file: str, value: str) -> str:
    """The text of a small file, which is created with ``value`` if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        draft = path.suffix(f".{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(value.encode()))
        out.close()
        files.rename(draft, path)
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def batch_key(batch_id: int, stream: str) -> str:
    return f"{stream}-{batch_id}" if stream else str(batch_id)


def refresh_batch(
    batch: DataFrame, batch_id: int, catalog_path: str, as_of: date, now: datetime | None = None, stream: str = ""
) -> None:
    """Refresh the latest snapshot from one micro-batch, unless a finished snapshot has this batch's key.

    A batch without a usable price is recorded by a snapshot equal to the latest, and the stream goes on. Rejected
    prices are kept below ``<catalog_path>_rejected``.
    """
    spark, key = batch.sparkSession, f"stream {batch_key(batch_id, stream)}"
    if key in tables.snapshot_keys(spark, catalog_path):
        return
    try:
        rejects = jobs.refresh_catalog(batch, catalog_path, as_of, now, key=key).rejects
    except jobs.EmptyFeed:
        tables.carry_forward(spark, catalog_path, key)
        return
    if not rejects.isEmpty():
        beside(rejects, f"{catalog_path.rstrip('/')}_rejected", batch_key(batch_id, stream))


def beside(rows: DataFrame, path: str, key: str) -> None:
    """Store rows in the folder of a batch's key, in place of what the batch has stored before."""
    rows.write.mode("overwrite").parquet(f"{path}/{tables.WRITER}={key}")


def start_refresh(
    spark: SparkSession,
    feed_path: str,
    catalog_path: str,
    checkpoint: str,
    as_of: Callable[[int], date] | None = None,
    files_per_trigger: int | None = None,
    now: datetime | None = None,
) -> StreamingQuery:
    """Refresh the catalog from feed files as they arrive; stops when all waiting files are done.

    By default all waiting files make one refresh dated today. ``as_of`` gives the date of a batch id instead.
    """

    stream = stream_id(spark, checkpoint)

    def run(batch: DataFrame, batch_id: int) -> None:
        day = as_of(batch_id) if as_of else tables.utc_now().date()
        refresh_batch(batch, batch_id, catalog_path, day, now, stream)

    return (
        feed.stream_feed(spark, feed_path, files_per_trigger)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def boq_batch(
    batch: DataFrame, batch_id: int, specs: DataFrame, catalog: DataFrame, results_path: str, stream: str = ""
) -> None:
    """Calculate all requests of one micro-batch and replace the lines stored under this batch's key.

    Lines go to the table that runs write to as well. Resources without a required column are not priced; those that a
    request asked for are kept below ``<results_path>_rejected``, and requests without any line below
    ``<results_path>_unmatched``. A request without an id, or without a time, gets one that is the same when the batch
    runs again.
    """
    spark, key, root = batch.sparkSession, batch_key(batch_id, stream), results_path.rstrip("/")
    began = _remembered(spark, f"{root}_started/{key}", tables.utc_now().isoformat())
    own_id = F.concat(F.lit(f"batch-{key}-"), F.md5(F.to_json(F.struct("*"))))
    named = settle(
        batch.withColumns(
            {
                "boq_id": F.coalesce("boq_id", own_id),
                "requested_at": F.coalesce("requested_at", F.lit(datetime.fromisoformat(began))),
            }
        )
    )
    valid, broken = quality.split_valid(specs, "specs")
    tables.append_lines(boq_for_requests(valid, catalog, named), root, key, many_days=True)
    written = tables.read(spark, root, "results").where(F.col(tables.WRITER) == key).select("boq_id").distinct()
    beside(named.join(written, "boq_id", "left_anti"), f"{root}_unmatched", key)
    beside(match_requests(broken, named), f"{root}_rejected", key)


def start_boq(
    spark: SparkSession,
    requests_path: str,
    specs: Callable[[], DataFrame],
    catalog: Callable[[], DataFrame],
    results_path: str,
    checkpoint: str,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Answer request files as they arrive; stops when all waiting files are done.

    ``specs`` and ``catalog`` are read anew for each batch, so a running stream sees new resources and snapshots.
    """

    stream = stream_id(spark, checkpoint)

    def run(batch: DataFrame, batch_id: int) -> None:
        boq_batch(batch, batch_id, specs(), catalog(), results_path, stream)

    return (
        feed.stream_requests(spark, requests_path, files_per_trigger)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
