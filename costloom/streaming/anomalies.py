"""Cost anomalies among lines as they arrive, each judged by what came before it.

The moments of every project (number of lines, exact sums of costs and of their squares) are kept as one small table per
micro-batch, which stands for all lines up to that batch. A batch reads the moments of the batch before, flags its
lines by them, and stores the sum of those moments and its own. Both outputs have folders of the batch's own, so a batch
that runs again replaces them with the same rows; moments are deleted once two newer batches have theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from costloom.operators import reports
from costloom.session import settle
from costloom.sources import tables
from costloom.streaming.jobs import batch_key, beside, stream_id

BATCH = "batch"


def moments(spark: SparkSession, path: str, before: int, stream: str = "") -> DataFrame:
    """The moments of all lines of the stream's batches below ``before``; none before the first batch."""
    done = [number for number in _batches(spark, path, stream) if number < before]
    if not done:
        return spark.createDataFrame([], reports.MOMENTS)
    return spark.read.schema(reports.MOMENTS).parquet(_place(path, stream, max(done)))


def anomaly_batch(lines: DataFrame, batch_id: int, path: str, sigmas: float = 3.0, stream: str = "") -> None:
    """Flag the lines of one micro-batch below ``path`` and store the moments of all lines so far.

    Flagged lines have the ``cost_limit`` that they passed: mean plus ``sigmas`` standard deviations of the lines of
    their project in earlier batches. Lines of projects with fewer than two such lines are not flagged.
    """
    spark = lines.sparkSession
    known = settle(moments(spark, path, batch_id, stream))
    limits = settle(reports.cost_limits(known, sigmas))
    beside(reports.above_limit(lines, limits), path, batch_key(batch_id, stream))
    total = reports.added_moments(known.unionByName(reports.cost_moments(lines)))
    total.write.mode("overwrite").parquet(_place(path, stream, batch_id))
    for number in _batches(spark, path, stream):
        if number < batch_id - 1:
            tables.delete(spark, _place(path, stream, number))


def start_anomalies(lines: DataFrame, path: str, checkpoint: str, sigmas: float = 3.0) -> StreamingQuery:
    """Judge streamed lines as they arrive; stops when all waiting lines are done."""
    stream = stream_id(lines.sparkSession, checkpoint)
    return (
        lines.writeStream.foreachBatch(lambda batch, batch_id: anomaly_batch(batch, batch_id, path, sigmas, stream))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def flagged(spark: SparkSession, path: str) -> DataFrame:
    """All lines flagged so far, with the limit each has passed."""
    return spark.read.parquet(path)


def _place(path: str, stream: str, batch_id: int) -> str:
    return f"{_root(path, stream)}/{BATCH}={batch_id}"


def _root(path: str, stream: str) -> str:
    return f"{path.rstrip('/')}_moments/stream={stream}"


def _batches(spark: SparkSession, path: str, stream: str) -> list[int]:
    """Batches whose moments are complete: a write that died has left no success mark."""
    found = []
    for name in tables.names(spark, _root(path, stream)):
        if tables.exists(spark, f"{_root(path, stream)}/{name}/_SUCCESS"):
            found.append(int(name.removeprefix(f"{BATCH}=")))
    return sorted(found)
