"""The three tables as date-partitioned Parquet.

Results and specs are appended. Lines of one writer (a run, or a batch of a stream) lie in a folder of their own below
each day, which the same writer replaces when it runs again. The catalog also sees updates and deletes, which plain
Parquet has not: it is kept as numbered snapshots. A writer claims a number by creating a file, writes only new or
changed days below ``v=<number>``, and then names all folders of the snapshot, its own and those it takes over from the
one before, in a manifest that appears by a rename. Readers follow the latest manifest, so they never see half a
change; a writer that died leaves a claimed number and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from costloom import schemas
from costloom.functions import utc_day
from costloom.operators import quality
from costloom.session import settle
from costloom.sources import clustering

WRITER = "write_id"  # inner partition of the results
RUN_BUCKET, RUN_BUCKETS = "bucket", 64  # folders of the register of runs
# Row groups without a run are skipped by its id: by their dictionary, or by a filter where there are too many ids.
RUN_FILTER = {"parquet.bloom.filter.enabled#boq_id": "true", "parquet.bloom.filter.expected.ndv#boq_id": "100000"}
DERIVED_DATES = {"specs": "created_at", "results": "calculation_timestamp"}


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def lay_out(df: DataFrame, table: str, many_days: bool = False) -> DataFrame:
    """Add the partition date and sort rows inside each task.

    Rows of one day are written where they are, without a shuffle. With many days, rows are first regrouped by
    day; the adaptive rebalance splits a day that holds much of the data and merges small ones.
    """
    day, order = schemas.LAYOUT[table]
    if table in DERIVED_DATES:
        df = df.withColumn(day, utc_day(F.col(DERIVED_DATES[table]).cast("timestamp")))
    if many_days:
        df = df.hint("rebalance", day)
    return df.sortWithinPartitions(day, *order)


def append(df: DataFrame, path: str, table: str, many_days: bool = False, now: datetime | None = None) -> DataFrame:
    """Append the valid rows and return the rejected ones, with the names of their missing columns."""
    valid, rejects = quality.split_valid(_declared(df, table, now), table)
    _write(lay_out(valid, table, many_days), path, table, "append")
    return rejects


def append_lines(
    lines: DataFrame, path: str, write_id: str, many_days: bool = False, now: datetime | None = None
) -> None:
    """Add result lines of valid resources; all lines that ``write_id`` has stored before are replaced, on whatever day
    they lie, also when there are none now.

    Such lines are complete by construction. Testing the computed costs for null would calculate them twice.
    """
    rows = lay_out(_declared(lines, "results", now), "results", many_days).withColumn(WRITER, F.lit(write_id))
    day, _ = schemas.LAYOUT["results"]
    spark = lines.sparkSession
    before = {folder: set(names(spark, folder)) for folder in _writer_folders(spark, path, write_id)}
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, WRITER)
    for option, value in RUN_FILTER.items():
        writer = writer.option(option, value)
    writer.parquet(path)
    for folder, files in before.items():  # the write has put other files into the folders of its own days
        if set(names(spark, folder)) == files:
            delete(spark, folder)
    _register(spark, path, write_id, _writer_folders(spark, path, write_id))


def run_lines(spark: SparkSession, path: str, boq_id: str) -> DataFrame:
    """The lines of one run. The register names the folders that hold them, so no other folder is listed or opened;
    inside these, files and row groups without the run are skipped by their filters on ``boq_id``."""
    root = path.rstrip("/")
    places = run_register(spark, root, boq_id).collect()  # one row per day and writer of the run
    schema = _with_day("results").add(WRITER, "string")
    if not places:
        return spark.createDataFrame([], schema)
    folders = sorted({row["folder"] for row in places})
    rows = spark.read.schema(schema).option("basePath", root).parquet(*(f"{root}/{folder}" for folder in folders))
    return rows.where(F.col("boq_id") == boq_id)


def run_register(spark: SparkSession, path: str, boq_id: str | None = None) -> DataFrame:
    """``boq_id``, ``folder`` and ``lines`` of all runs, or of one, which reads a single bucket."""
    place = f"{path.rstrip('/')}_runs"
    fields = f"boq_id string, folder string, lines bigint, {RUN_BUCKET} int, {WRITER} string"
    if not exists(spark, place):
        return spark.createDataFrame([], fields)
    rows = spark.read.schema(fields).parquet(place)
    if boq_id is None:
        return rows
    return rows.where((F.col(RUN_BUCKET) == _bucket(F.lit(boq_id))) & (F.col("boq_id") == boq_id))


def _bucket(boq_id: Column) -> Column:
    return F.pmod(F.xxhash64(boq_id), F.lit(RUN_BUCKETS)).cast("int")


def _register(spark: SparkSession, path: str, write_id: str, folders: list[str]) -> None:
    """Note which runs lie in a writer's folders, in place of what was noted for this writer before."""
    root = path.rstrip("/")
    place = f"{root}_runs"
    files, base = _files(spark, place)
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(write_id)
    old = files.globStatus(_child(spark, base, f"{RUN_BUCKET}=*/{WRITER}={name}")) if files.exists(base) else []
    for entry in old or []:
        files.delete(entry.getPath(), True)
    if not folders:
        return
    day, _ = schemas.LAYOUT["results"]
    rows = spark.read.schema(_with_day("results").add(WRITER, "string")).option("basePath", root).parquet(*folders)
    folder = F.regexp_extract(F.input_file_name(), f"({day}=[^/]*/{WRITER}=[^/]*)/[^/]*$", 1)
    # A file's name is given as an address, in which the marks of a folder's name are escaped once more.
    folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    runs = rows.select("boq_id", folder.alias("folder")).groupBy("boq_id", "folder").agg(F.count(F.lit(1)).alias("lines"))
    runs = runs.withColumns({RUN_BUCKET: _bucket(F.col("boq_id")), WRITER: F.lit(write_id)})
    runs.hint("rebalance", RUN_BUCKET).write.mode("append").partitionBy(RUN_BUCKET, WRITER).parquet(place)


def _writer_folders(spark: SparkSession, path: str, write_id: str) -> list[str]:
    """The folders of a writer, one per day."""
    day, _ = schemas.LAYOUT["results"]
    files, root = _files(spark, path)
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(write_id)
    found = files.globStatus(_child(spark, root, f"{day}=*/{WRITER}={name}")) if files.exists(root) else []
    return sorted(entry.getPath().toString() for entry in found or [])


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all it holds."""
    files, root = _files(spark, folder)
    files.delete(root, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files, root = _files(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(root)] if files.exists(root) else []


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    files, file = _files(spark, path)
    files.create(file, True).close()


def exists(spark: SparkSession, path: str) -> bool:
    files, root = _files(spark, path)
    return files.exists(root)


def recluster(spark: SparkSession, path: str, days: Sequence[date], files: int) -> None:
    """Deal the specs of the given days out anew, over about ``files`` files clustered by their filter columns.

    Rows are stored apart before the days are replaced, since appends leave files that all span all clusters. One
    writer at a time may replace days; a reader of these days must begin before or after.
    """
    day, _ = schemas.LAYOUT["specs"]
    rows = settle(read(spark, path, "specs").where(F.col(day).isin(list(days))))
    clustering.clustered(rows, "specs", files).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(day).parquet(path)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read with the declared schema; filters on the date column prune whole folders."""
    fields = _with_day(table)
    if table == "results":
        fields = fields.add(WRITER, "string")
    return spark.read.schema(fields).parquet(path)


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished snapshots, ascending."""
    return _numbers(spark, path, "_manifest-")


def snapshot_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/v={number}"


def folders(spark: SparkSession, path: str, number: int) -> list[str]:
    """The day folders of a finished snapshot, relative to the catalog."""
    return _manifest(spark, path, number)[1:]


def snapshot_keys(spark: SparkSession, path: str) -> set[str]:
    """The keys that writers have given to finished snapshots."""
    return {_manifest(spark, path, n)[0] for n in snapshots(spark, path)}


def day_of(folder: str) -> str:
    """The day of a folder, as written in its name."""
    return folder.rsplit("=", 1)[1]


def read_snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A catalog snapshot, the latest by default; an empty catalog when there is none."""
    if number is None:
        numbers = snapshots(spark, path)
        if not numbers:
            return spark.createDataFrame([], schemas.CATALOG)
        number = numbers[-1]
    return read_folders(spark, path, folders(spark, path, number))


def read_folders(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], _with_day("catalog"))
    root = path.rstrip("/")
    reader = spark.read.schema(_with_day("catalog")).option("basePath", root)
    return reader.parquet(*(f"{root}/{name}" for name in names)).drop("v")


def write_snapshot(
    catalog: DataFrame,
    path: str,
    number: int | None = None,
    now: datetime | None = None,
    keep: Sequence[str] = (),
    key: str = "",
) -> int:
    """Write rows as the next snapshot (or the given number), beside the ``keep`` folders, and return the number.

    A number that another writer has claimed is refused. No row is left out: callers split off invalid ones before.
    """
    spark = catalog.sparkSession
    number = _claim(spark, path, number)
    target = snapshot_path(path, number)
    _write(lay_out(_declared(catalog, "catalog", now), "catalog", many_days=True), target, "catalog", "overwrite")
    _finish(spark, path, number, [*keep, *_day_folders(spark, path, number)], key)
    return number


def carry_forward(spark: SparkSession, path: str, key: str) -> int:
    """A snapshot equal to the latest, which records that the writer ``key`` had nothing to add."""
    done = snapshots(spark, path)
    number = _claim(spark, path, None)
    _finish(spark, path, number, folders(spark, path, done[-1]) if done else [], key)
    return number


def append_catalog(rows: DataFrame, path: str, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Add rows as a new snapshot that takes over all older folders; returns (stored rows, rejected rows)."""
    spark = rows.sparkSession
    valid, rejects = quality.split_valid(_declared(rows, "catalog", now), "catalog")
    done = snapshots(spark, path)
    kept = folders(spark, path, done[-1]) if done else []
    number = write_snapshot(valid, path, now=now, keep=kept)
    return read_folders(spark, path, _day_folders(spark, path, number)), rejects


def expire_snapshots(spark: SparkSession, path: str, keep: int = 30) -> None:
    """Delete all but the last ``keep`` snapshots, with the folders that none of those needs."""
    done = snapshots(spark, path)
    old, needed = done[:-keep], {f for n in done[-keep:] for f in folders(spark, path, n)}
    files, root = _files(spark, path)
    for number in old:
        unused = [f for f in _day_folders(spark, path, number) if f not in needed]
        files.delete(_child(spark, root, f"_manifest-{number}"), False)
        for folder in unused:
            files.delete(_child(spark, root, folder), True)


def write_days(df: DataFrame, path: str, day: str) -> None:
    """Replace exactly the days present in ``df``; other days of the table stay."""
    (
        df.hint("rebalance", day)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day)
        .parquet(path)
    )


def replace_days(df: DataFrame, path: str, day: str, days: Sequence[date]) -> None:
    """Replace the given days of a table; a day without rows in ``df`` goes."""
    spark, df = df.sparkSession, settle(df)
    present = {row[0] for row in df.select(day).distinct().collect()}  # a row for each day
    if present:
        write_days(df, path, day)
    for gone in set(days) - present:
        delete(spark, f"{path.rstrip('/')}/{day}={gone.isoformat()}")


def _declared(df: DataFrame, table: str, now: datetime | None) -> DataFrame:
    return quality.apply_defaults(df, table, now or utc_now()).select(schemas.SCHEMAS[table].names)


def _write(df: DataFrame, path: str, table: str, mode: str) -> None:
    day, _ = schemas.LAYOUT[table]
    df.write.mode(mode).partitionBy(day).parquet(path)


def _with_day(table: str) -> StructType:
    day, _ = schemas.LAYOUT[table]
    fields = StructType(list(schemas.SCHEMAS[table].fields))
    return fields if day in fields.names else fields.add(day, "date")


def _claim(spark: SparkSession, path: str, number: int | None) -> int:
    """Take the next free number, or the given one, for this writer alone."""
    files, root = _files(spark, path)
    files.mkdirs(root)
    taken = {*_numbers(spark, path, "_claim-"), *_numbers(spark, path, "_manifest-")}
    wanted = number if number is not None else max(taken, default=-1) + 1
    while not files.createNewFile(_child(spark, root, f"_claim-{wanted}")):
        if number is not None:
            raise ValueError(f"snapshot {number} belongs to another writer")
        wanted += 1
    return wanted


def _finish(spark: SparkSession, path: str, number: int, names: Sequence[str], key: str) -> None:
    files, root = _files(spark, path)
    draft = _child(spark, root, f"_draft-{number}")
    out = files.create(draft, True)
    out.write(bytearray("\n".join([key, *names]).encode()))
    out.close()
    if not files.rename(draft, _child(spark, root, f"_manifest-{number}")):
        raise OSError(f"cannot finish snapshot {number} of {path}")


def _manifest(spark: SparkSession, path: str, number: int) -> list[str]:
    files, root = _files(spark, path)
    stream = files.open(_child(spark, root, f"_manifest-{number}"))
    try:
        return bytes(stream.readAllBytes()).decode().split("\n")
    finally:
        stream.close()


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    files, root = _files(spark, path)
    if not files.exists(root):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(root)]
    return sorted(int(name[len(prefix) :]) for name in names if name.startswith(prefix))


def _day_folders(spark: SparkSession, path: str, number: int) -> list[str]:
    files, root = _files(spark, path)
    own = _child(spark, root, f"v={number}")
    if not files.exists(own):
        return []
    names = sorted(entry.getPath().getName() for entry in files.listStatus(own) if entry.isDirectory())
    return [f"v={number}/{name}" for name in names if "=" in name]


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _child(spark: SparkSession, folder, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(folder, name)
