"""Stored daily sums and run counts of the results, kept up to date by what arrives.

A rollup folder has four tables:

- ``deltas``: signed partial sums by day, writer, project, region and pricing model, only ever appended. All deltas of a
  writer add up to what its lines are now, so when a writer runs again, the new lines less that sum are appended. An
  update that died half-way is made good by the next one, because it starts from what is stored.
- ``presence``: the same for the runs (by number) that a writer has lines of on a day.
- ``runs``: the dictionary of run ids. A number is given once and stays, and numbers are dense, so bitmaps of them are
  short.
- ``days`` and ``bitmaps``: sums of all writers of a day, and the bitmaps of its runs, in a folder per month. They are
  made anew from the first two for the months that an update touches, which replaces whole folders.

Reports read ``days`` and ``bitmaps`` only: sums add up over any window, and bitmaps merge to exact distinct counts. One
updater at a time may work on a rollup; readers are free.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from costloom.functions import rates
from costloom.operators import joins, reports
from costloom.session import settle
from costloom.sources import tables

GROUPS = ["project_id", "region", "pricing_model"]
LINE_FIELDS = ["calc_date", "boq_id", *GROUPS, "total_cost_usd", "total_discount_usd"]  # what an update reads of a line
SUMS = ["line_count", "cost_count", "cost_micros", "discount_micros"]
MONEY = "decimal(28,0)"
MONTH = "month"  # folder of days and bitmaps
FIELDS = {
    "deltas": "of string, project_id string, region string, pricing_model string, line_count bigint, cost_count bigint, "
    f"cost_micros {MONEY}, discount_micros {MONEY}, calc_date date",
    "presence": "of string, run bigint, line_count bigint, calc_date date",
    "runs": "boq_id string, run bigint",
    "days": "project_id string, region string, pricing_model string, line_count bigint, cost_count bigint, "
    f"cost_micros {MONEY}, discount_micros {MONEY}, calc_date date, {MONTH} date",
    "bitmaps": f"bucket bigint, runs binary, calc_date date, {MONTH} date",
}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the rollup; empty before the first update."""
    place = f"{path.rstrip('/')}/{name}"
    if not tables.exists(spark, place):
        return spark.createDataFrame([], FIELDS[name])
    return spark.read.schema(FIELDS[name]).parquet(place)


def update(lines: DataFrame, path: str, writer: str) -> list[date]:
    """Take over what ``writer`` has now: all its lines, none if it has none. Returns the days whose sums changed.

    Reads the lines once, the writer's earlier deltas (row groups of other writers are skipped by their statistics) and
    the deltas of the touched months. Work grows with the writer and those months, not with the results.
    """
    spark = lines.sparkSession
    by_run = lines.groupBy("calc_date", "boq_id", *GROUPS).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count("total_cost_usd").alias("cost_count"),
        F.coalesce(F.sum(rates.in_units(F.col("total_cost_usd")).cast("decimal(20,0)")), F.lit(0)).cast(MONEY).alias("cost_micros"),
        F.coalesce(F.sum(rates.in_units(F.col("total_discount_usd")).cast("decimal(20,0)")), F.lit(0)).cast(MONEY).alias("discount_micros"),
    )
    parts = settle(by_run)
    numbers = _numbered_runs(spark, parts, path)
    named = joins.lookup(parts.where("boq_id is not null").groupBy("calc_date", "boq_id").agg(F.sum("line_count").alias("line_count")), numbers, ["boq_id"], "inner")
    sums = _delta(parts, read(spark, path, "deltas").where(F.col("of") == writer), ["calc_date", *GROUPS], SUMS)
    presence = _delta(named, read(spark, path, "presence").where(F.col("of") == writer), ["calc_date", "run"], ["line_count"])
    touched = {r[0] for df in (sums, presence) for r in df.select("calc_date").distinct().collect()}  # a row per day
    for name, df in (("deltas", sums), ("presence", presence)):
        out = df.withColumn("of", F.lit(writer)).select(*spark.createDataFrame([], FIELDS[name]).columns)
        if touched:
            out.hint("rebalance").sortWithinPartitions("of", "calc_date").write.mode("append").parquet(f"{path.rstrip('/')}/{name}")
    refresh(spark, path, sorted({day.replace(day=1) for day in touched - {None}}))
    return sorted(touched - {None})


def refresh(spark: SparkSession, path: str, months: list[date]) -> None:
    """Make the given months of ``days`` and ``bitmaps`` anew from the deltas; a month without lines goes."""
    if not months:
        return
    month = F.trunc("calc_date", "month")
    # The range lets the scan skip row groups; the list is exact.
    wanted = (F.col("calc_date") >= months[0]) & (F.col("calc_date") < F.add_months(F.lit(months[-1]), 1)) & month.isin(months)
    sums = _added(read(spark, path, "deltas").where(wanted), ["calc_date", *GROUPS], SUMS)
    present = _added(read(spark, path, "presence").where(wanted), ["calc_date", "run"], ["line_count"])
    for name, df in (("days", sums), ("bitmaps", _bitmaps(present))):
        tables.replace_days(df.withColumn(MONTH, month), f"{path.rstrip('/')}/{name}", MONTH, months)


def _bitmaps(present: DataFrame) -> DataFrame:
    """``calc_date``, ``bucket`` and ``runs``, a bitmap of 4 KB, of rows (``calc_date``, ``run``).

    The rows of a bitmap are brought together first. Bitmaps begun where the rows lie would be one of each day and bucket
    in every task, 4 KB for a few runs, and their number would grow with the runs times the tasks.
    """
    rows = present.select("calc_date", F.bitmap_bucket_number("run").alias("bucket"), F.bitmap_bit_position("run").alias("bit"))
    return rows.repartition("calc_date", "bucket").groupBy("calc_date", "bucket").agg(F.bitmap_construct_agg("bit").alias("runs"))


def history(spark: SparkSession, path: str, as_of: date, days: int) -> DataFrame:
    """The daily history of a window: runs, lines and cost of each day, newest first. Reads no result lines."""
    sums = _window(spark, path, "days", as_of, days).groupBy("calc_date")
    sums = sums.agg(F.sum("line_count").alias("total_resources"), F.sum("cost_micros").alias("cost"), F.sum("cost_count").alias("costs"))
    bits = _window(spark, path, "bitmaps", as_of, days).groupBy("calc_date")
    runs = bits.agg(F.sum(F.bitmap_count("runs")).alias("calculations"))
    return sums.join(runs, "calc_date", "left").select(
        F.col("calc_date").alias("date"), F.coalesce("calculations", F.lit(0)).alias("calculations"), "total_resources", _money("cost", "costs").alias("total_cost")
    ).orderBy(F.desc("date"))


def result_stats(spark: SparkSession, path: str, as_of: date, days: int) -> DataFrame:
    """Key figures of a window in one row: runs counted once however many days they span, cost, mean and lines."""
    sums = _window(spark, path, "days", as_of, days).agg(
        F.sum("line_count").alias("n"), F.sum("cost_micros").alias("cost"), F.sum("cost_count").alias("costs")
    )
    merged = _window(spark, path, "bitmaps", as_of, days).groupBy("bucket").agg(F.bitmap_or_agg("runs").alias("runs"))
    both = sums.unionByName(merged.agg(F.sum(F.bitmap_count("runs")).alias("runs")), allowMissingColumns=True)
    row = both.agg(*(F.max(c).alias(c) for c in both.columns))
    cost = _money("cost", "costs")
    return row.select(
        F.coalesce("runs", F.lit(0)).alias("total_calculations"), cost.alias("total_cost"),
        F.try_divide(cost, F.col("costs")).alias("avg_cost"), F.coalesce("n", F.lit(0)).alias("total_boq_items"),
    )


def _window(spark: SparkSession, path: str, name: str, as_of: date, days: int) -> DataFrame:
    """The trailing window of a table; folders of earlier months are not opened."""
    months = F.col(MONTH) >= F.trunc(F.date_sub(F.lit(as_of), days), "month")
    return read(spark, path, name).where(months & reports.since("calc_date", as_of, days))


def by_group(spark: SparkSession, path: str) -> DataFrame:
    """The daily rollup: sums by day, project, region and pricing model."""
    return read(spark, path, "days").select("calc_date", *GROUPS, "line_count", "cost_micros", "discount_micros")


def _money(total: str, n: str):
    return F.when(F.col(n) > 0, F.col(total).cast("double") / F.lit(rates.MICROS))


def _added(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Sums of signed rows; groups that have no line left go. They add up to nothing in every column."""
    types = dict(rows.dtypes)
    total = rows.groupBy(*by).agg(*(F.sum(c).cast(types[c]).alias(c) for c in sums))
    return total.where("line_count <> 0")


def _delta(new: DataFrame, old: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Signed rows that lead from ``old`` to ``new``, settled; groups that did not change have none."""
    types = dict(old.dtypes)
    minus = old.select(*by, *((-F.col(c)).cast(types[c]).alias(c) for c in sums))
    total = new.select(*by, *sums).unionByName(minus).groupBy(*by).agg(*(F.sum(c).cast(types[c]).alias(c) for c in sums))
    return settle(total.where(" or ".join(f"{c} <> 0" for c in sums)))


def _numbered_runs(spark: SparkSession, parts: DataFrame, path: str) -> DataFrame:
    """``boq_id`` and ``run`` of the runs in ``parts``; new ones are added to the dictionary.

    New ids get the next numbers without a gap: each task numbers its own from where the tasks before it end.
    """
    ids = settle(parts.where("boq_id is not null").select("boq_id").distinct())
    known = read(spark, path, "runs")
    found = settle(known.join(F.broadcast(ids) if joins.measure(ids).fits() else ids, "boq_id"))
    new = ids.join(found, "boq_id", "left_anti").select(
        "boq_id", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")
    )
    new = settle(new)
    tasks = sorted(new.groupBy("_part").agg(F.count(F.lit(1)), F.min("_row")).collect())  # a row for each task
    if not tasks:
        return found
    last = known.agg(F.max("run")).first()[0] or 0
    starts = []
    for part, n, low in tasks:
        starts.append((part, last + 1 - low))
        last += n
    shift = F.broadcast(spark.createDataFrame(starts, "_part int, _shift bigint"))
    added = settle(new.join(shift, "_part").select("boq_id", (F.col("_row") + F.col("_shift")).alias("run")))
    added.sortWithinPartitions("boq_id").write.mode("append").parquet(f"{path.rstrip('/')}/runs")
    return found.unionByName(added)
