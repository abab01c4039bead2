"""Summaries and reports over specs, catalog rows and result lines.

Money is added exactly (see ``rates.exact_sum``). Distinct counts are exact. Where a report counts several
columns distinctly, rows are first reduced to those columns with partial aggregation, which replaces the
row-multiplying plan Spark would use for several distinct counts.

Date reports filter on ``calc_date``, the column the stored results are partitioned by.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom import constants as K
from costloom.functions import cases, rates, utc_day
from costloom.operators import joins
from costloom.session import settle



def with_calc_date(lines: DataFrame) -> DataFrame:
    return lines.withColumn("calc_date", utc_day(F.col("calculation_timestamp").cast("timestamp")))


def since(column: str, as_of: date, days: int) -> Column:
    """The trailing window of ``days`` days plus today."""
    return F.col(column) >= F.date_sub(F.lit(as_of), days)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def resource_stats(specs: DataFrame) -> DataFrame:
    parts = specs.groupBy("project_id", "region").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("vcpu_count").alias("vcpu"),
        F.count("vcpu_count").alias("vcpu_n"),
        F.sum(rates.in_units(F.col("memory_gb")).cast("decimal(20,0)")).alias("memory"),
        F.count("memory_gb").alias("memory_n"),
        F.count(F.when(F.col("pricing_model") == "spot", 1)).alias("spot"),
    )
    return parts.agg(
        F.countDistinct("project_id").alias("total_projects"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_resources"),
        F.countDistinct("region").alias("total_regions"),
        F.try_divide(F.sum("vcpu").cast("double"), F.sum("vcpu_n")).alias("avg_vcpu"),
        F.try_divide(F.sum("memory").cast("double") / F.lit(rates.MICROS), F.sum("memory_n")).alias("avg_memory"),
        F.coalesce(F.sum("spot"), F.lit(0)).alias("spot_resources"),
    )


def result_stats(lines: DataFrame, as_of: date, days: int = K.HISTORY_DAYS) -> DataFrame:
    return lines.where(since("calc_date", as_of, days)).agg(
        F.countDistinct("boq_id").alias("total_calculations"),
        rates.exact_sum(F.col("total_cost_usd")).alias("total_cost"),
        rates.exact_avg(F.col("total_cost_usd")).alias("avg_cost"),
        F.count(F.lit(1)).alias("total_boq_items"),
    )


def dashboard(specs: DataFrame, lines: DataFrame, as_of: date, days: int = K.HISTORY_DAYS) -> DataFrame:
    """Both sets of statistics in one row."""
    both = resource_stats(specs).unionByName(result_stats(lines, as_of, days), allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in both.columns])


def boq_summary(lines: DataFrame) -> DataFrame:
    """One row per run; a run without lines has no row."""
    cost = F.col("total_cost_usd")
    summary = lines.agg(
        F.count(F.lit(1)).alias("total_resources"),
        rates.exact_sum(cost).alias("total_cost_usd"),
        rates.exact_sum(F.col("total_discount_usd")).alias("total_discount_usd"),
        rates.exact_avg(cost).alias("average_cost_per_resource"),
    )
    return summary.where("total_resources > 0")


def run_summary(lines: DataFrame) -> DataFrame:
    """One row: the totals of a run and its cost by project and by region, as maps."""

    def costs(column: str) -> DataFrame:
        entry = F.struct(F.coalesce(column, F.lit("")), "total_cost_usd")
        return cost_by(lines, column).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(f"cost_by_{column}"))

    totals = lines.agg(
        F.count(F.lit(1)).alias("resources_processed"),
        F.coalesce(rates.exact_sum(F.col("total_cost_usd")), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(rates.exact_sum(F.col("total_discount_usd")), F.lit(0.0)).alias("total_discount_usd"),
    )
    parts = (totals, costs("project_id"), costs("region"))
    merged = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return merged.agg(*(F.first(name, ignorenulls=True).alias(name) for name in merged.columns))


def boq_summary_by_id(lines: DataFrame, boq_id: str) -> DataFrame:
    parts = (
        lines.where(F.col("boq_id") == boq_id)
        .groupBy("project_id", "region")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(rates.in_units(F.col("total_cost_usd")).cast("decimal(20,0)")).alias("cost"),
            F.sum(rates.in_units(F.col("total_discount_usd")).cast("decimal(20,0)")).alias("discount"),
        )
    )
    cost = F.sum("cost").cast("double") / F.lit(rates.MICROS)
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_resources"),
        cost.alias("total_cost"),
        (F.sum("discount").cast("double") / F.lit(rates.MICROS)).alias("total_discount"),
        F.try_divide(cost, F.sum("n")).alias("avg_cost_per_resource"),
        F.countDistinct("project_id").alias("projects_count"),
        F.countDistinct("region").alias("regions_count"),
    )


def cost_by(lines: DataFrame, *columns: str) -> DataFrame:
    return lines.groupBy(*columns).agg(rates.exact_sum(F.col("total_cost_usd")).alias("total_cost_usd"))


def update_report(
    catalog: DataFrame, effective_date: date, total_records: int | None = None, updated: datetime | None = None
) -> DataFrame:
    """Active prices of a day by category. With ``total_records``, each row also has the day, that number and the time
    of the update; without any category one row has these alone."""
    price = F.col("price_per_unit")
    report = (
        catalog.where((F.col("effective_date") == F.lit(effective_date)) & F.col("is_active"))
        .groupBy("category", "service_name")
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            rates.exact_avg(price, rates.NANOS).alias("avg_price"),
            F.min(price).alias("min_price"),
            F.max(price).alias("max_price"),
        )
    )
    if total_records is not None:
        envelope = {
            "effective_date": F.lit(effective_date),
            "total_records": F.lit(total_records).cast("bigint"),
            "update_time": F.lit(updated).cast("timestamp"),
        }
        alone = catalog.sparkSession.range(1 if report.isEmpty() else 0).drop("id")
        report = report.unionByName(alone, allowMissingColumns=True).withColumns(envelope)
    return report.orderBy("category", "service_name")


def cost_history(lines: DataFrame, as_of: date, days: int = K.HISTORY_DAYS) -> DataFrame:
    return (
        lines.where(since("calc_date", as_of, days))
        .groupBy(F.col("calc_date").alias("date"))
        .agg(
            F.countDistinct("boq_id").alias("calculations"),
            F.count(F.lit(1)).alias("total_resources"),
            rates.exact_sum(F.col("total_cost_usd")).alias("total_cost"),
        )
        .orderBy(F.desc("date"))
    )


def today_by_project(lines: DataFrame, as_of: date) -> DataFrame:
    return (
        lines.where(F.col("calc_date") == F.lit(as_of))
        .groupBy("project_id")
        .agg(
            rates.exact_sum(F.col("total_cost_usd")).alias("total_cost"),
            F.count(F.lit(1)).alias("resource_count"),
        )
        .orderBy(F.desc("total_cost"), "project_id")
    )


# Declared reports: named in the published documents or settings, without code there.


def budget_check(lines: DataFrame, budgets: dict[str, float] | None = None) -> DataFrame:
    """Cost per cost center against its budget; a center without a budget is never over it."""
    known = (budgets or K.COST_CENTER_BUDGETS).items()
    limit = cases((F.col("cost_center") == name, float(threshold)) for name, threshold in known)
    return (
        cost_by(lines, "cost_center")
        .withColumn("budget_threshold", limit)
        .withColumn("over_budget", F.coalesce(F.col("total_cost_usd") > F.col("budget_threshold"), F.lit(False)))
    )


def budget_crossings(
    lines: DataFrame, budgets: dict[str, float] | None = None, order: Sequence[str] = ("calc_date", "resource_id", "boq_id"),
    slices: int | None = None,
) -> DataFrame:
    """The line with which the cost of each center, added up in ``order``, first passes its budget; centers that stay
    within it have no row. Lines equal in all of ``order`` are added at once.

    A running sum in two levels, so that a center of any size spreads over all tasks: lines are sorted by center and order
    into ranges; every range's sum per center is added up over the ranges before it, of which there are as many as
    tasks, and only the one range in which a budget is passed is summed line by line.
    """
    known = (budgets or K.COST_CENTER_BUDGETS).items()
    limit = cases((F.col("cost_center") == name, F.lit(round(threshold * rates.MICROS)).cast("decimal(28,0)")) for name, threshold in known)
    micros = F.coalesce(F.sum(rates.in_units(F.col("total_cost_usd")).cast("decimal(20,0)")), F.lit(0)).cast("decimal(28,0)")
    steps = lines.where(limit.isNotNull()).groupBy("cost_center", *order).agg(micros.alias("micros"), F.count(F.lit(1)).alias("lines"))
    parts = slices or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["cost_center", *order]
    # Stored once: which range a line lies in must not change between the two readings.
    dealt = settle(steps.repartitionByRange(parts, *keys).withColumn("slice", F.spark_partition_id()))
    sums = dealt.groupBy("cost_center", "slice").agg(F.sum("micros").cast("decimal(28,0)").alias("sum"))
    before = Window.partitionBy("cost_center").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reached = sums.withColumns({"before": F.coalesce(F.sum("sum").over(before), F.lit(0)).cast("decimal(28,0)"), "budget": limit})
    passing = reached.where("before <= budget and before + sum > budget").groupBy("cost_center").agg(
        F.min_by(F.struct("slice", "before", "budget"), "slice").alias("at")
    )
    here = dealt.join(F.broadcast(passing), "cost_center").where("slice = at.slice")  # a row for each budget
    running = Window.partitionBy("cost_center").orderBy(*order)
    summed = here.withColumn("reached", (F.col("at.before") + F.sum("micros").over(running)).cast("decimal(28,0)"))
    first = summed.where("reached > at.budget").groupBy("cost_center").agg(F.min(F.struct("reached", *order)).alias("first"), F.first("at.budget").alias("budget"))
    money = lambda c: c.cast("double") / F.lit(rates.MICROS)
    return first.select(
        "cost_center", *(F.col(f"first.{c}").alias(c) for c in order), money(F.col("first.reached")).alias("reached_usd"),
        money(F.col("budget")).alias("budget_threshold"),
    )


def results_retention(lines: DataFrame, as_of: date, keep_days: int = K.RESULTS_KEEP_DAYS) -> DataFrame:
    return lines.where(since("calc_date", as_of, keep_days))


def daily_rollup(lines: DataFrame) -> DataFrame:
    """Costs by day, project, region and pricing model, in whole micro-dollars so that rollups add up exactly."""
    return lines.groupBy("calc_date", "project_id", "region", "pricing_model").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(rates.in_units(F.col("total_cost_usd")).cast("decimal(20,0)")).alias("cost_micros"),
        F.sum(rates.in_units(F.col("total_discount_usd")).cast("decimal(20,0)")).alias("discount_micros"),
    )


def monthly_cost(rollup: DataFrame) -> DataFrame:
    """Monthly cost by project, from a daily rollup."""
    return rollup.groupBy(F.trunc("calc_date", "month").alias("month"), "project_id").agg(
        F.sum("line_count").alias("line_count"),
        (F.sum("cost_micros").cast("double") / F.lit(rates.MICROS)).alias("total_cost_usd"),
    )


MOMENTS = "project_id string, n bigint, s decimal(29,0), q decimal(38,0)"


def cost_anomalies(lines: DataFrame, sigmas: float = 3.0, **bounds: int) -> DataFrame:
    """Lines that cost more than their project's mean plus ``sigmas`` standard deviations.

    Mean and deviation come from exact sums of micro-dollars and their squares. The squares are moved to the whole part
    of the mean in decimals, so nothing large is subtracted in floating point.
    """
    return above_limit(lines, settle(cost_limits(cost_moments(lines), sigmas)), **bounds)


def cost_moments(lines: DataFrame) -> DataFrame:
    """``MOMENTS`` of each project's lines: their number, and exact sums of micro-dollars and of their squares. Moments of
    different lines add up."""
    micros = rates.in_units(F.col("total_cost_usd")).cast("decimal(19,0)")
    return added_moments(lines.select("project_id", F.lit(1).alias("n"), micros.alias("s"), (micros * micros).alias("q")))


def added_moments(moments: DataFrame) -> DataFrame:
    """The moments of all the lines that several moments of a project stand for."""
    return moments.groupBy("project_id").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("s").cast("decimal(29,0)").alias("s"), F.sum("q").cast("decimal(38,0)").alias("q")
    )


def cost_limits(moments: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """``cost_limit`` of each project with more than one line."""
    moved = moments.where("n > 1").withColumn("m", F.expr("cast(s div n as decimal(18,0))"))
    moved = moved.withColumn("r", F.expr("cast(s - m * n as decimal(19,0))"))
    squares = F.expr("q - m * cast(s + r as decimal(20,0))").cast("double")
    n, rest = F.col("n").cast("double"), F.col("r").cast("double")
    variance = F.greatest(F.lit(0.0), (squares - rest * rest / n) / (n - F.lit(1.0)))
    mean = F.col("m").cast("double") + rest / n
    return moved.select("project_id", ((mean + F.lit(sigmas) * F.sqrt(variance)) / rates.MICROS).alias("cost_limit"))


def above_limit(lines: DataFrame, limits: DataFrame, **bounds: int) -> DataFrame:
    """Lines that cost more than their project's settled limit."""
    flagged = joins.lookup(lines, limits, ["project_id"], "inner", spread_by=["resource_id"], **bounds)
    return flagged.where(F.col("total_cost_usd") > F.col("cost_limit"))


def catalog_staleness(catalog: DataFrame, now: datetime, ttl_hours: int = K.CATALOG_TTL_HOURS) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("last_updated"), F.lit(now))
    return (
        catalog.where("is_active")
        .groupBy("service_name")
        .agg(F.max("last_updated").alias("last_updated"))
        .withColumn("age_hours", age / F.lit(3600))
        .withColumn("is_stale", F.col("age_hours") > ttl_hours)
    )


def cost_by_machine_class(lines: DataFrame) -> DataFrame:
    return cost_by(
        lines.withColumn("machine_class", rates.machine_class(F.col("machine_type"))), "machine_class"
    )
