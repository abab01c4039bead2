"""Resource specs, price feed and extra disks derived from the test tables.

The SQL texts are portable: Spark builds its inputs from them and the oracle uses them as they are. Names in braces
stand for the tables.
"""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costloom.operators import catalog as catalogs
from costloom.operators import costing, reports

AS_OF = date(2001, 8, 1)
NOW = datetime(2001, 8, 1, tzinfo=timezone.utc)
REFRESH_DAY = date(2001, 4, 3)
REFRESH_TIME = datetime(2001, 4, 3, 2, tzinfo=timezone.utc)
BOQ_ID = "boq-5"

SPECS_SQL = """
select 'proj-' || cast(c_nationkey as string) as project_id,
  'res-' || cast(o_orderkey as string) as resource_id,
  case o_orderkey % 8 when 0 then 'n1-standard-2' when 1 then 'n1-highmem-4' when 2 then 'e2-medium'
    when 3 then 'n1-standard-4' when 4 then 'c2-standard-8' when 5 then 'f1-micro'
    when 6 then 'n2d-highcpu-8' else 'x9-odd-1' end as machine_type,
  cast(1 + o_orderkey % 8 as bigint) as vcpu_count,
  cast(3.75 * (1 + o_orderkey % 8) as double) as memory_gb,
  case o_orderkey % 3 when 0 then 'pd-standard' when 1 then 'pd-ssd' else 'pd-balanced' end as disk_type,
  cast(20 + o_orderkey % 500 as bigint) as disk_size_gb,
  case r_name when 'AFRICA' then 'us-east1' when 'AMERICA' then 'us-central1'
    when 'ASIA' then 'asia-southeast1' when 'EUROPE' then 'europe-west1' else 'us-west1' end as region,
  cast(o_orderkey % 900 as bigint) as usage_duration_hours,
  case o_orderkey % 5 when 0 then 'intermittent' when 1 then 'scheduled' when 2 then null
    else 'continuous' end as usage_pattern,
  case o_orderpriority when '1-URGENT' then 'on-demand' when '2-HIGH' then 'cud-1-year'
    when '3-MEDIUM' then 'cud-3-year' when '4-NOT SPECIFIED' then 'spot' else 'preemptible' end as pricing_model,
  case when o_orderkey % 7 = 0 then 'tesla-t4' when o_orderkey % 11 = 0 then 'nvidia-tesla-v100' end as gpu_type,
  case when o_orderkey % 7 = 0 or o_orderkey % 11 = 0 then cast(1 + o_orderkey % 4 as bigint) end as gpu_count,
  o_orderstatus = 'F' as external_ip,
  o_orderdate as created_at,
  lower(c_mktsegment) as cost_center,
  case o_orderstatus when 'F' then 'prod' when 'O' then 'dev' else 'staging' end as environment,
  'boq-' || cast(o_custkey as string) as boq_id
from {orders} join {customer} on o_custkey = c_custkey
join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""

FEED_SQL = """
select 'sku-' || cast(p_partkey as string) as sku_id,
  case p_partkey % 16
    when 0 then 'N1-Standard-4 Instance 4 vCPU 15 GB running in Americas'
    when 1 then 'N2D-highcpu-8 Preemptible VM 8vcpu 32.5gb'
    when 2 then 'SSD Persistent Disk Capacity'
    when 3 then 'Balanced PD Storage Capacity Regional'
    when 4 then 'Storage PD Capacity standard'
    when 5 then 'Nvidia Tesla V100 GPU running in Iowa'
    when 6 then 'Tesla T4 GPU attached to Spot VM'
    when 7 then 'Commitment v1: N1-highmem-2 Cpu for 1 Year'
    when 8 then 'E2-medium Instance Core 3-year commitment'
    when 9 then 'External IP Address standard network'
    when 10 then 'Network premium egress global'
    when 11 then 'License fee for VM image'
    when 12 then 'Cloud Rapid Storage'
    when 13 then 'C2-standard-8 Instance 8 vCPU'
    when 14 then 'F1-micro Instance'
    else 'Consulting hours' end as description,
  cast(p_partkey % 3 as bigint) as units,
  cast((p_partkey * 7919 % 1000) * 1000000 as bigint) as nanos,
  case when p_partkey % 5 = 0 then cast(100 as bigint) end as tier2_start,
  case when p_partkey % 5 = 0 then cast(p_partkey % 3 as bigint) end as tier2_units,
  case when p_partkey % 5 = 0 then cast((p_partkey * 31 % 1000) * 1000000 as bigint) end as tier2_nanos,
  case when p_partkey % 16 = 13 then null
    when p_partkey % 16 = 3 then 'us-central1'
    when p_partkey % 16 = 2 then case when p_size % 2 = 0 then 'us-east1' end
    when p_partkey % 16 = 6 then case when p_size % 2 = 0 then 'us-central1' end
    when p_partkey % 16 = 14 then case when p_size % 2 = 0 then 'us-central1' end
    when p_partkey % 16 = 0 then case p_size % 3 when 0 then 'us-east1' when 1 then 'us-central1' end
    else case p_size % 6 when 0 then 'us-east1' when 1 then 'us-central1' when 2 then 'asia-southeast1'
      when 3 then 'europe-west1' when 4 then 'us-west1' end end as region,
  cast(date_add(date '2001-01-01', cast(p_size * 4 as int)) as date) as effective_date,
  p_size % 10 <> 0 as is_active
from {part}
"""

# Every order line is a disk of its order's resource.
DISK_ROWS_SQL = """
select l_orderkey,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as rn,
  case l_partkey % 3 when 0 then 'pd-ssd' when 1 then 'pd-standard' else 'pd-balanced' end as disk_type,
  cast(10 + l_partkey % 990 as bigint) as size_gb
from {lineitem}
"""


# Declared, so that no job is spent on reading file footers for a schema.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def _specs(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    rows = _sql(spark, sf_dir, text, "orders", "customer", "nation", "region")
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resource per order. ``boq_id`` is the run its cost line is filed under."""
    return _specs(spark, sf_dir, SPECS_SQL)


def specs_with_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resources with their disks, joined on the order key: one exchange of the lines serves all three steps."""
    rows = _sql(spark, sf_dir, DISK_ROWS_SQL, "lineitem")
    disks = rows.groupBy("l_orderkey").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "disk_type", "size_gb"))),
            lambda disk: F.struct(
                disk["disk_type"].alias("disk_type"),
                disk["size_gb"].alias("size_gb"),
                F.lit(None).cast("string").alias("description"),
            ),
        ).alias("additional_disks")
    )
    keyed = _specs(spark, sf_dir, SPECS_SQL.replace("select ", "select o_orderkey, ", 1))
    return keyed.join(disks, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("o_orderkey", "l_orderkey")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price-feed record per part, in the nested form of the feed."""

    def rate(start: str, units: str, nanos: str) -> Column:
        # Half of the records leave the currency out.
        code = F.when(F.col("units") == 1, F.lit("USD"))
        price = F.struct(
            code.alias("currencyCode"),
            F.col(units).cast("string").alias("units"),
            F.col(nanos).cast("string").alias("nanos"),
        )
        return F.struct(F.col(start).cast("string").alias("startUsageAmount"), price.alias("unitPrice"))

    flat = _sql(spark, sf_dir, FEED_SQL, "part").withColumn("start", F.lit(0))
    rates = F.array_compact(
        F.array(
            rate("start", "units", "nanos"),
            F.when(F.col("tier2_start").isNotNull(), rate("tier2_start", "tier2_units", "tier2_nanos")),
        )
    )
    second_region = F.when(F.col("region").isNotNull() & (F.col("units") == 1), F.lit("us-west1"))
    expression = F.struct(F.lit("h").alias("usageUnit"), rates.alias("tieredRates"))
    return flat.select(
        F.col("sku_id").alias("skuId"),
        "description",
        F.array_compact(F.array("region", second_region)).alias("serviceRegions"),
        F.array(F.struct(expression.alias("pricingExpression"))).alias("pricingInfo"),
        "effective_date",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified feed as a stored catalog, with the dates and active flags the parts carry."""
    day = F.col("effective_date")
    built = catalogs.build_catalog(feed(spark, sf_dir), day, day.cast("timestamp"))
    size = F.date_diff(day, F.lit(date(2001, 1, 1))) / F.lit(4)
    return built.withColumn("is_active", size % 10 != 0)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines as if each resource had been calculated when it was created."""
    costed = costing.boq_lines(
        specs(spark, sf_dir), catalog(spark, sf_dir), F.col("boq_id"), F.col("created_at"), "tester"
    )
    return reports.with_calc_date(costed)
