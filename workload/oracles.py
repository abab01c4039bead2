"""SQL for the same results, written for a single-node SQL engine over the same tables.

The lookups are stated as the ranking they stand for: all matching catalog rows, ordered, first row wins. Each
distinct combination of lookup values is ranked once.
"""

from __future__ import annotations

from workload import inputs, registry

SPECS = inputs.SPECS_SQL.format(orders="orders", customer="customer", nation="nation", region="region")
FEED = inputs.FEED_SQL.format(part="part")
DISK_ROWS = inputs.DISK_ROWS_SQL.format(lineitem="lineitem")

# Machine families, words and names that must equal those of the price feed's rules.
FAMILIES = "n1|n2|n2d|e2|c2|c2d|m1|m2|f1|g1|a2|t2d|t2a"
ADHOC_FAMILIES = "n1|n2|n2d|e2|c2|c2d|m1|m2|f1|g1"
RELEVANT = "instance|vm|virtual machine|disk|storage|persistent|gpu|nvidia|tesla|ip address|network|memory|cpu|core"
EXCLUDED = "license|support|premium support|api|monitoring|logging|backup|snapshot transfer"
IS_RELEVANT = f"regexp_matches(d, '{RELEVANT}') and not regexp_matches(d, '{EXCLUDED}')"
IS_ADHOC = "(d like '%instance%' or d like '%disk%' or d like '%gpu%')"
IS_GPU = "(d like '%gpu%' or d like '%nvidia%' or d like '%tesla%')"
GPU = (
    "case when regexp_matches(d, '(nvidia|tesla)[-\\s]([a-z0-9]+)') then "
    "regexp_extract(d, '(nvidia|tesla)[-\\s]([a-z0-9]+)', 1) || '-' || "
    "regexp_extract(d, '(nvidia|tesla)[-\\s]([a-z0-9]+)', 2) end"
)
DISK = (
    "case when d like '%ssd%' then 'pd-ssd' when d like '%balanced%' then 'pd-balanced' "
    "when d like '%standard%' and (d like '%disk%' or d like '%storage%') then 'pd-standard' end"
)
ADHOC_DISK = (
    "case when d like '%ssd%' then 'pd-ssd' when d like '%standard%' then 'pd-standard' "
    "when d like '%balanced%' then 'pd-balanced' end"
)
TERM = (
    "case when d like '%1 year%' or d like '%1-year%' then '1-year' "
    "when d like '%3 year%' or d like '%3-year%' then '3-year' end"
)
TIER = (
    "case when d like '%premium%' then 'premium' when d like '%standard%' and "
    "(d like '%network%' or d like '%egress%' or d like '%ip%') then 'standard' end"
)
PREEMPTIBLE = "(d like '%preemptible%' or d like '%spot%')"

PARTS = f"""
specs as ({SPECS}),
feed as ({FEED}),
parts as (
  select *, lower(description) as d, cast(nanos as double) / 1e9 + cast(units as double) as price,
    cast(tier2_nanos as double) / 1e9 + cast(tier2_units as double) as price2
  from feed
)"""

CATALOG = f"""{PARTS},
found as (
  select *, nullif(regexp_extract(d, '({FAMILIES})-', 1), '') as family, {DISK} as disk, {GPU} as gpu,
    {TERM} as term, {TIER} as tier
  from parts where {IS_RELEVANT} and price <> 0
),
catalog as (
  select sku_id, description as sku_name, 'Compute Engine' as service_name, '6F81-5844-456A' as service_id,
    'Compute' as resource_family,
    case when family is null then 'Standard' else upper(family) || 'Standard' end as resource_group,
    case when term is not null then 'Committed' when {PREEMPTIBLE} then 'Preemptible' else 'OnDemand' end
      as usage_type,
    region, 'USD' as currency_code, 'h' as pricing_unit, price as price_per_unit,
    case when tier2_start is not null then
      '0|' || cast(cast(round(price * 1e9) as bigint) as varchar) || '|USD;' || cast(tier2_start as varchar) || '|'
      || cast(cast(round(price2 * 1e9) as bigint) as varchar) || '|USD' end as tiered_rates,
    family as machine_family,
    nullif(regexp_extract(d, '({FAMILIES})-[a-z0-9-]+', 0), '') as machine_type,
    cast(nullif(regexp_extract(d, '(\\d+)\\s*vcpu', 1), '') as bigint) as vcpu_count,
    cast(nullif(regexp_extract(d, '(\\d+(?:\\.\\d+)?)\\s*gb', 1), '') as double) as memory_gb,
    disk as disk_type, gpu as gpu_type, term as commitment_term,
    case when term is not null then 'resource' end as commitment_type,
    cast(case term when '1-year' then 25 when '3-year' then 37 else 0 end as double) as discount_percent,
    tier as network_tier, effective_date, cast(effective_date as timestamp) as last_updated,
    'cloud-billing-api' as pricing_source, is_active, 'valid' as validation_status, description,
    case when tier is not null then 'network' when {IS_GPU} then 'gpu' when disk is not null then 'storage'
      else 'compute' end as category,
    concat_ws(';', 'family:' || family, 'storage:' || replace(disk, 'pd-', ''), 'gpu:' || gpu,
      case when {PREEMPTIBLE} then 'usage:preemptible' end, 'commitment:' || term, 'network:' || tier,
      case when d like '%regional%' then 'scope:regional' when d like '%global%' then 'scope:global' end) as tags
  from found
)"""

ADHOC_ROWS = f"""
found_adhoc as (
  select *, nullif(regexp_extract(d, '({ADHOC_FAMILIES})-', 1), '') as family, {ADHOC_DISK} as disk, {GPU} as gpu,
    {TERM} as term
  from parts where {IS_ADHOC}
),
adhoc as (
  select sku_id, description as sku_name, 'Compute Engine' as service_name, '6F81-5844-456A' as service_id,
    'Compute' as resource_family,
    case when family is null then 'Standard' else upper(family) || 'Standard' end as resource_group,
    case when term is not null then 'Committed' when {PREEMPTIBLE} then 'Preemptible' else 'OnDemand' end
      as usage_type,
    region, 'USD' as currency_code, 'h' as pricing_unit, price as price_per_unit, family as machine_family,
    nullif(regexp_extract(d, '({ADHOC_FAMILIES})-[a-z0-9-]+', 0), '') as machine_type,
    cast(nullif(regexp_extract(d, '(\\d+)\\s*vcpu', 1), '') as bigint) as vcpu_count,
    cast(nullif(regexp_extract(d, '(\\d+(?:\\.\\d+)?)\\s*gb', 1), '') as double) as memory_gb,
    disk as disk_type, gpu as gpu_type, term as commitment_term, '2001-08-01' as effective_date,
    '2001-08-01 00:00:00' as last_updated, true as is_active, 'valid' as validation_status, description,
    case when {IS_GPU} then 'gpu' when disk is not null then 'storage' else 'compute' end as category,
    units
  from found_adhoc
)"""
ADHOC = f"{PARTS},{ADHOC_ROWS}"

# Usage types and disk rates.
USAGE = (
    "case when pricing_model in ('spot', 'preemptible') then 'Preemptible' "
    "when pricing_model in ('cud-1-year', 'cud-3-year') then 'Committed' else 'OnDemand' end"
)
DISK_RATE = "case {0} when 'pd-ssd' then 0.17e0 when 'pd-balanced' then 0.1e0 else 0.04e0 end"

PRICED = f"""{CATALOG},
used as (select *, {USAGE} as wanted_usage, case when gpu_count > 0 then gpu_type end as wanted_gpu from specs),
compute_ranked as (
  select k.*, c.price_per_unit as compute_hit, row_number() over (
    partition by k.wanted_usage, k.machine_type, k.region
    order by case when c.machine_type = k.machine_type then 1 else 2 end,
      case when c.region = k.region then 1 else 2 end, c.effective_date desc, c.sku_id) as place
  from (select distinct wanted_usage, machine_type, region from used) k
  join catalog c on c.is_active and c.service_name = 'Compute Engine' and c.category = 'compute'
    and c.usage_type = k.wanted_usage
    and (c.machine_type = k.machine_type or c.machine_family = split_part(k.machine_type, '-', 1))
    and (c.region = k.region or c.region is null)
),
storage_ranked as (
  select k.*, c.price_per_unit as storage_hit, row_number() over (
    partition by k.disk_type, k.region
    order by case when c.region = k.region then 1 else 2 end, c.effective_date desc, c.sku_id) as place
  from (select distinct disk_type, region from used) k
  join catalog c on c.is_active and c.service_name = 'Compute Engine' and c.category = 'storage'
    and c.disk_type = k.disk_type and (c.region = k.region or c.region is null)
),
gpu_ranked as (
  select k.*, c.price_per_unit as gpu_hit, row_number() over (
    partition by k.wanted_gpu, k.region
    order by case when c.region = k.region then 1 else 2 end, c.effective_date desc, c.sku_id) as place
  from (select distinct wanted_gpu, region from used where wanted_gpu is not null) k
  join catalog c on c.is_active and c.service_name = 'Compute Engine' and c.category = 'gpu'
    and c.gpu_type = k.wanted_gpu and (c.region = k.region or c.region is null)
),
priced as (
  select u.*,
    coalesce(compute_hit, vcpu_count * 0.0475e0 + memory_gb * 0.0063e0) as compute_price_per_hour,
    0e0 as memory_price_per_gb_hour,
    coalesce(storage_hit, {DISK_RATE.format('u.disk_type')}) as storage_price_per_gb_month,
    coalesce(gpu_hit, 0e0) as gpu_price_per_hour
  from used u
  left join compute_ranked c on c.place = 1 and c.wanted_usage = u.wanted_usage
    and c.machine_type = u.machine_type and c.region = u.region
  left join storage_ranked s on s.place = 1 and s.disk_type = u.disk_type and s.region = u.region
  left join gpu_ranked g on g.place = 1 and g.wanted_gpu = u.wanted_gpu and g.region = u.region
)"""

LINES = f"""{PRICED},
costed as (
  select *,
    compute_price_per_hour * usage_duration_hours as compute_cost_usd,
    0e0 as memory_cost_usd,
    storage_price_per_gb_month * disk_size_gb * (usage_duration_hours / 730e0) as storage_cost_usd,
    case when gpu_count > 0 then gpu_price_per_hour * gpu_count * usage_duration_hours else 0e0 end as gpu_cost_usd,
    case when external_ip then 0.004e0 * usage_duration_hours else 0e0 end as network_cost_usd
  from priced
),
percents as (
  select *,
    case when pricing_model not in ('spot', 'preemptible', 'cud-1-year', 'cud-3-year')
      and usage_duration_hours > 183 and usage_pattern = 'continuous'
      then least(30e0, floor((usage_duration_hours - 183) / 73e0) * 5) else 0e0 end
      as sustained_use_discount_percent,
    case pricing_model when 'cud-1-year' then 25e0 when 'cud-3-year' then 37e0 else 0e0 end
      as committed_use_discount_percent,
    case when pricing_model in ('spot', 'preemptible') then 60e0 else 0e0 end as spot_discount_percent
  from costed
),
amounts as (
  select *,
    (compute_cost_usd + gpu_cost_usd) * (sustained_use_discount_percent / 100e0) as sustained_use_discount_usd,
    (compute_cost_usd + gpu_cost_usd) * (committed_use_discount_percent / 100e0) as committed_use_discount_usd,
    (compute_cost_usd + gpu_cost_usd) * (spot_discount_percent / 100e0) as spot_discount_usd,
    compute_cost_usd + memory_cost_usd + storage_cost_usd + network_cost_usd + gpu_cost_usd as subtotal_usd
  from percents
),
discounted as (
  select *, sustained_use_discount_usd + committed_use_discount_usd + spot_discount_usd as total_discount_usd
  from amounts
),
lines as (
  select *, greatest(0e0, subtotal_usd - total_discount_usd) as total_cost_usd,
    cast(created_at as date) as calc_date
  from discounted
)"""

DISKS = f"""
disk_rows as ({DISK_ROWS}),
disk_costs as (
  select l_orderkey, rn, k.disk_type, size_gb, {DISK_RATE.format('k.disk_type')} as price_per_gb_month,
    {DISK_RATE.format('k.disk_type')} * size_gb * ((l_orderkey % 900) / 730e0) as cost_usd
  from disk_rows k
)"""

MICROS = "cast(sum(cast(round({0} * 1e6) as bigint)) as double) / 1e6"
COST = MICROS.format("total_cost_usd")
DISCOUNT = MICROS.format("total_discount_usd")
NANOS_AVG = "cast(sum(cast(round(price_per_unit * 1e9) as bigint)) as double) / 1e9 / count(price_per_unit)"
RECENT = "calc_date >= cast(date '2001-08-01' - interval 30 day as date)"

# What two writers have stored after the second ran again.
WRITTEN = "not (cast(substr(boq_id, 5) as bigint) % 2 = 1 and cast(substr(resource_id, 5) as bigint) % 2 = 1)"

MONTH = "cast(date_trunc('month', {0}) as date)"

SPEC_COLUMNS = ", ".join(registry.SPEC_COLUMNS)
LINE_COLUMNS = ", ".join(registry.LINE_COLUMNS)
PRICES = ", ".join(registry.PRICES)
CATALOG_COLUMNS = ", ".join(registry.CATALOG_COLUMNS)
FILTERED = "region in ('us-central1', 'us-east1') and pricing_model in ('spot', 'cud-1-year')"
CREATED = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"
MAINTAINED = "sku_id, price_per_unit"
CATALOG_DATES = "cast(effective_date as varchar) as effective_date"
UPDATED = "strftime(last_updated, '%Y-%m-%d %H:%M:%S')"
RETIRED = "is_active and effective_date < date '2001-04-03'"
PAGE_SQL = (
    f"select {SPEC_COLUMNS}, {CREATED} as created_at from specs where region = 'us-east1' "
    "order by specs.created_at desc, resource_id, project_id limit 50 offset 50"
)
RESOURCE_STATS = """
  select count(distinct project_id) as total_projects, count(*) as total_resources,
    count(distinct region) as total_regions, cast(sum(vcpu_count) as double) / count(vcpu_count) as avg_vcpu,
    cast(sum(cast(round(memory_gb * 1e6) as bigint)) as double) / 1e6 / count(memory_gb) as avg_memory,
    count(case when pricing_model = 'spot' then 1 end) as spot_resources
  from specs"""
RESULT_STATS = f"""
  select count(distinct boq_id) as total_calculations, {COST} as total_cost,
    {COST} / count(total_cost_usd) as avg_cost, count(*) as total_boq_items
  from lines where {RECENT}"""
SUMMARY = f"""
  select count(*) as total_resources, {COST} as total_cost_usd, {DISCOUNT} as total_discount_usd,
    {COST} / count(total_cost_usd) as average_cost_per_resource
  from lines"""
REFRESHED = f"""
  select * from (
    select {MAINTAINED}, is_active and not ({RETIRED}) as is_active, effective_date,
      case when {RETIRED} then timestamp '2001-04-03 02:00:00' else last_updated end as last_updated
    from catalog
    union all
    select {MAINTAINED}, true, date '2001-04-03', timestamp '2001-04-03 02:00:00' from catalog
  ) as merged
  where is_active or effective_date >= cast(date '2001-04-03' - interval 90 day as date)"""
REQUESTED = f"""
  select 'p' || substr(project_id, 6) as new_id, * from lines
  union all
  select 'r' || cast(r_regionkey as varchar), lines.* from lines join region
    on lines.region = 'us-east1' or (lines.region = 'europe-west1' and r_regionkey > 1)
  where r_regionkey <= 2 or pricing_model = 'spot'
  union all
  select 'all', * from lines"""
REQUEST_COLUMNS = ", ".join(["new_id as boq_id", *registry.LINE_COLUMNS[1:]])


def _page(source: str, order: str, limit: int, offset: int, columns: str) -> str:
    return f"select {columns} from {source} order by {order} limit {limit} offset {offset}"


PERIOD = " + ".join(f"case when calc_date >= date '{start}' then 1 else 0 end" for start in registry.PERIODS)


def oracle_sql() -> dict[str, str]:
    def parts(text: str) -> str:
        return f"with {PARTS} {text}"

    def catalog(text: str) -> str:
        return f"with {CATALOG} {text}"

    def adhoc(text: str) -> str:
        return f"with {ADHOC} {text}"

    def priced(text: str) -> str:
        return f"with {PRICED} {text}"

    def lines(text: str) -> str:
        return f"with {LINES} {text}"

    result_order = "lines.created_at desc, resource_id, boq_id, project_id"
    stamped = f"{LINE_COLUMNS}, {CREATED} as calculation_timestamp"
    refreshed = catalog(
        f"select {MAINTAINED}, is_active, {CATALOG_DATES}, {UPDATED} as last_updated from ({REFRESHED}) as kept"
    )
    requested = lines(f"select {REQUEST_COLUMNS}, 'batch' as requested_by from ({REQUESTED}) as wanted")
    return {
        "sku_relevant": parts(f"select sku_id, description from parts where {IS_RELEVANT}"),
        "sku_prefilter": parts(f"select sku_id, description from parts where {IS_ADHOC}"),
        "sku_prefilter_region": adhoc(
            "select sku_id, region, category from adhoc "
            "where region = 'us-west1' or (region is not null and units = 1)"
        ),
        "sku_base_price": parts("select sku_id, price as price_per_unit from parts where price <> 0"),
        "sku_tiers": catalog("select sku_id, tiered_rates from catalog where tiered_rates is not null"),
        "catalog_tags": catalog("select sku_id, tags from catalog"),
        "catalog_daily": catalog(
            "select * replace ('2001-08-01' as effective_date, '2001-08-01 00:00:00' as last_updated, "
            "true as is_active) from catalog"
        ),
        "catalog_adhoc": adhoc("select * exclude (units) from adhoc"),
        "specs_filter": parts(
            f"select {SPEC_COLUMNS} from specs where {FILTERED} order by project_id, resource_id"
        ),
        "spec_defaults": parts(
            "select resource_id, 'continuous' as usage_pattern, 'on-demand' as pricing_model, gpu_count, "
            "'standard' as network_tier, false as external_ip, cast(null as varchar) as zone, "
            "'2001-08-01 00:00:00' as updated_at from specs"
        ),
        "spec_rejects": parts(
            "select resource_id, concat_ws(';', case when machine_type = 'x9-odd-1' then 'machine_type' end, "
            "case when disk_size_gb >= 500 then 'disk_size_gb' end) as missing_columns "
            "from specs where machine_type = 'x9-odd-1' or disk_size_gb >= 500"
        ),
        "spec_backdate": parts(
            "select resource_id, strftime(case "
            "when resource_id like '%1' then timestamp '2001-08-01' - to_days(cast(h % 31 as int)) "
            "when resource_id like '%2' then timestamp '2001-08-01' - to_days(cast(h % 8 as int)) "
            "else created_at end, '%Y-%m-%d %H:%M:%S') as created_at "
            "from (select *, cast('0x' || substr(md5(resource_id), 1, 8) as bigint) as h from specs) as hashed"
        ),
        "projects": parts("select distinct project_id from specs order by project_id"),
        "regions": parts("select distinct region from specs where region is not null order by region"),
        "resource_count": parts("select count(*) as count from specs where project_id = 'proj-3'"),
        "resources_page": parts(PAGE_SQL),
        "resources_deep_page": parts(PAGE_SQL),
        "resources_stored_page": parts(PAGE_SQL),
        "page_info": parts(
            "select cast(2 as bigint) as current_page, cast(ceil(count(*) / 50e0) as bigint) as total_pages, "
            "100 < count(*) as has_next, true as has_prev from specs"
        ),
        "price_compute": priced("select resource_id, compute_price_per_hour from priced"),
        "price_storage": priced("select resource_id, storage_price_per_gb_month from priced"),
        "price_gpu": priced("select resource_id, gpu_price_per_hour from priced"),
        "price_all": priced(f"select {PRICES} from priced"),
        "price_all_stored": priced(f"select {PRICES} from priced"),
        "price_all_large_book": priced(f"select {PRICES} from priced"),
        "boq_base_costs": lines(
            "select resource_id, compute_cost_usd, memory_cost_usd, storage_cost_usd, network_cost_usd, "
            "gpu_cost_usd from lines"
        ),
        "boq_discounts": lines(
            "select resource_id, sustained_use_discount_percent, committed_use_discount_percent, "
            "spot_discount_percent, sustained_use_discount_usd, committed_use_discount_usd, spot_discount_usd "
            "from lines"
        ),
        "boq_totals": lines("select resource_id, subtotal_usd, total_discount_usd, total_cost_usd from lines"),
        "boq_disks": (
            f"with {PARTS}, {DISKS} select resource_id, cast(rn - 1 as bigint) as disk_no, k.disk_type, k.size_gb, "
            "k.cost_usd, k.price_per_gb_month from specs left join disk_costs k "
            "on resource_id = 'res-' || cast(l_orderkey as varchar)"
        ),
        "boq_lines": lines(
            f""", {DISKS},
            disk_texts as (
              select l_orderkey, string_agg(disk_type || '|' || cast(size_gb as varchar) || '|'
                || cast(cast(round(cost_usd * 1e6) as bigint) as varchar) || '|'
                || cast(cast(round(price_per_gb_month * 1e6) as bigint) as varchar), ';' order by rn) as disks
              from disk_costs group by l_orderkey
            )
            select boq_id, {CREATED} as calculation_timestamp, 'tester' as requested_by, resource_id, project_id,
              cast(null as varchar) as instance_name, machine_type, vcpu_count, memory_gb, disk_type, disk_size_gb,
              region, pricing_model, usage_duration_hours, usage_pattern, compute_cost_usd, memory_cost_usd,
              storage_cost_usd, network_cost_usd, gpu_cost_usd, compute_price_per_hour, memory_price_per_gb_hour,
              storage_price_per_gb_month, sustained_use_discount_percent, committed_use_discount_percent,
              spot_discount_percent, subtotal_usd, total_discount_usd, total_cost_usd,
              coalesce(disks, '') as additional_storage_costs, cast(calc_date as varchar) as pricing_date,
              '1.0' as calculation_version, cost_center, environment, cast(null as varchar) as team
            from lines left join disk_texts on resource_id = 'res-' || cast(l_orderkey as varchar)"""
        ),
        "boq_lines_by_id": lines(f"select {LINE_COLUMNS} from lines where boq_id = 'boq-5'"),
        "results_page": lines(_page("lines where boq_id = 'boq-5'", result_order, 50, 0, stamped)),
        "results_count": lines("select count(*) as count from lines where boq_id = 'boq-5'"),
        "recent_results_page": lines(_page("lines where project_id = 'proj-3'", result_order, 50, 50, stamped)),
        "recent_count": lines("select count(*) as count from lines where project_id = 'proj-3'"),
        "boq_requests": requested,
        "stream_boq": requested,
        "stream_and_run": lines(
            f"select boq_id, count(*) as lines, {COST} as total_cost_usd from ("
            f"select new_id as boq_id, total_cost_usd from ({REQUESTED}) as wanted union all "
            "select 'run', total_cost_usd from lines where region in ('us-central1', 'us-east1')) as both_kinds "
            "group by boq_id"
        ),
        "boq_summary": lines(SUMMARY),
        "run_boq": lines(f"{SUMMARY} where {FILTERED}"),
        "cost_by_project": lines(f"select project_id, {COST} as total_cost_usd from lines group by project_id"),
        "cost_by_region": lines(f"select region, {COST} as total_cost_usd from lines group by region"),
        "boq_summary_by_id": lines(
            f"select count(*) as total_resources, {COST} as total_cost, {DISCOUNT} as total_discount, "
            f"{COST} / count(*) as avg_cost_per_resource, count(distinct project_id) as projects_count, "
            "count(distinct region) as regions_count from lines where boq_id = 'boq-5'"
        ),
        "dash_resources": parts(RESOURCE_STATS),
        "dash_results": lines(RESULT_STATS),
        "dashboard": lines(f"select * from ({RESOURCE_STATS}) as a, ({RESULT_STATS}) as b"),
        "cost_history": lines(
            f"select cast(calc_date as varchar) as date, count(distinct boq_id) as calculations, "
            f"count(*) as total_resources, {COST} as total_cost from lines where {RECENT} "
            "group by calc_date order by calc_date desc"
        ),
        "results_append": lines(
            "select cast(calc_date as varchar) as date, count(distinct boq_id) as calculations, "
            f"count(*) as total_resources, {COST} as total_cost from lines group by 1"
        ),
        "results_pruned": lines(
            "select cast(calc_date as varchar) as date, count(distinct boq_id) as calculations, "
            f"count(*) as total_resources, {COST} as total_cost from lines "
            "where calc_date >= cast(date '2001-08-01' - interval 365 day as date) group by 1"
        ),
        "rollup_updates": lines(
            "select cast(calc_date as varchar) as calc_date, project_id, region, pricing_model, "
            "count(*) as line_count, cast(sum(cast(round(total_cost_usd * 1e6) as bigint)) as bigint) as cost_micros, "
            "cast(sum(cast(round(total_discount_usd * 1e6) as bigint)) as bigint) as discount_micros "
            f"from lines where {WRITTEN} group by all"
        ),
        "rollup_history": lines(
            "select cast(calc_date as varchar) as date, count(distinct boq_id) as calculations, "
            f"count(*) as total_resources, {COST} as total_cost from lines where {WRITTEN} "
            "and calc_date >= cast(date '2001-08-01' - interval 365 day as date) group by 1 order by 1 desc"
        ),
        "rollup_stats": lines(
            f"select count(distinct boq_id) as total_calculations, {COST} as total_cost, "
            f"{COST} / count(total_cost_usd) as avg_cost, count(*) as total_boq_items from lines where {WRITTEN} "
            "and calc_date >= cast(date '2001-08-01' - interval 365 day as date)"
        ),
        "stored_run": lines(
            f"select {LINE_COLUMNS}, cast(calc_date as varchar) as calc_date from lines where boq_id = 'boq-5'"
        ),
        "today_by_project": lines(
            f"select project_id, {COST} as total_cost, count(*) as resource_count from lines "
            "where calc_date = date '2001-08-01' group by project_id order by total_cost desc, project_id"
        ),
        "table_layout": parts(
            "select cast(cast(created_at as date) as varchar) as created_date, region, count(*) as resources "
            "from specs group by 1, 2"
        ),
        "specs_clustered": parts(
            f"select {', '.join(registry.SPEC_COLUMNS)} from specs "
            "where project_id = 'proj-5' and pricing_model in ('spot', 'cud-1-year')"
        ),
        "catalog_page": catalog(
            _page(
                "catalog where is_active",
                "service_name, category, sku_name, sku_id, catalog.effective_date, catalog.last_updated, usage_type, region, "
                "price_per_unit",
                100,
                100,
                f"{CATALOG_COLUMNS}, {CATALOG_DATES}",
            )
        ),
        "catalog_count": catalog(
            "select count(*) as count from catalog where is_active and service_name = 'Compute Engine' "
            "and category = 'compute' and region = 'us-central1'"
        ),
        "update_report": catalog(
            f"select category, service_name, count(*) as record_count, {NANOS_AVG} as avg_price, "
            "min(price_per_unit) as min_price, max(price_per_unit) as max_price from catalog "
            "where effective_date = date '2001-04-03' and is_active group by category, service_name "
            "order by category, service_name"
        ),
        "refresh_job": catalog(
            f"select category, service_name, count(*) as record_count, {NANOS_AVG} as avg_price, "
            "min(price_per_unit) as min_price, max(price_per_unit) as max_price, '2001-04-03' as effective_date, "
            "(select count(*) from catalog) as total_records from ("
            "select category, service_name, price_per_unit from catalog union all "
            "select category, service_name, price_per_unit from catalog "
            "where effective_date = date '2001-04-03' and is_active) as fresh "
            "group by category, service_name order by category, service_name"
        ),
        "catalog_deactivate": catalog(
            f"select {MAINTAINED}, is_active and not ({RETIRED}) as is_active, {CATALOG_DATES}, "
            f"case when {RETIRED} then '2001-04-03 02:00:00' else {UPDATED} end as last_updated from catalog"
        ),
        "catalog_retention": catalog(
            f"select {MAINTAINED}, is_active, {CATALOG_DATES}, {UPDATED} as last_updated from catalog "
            "where is_active or effective_date >= cast(date '2001-08-01' - interval 90 day as date)"
        ),
        "catalog_refresh": refreshed,
        "stream_refresh": refreshed,
        "catalog_append": (
            f"with {CATALOG}, {ADHOC_ROWS} "
            "select category, effective_date, count(*) as skus from ("
            "select category, cast(effective_date as varchar) as effective_date from catalog union all "
            "select category, effective_date from adhoc) as stored group by category, effective_date"
        ),
        "report_format": lines(
            "select resource_id, "
            "'$' || format('{:,.2f}', cast(round(cast(cast(total_cost_usd as varchar) as decimal(38, 18)), 2) "
            "as double)) as currency, "
            "printf('%.2f', case when total_cost_usd * 8 % 2 = 1 then total_cost_usd + 0.001e0 "
            "else total_cost_usd end) as fixed, "
            "strftime(created_at, '%-m/%-d/%Y') as date, "
            "'{\"resource_id\":\"' || resource_id || '\",\"vcpu_count\":' || cast(vcpu_count as varchar) "
            "|| ',\"usage_pattern\":' || coalesce('\"' || usage_pattern || '\"', 'null') || '}' as json from lines"
        ),
        "budget_check": lines(
            "select *, coalesce(total_cost_usd > budget_threshold, false) as over_budget from ("
            f"select cost_center, {COST} as total_cost_usd, case cost_center "
            + " ".join(f"when '{name}' then {limit!r}e0" for name, limit in registry.BUDGETS.items())
            + " end as budget_threshold from lines group by cost_center) as centers"
        ),
        "budget_crossings": lines(
            """, steps as (
              select cost_center, calc_date, resource_id, boq_id, cast(round(total_cost_usd * 1e6) as bigint) as m,
                case cost_center """
            + " ".join(f"when '{name}' then {limit!r}e0" for name, limit in registry.CROSSED_BUDGETS.items())
            + """ end as budget_threshold
              from lines
            ),
            summed as (
              select *, sum(m) over (partition by cost_center order by calc_date, resource_id, boq_id) as reached
              from steps where budget_threshold is not null
            )
            select cost_center, cast(calc_date as varchar) as calc_date, resource_id, boq_id,
              cast(reached as double) / 1e6 as reached_usd, budget_threshold
            from summed where reached > budget_threshold * 1e6
            qualify row_number() over (partition by cost_center order by calc_date, resource_id, boq_id) = 1"""
        ),
        "results_retention": lines(
            f"select {LINE_COLUMNS}, cast(calc_date as varchar) as calc_date from lines "
            "where calc_date >= cast(date '2001-08-01' - interval 365 day as date)"
        ),
        "daily_rollup": lines(
            "select cast(calc_date as varchar) as calc_date, project_id, region, pricing_model, "
            "count(*) as line_count, cast(sum(cast(round(total_cost_usd * 1e6) as bigint)) as bigint) as cost_micros, "
            "cast(sum(cast(round(total_discount_usd * 1e6) as bigint)) as bigint) as discount_micros "
            "from lines group by all"
        ),
        "monthly_cost": lines(
            f"select cast({MONTH.format('calc_date')} as varchar) as month, project_id, "
            f"count(*) as line_count, {COST} as total_cost_usd from lines group by 1, 2"
        ),
        "cost_anomaly": lines(
            f""", sums as (
              select project_id, count(*) as n, sum(cast(m as hugeint)) as s, sum(cast(m as hugeint) * m) as q
              from (select project_id, cast(round(total_cost_usd * 1e6) as bigint) as m from lines) as micros
              group by project_id having count(*) > 1
            ),
            moved as (select *, s // n as m, s % n as r from sums),
            limits as (
              select project_id, (cast(m as double) + cast(r as double) / n
                + {registry.ANOMALY_SIGMAS}e0 * sqrt(greatest(0e0, (cast(q - m * (s + r) as double)
                - cast(r as double) * cast(r as double) / n) / (n - 1e0)))) / 1e6 as cost_limit
              from moved
            )
            select resource_id, project_id, total_cost_usd, cost_limit from lines join limits using (project_id)
            where total_cost_usd > cost_limit"""
        ),
        # Squares go through text, because the engine's cast of integers beyond 64 bits is not always to the nearest double.
        "stream_anomalies": lines(
            f""", dealt as (
              select resource_id, project_id, total_cost_usd, cast(round(total_cost_usd * 1e6) as bigint) as c,
                {PERIOD} as period
              from lines
            ),
            sums as (
              select later.period, project_id, count(*) as n, sum(cast(c as hugeint)) as s, sum(cast(c as hugeint) * c) as q
              from (select distinct period from dealt) as later join dealt on dealt.period < later.period
              group by later.period, project_id having count(*) > 1
            ),
            moved as (select *, s // n as m, s % n as r from sums),
            limits as (
              select period, project_id, (cast(m as double) + cast(r as double) / n
                + {registry.ANOMALY_SIGMAS}e0 * sqrt(greatest(0e0, (cast(cast(q - m * (s + r) as varchar) as double)
                - cast(r as double) * cast(r as double) / n) / (n - 1e0)))) / 1e6 as cost_limit
              from moved
            )
            select resource_id, project_id, total_cost_usd, cost_limit from dealt join limits using (period, project_id)
            where total_cost_usd > cost_limit"""
        ),
        "catalog_staleness": catalog(
            "select service_name, strftime(max(last_updated), '%Y-%m-%d %H:%M:%S') as last_updated, "
            "date_diff('second', max(last_updated), timestamp '2001-08-01') / 3600e0 as age_hours, "
            "date_diff('second', max(last_updated), timestamp '2001-08-01') / 3600e0 > 24 as is_stale "
            "from catalog where is_active group by service_name"
        ),
        "cost_by_machine_class": lines(
            "select case when split_part(machine_type, '-', 1) in ('n1', 'n2', 'n2d', 'e2') then 'general_purpose' "
            "when split_part(machine_type, '-', 1) in ('c2', 'c2d') then 'compute_optimized' "
            "when split_part(machine_type, '-', 1) in ('m1', 'm2') then 'memory_optimized' "
            "when split_part(machine_type, '-', 1) = 'a2' then 'accelerator_optimized' else 'other' end "
            f"as machine_class, {COST} as total_cost_usd from lines group by 1"
        ),
    }
