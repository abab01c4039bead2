"""The plans we want: what is broadcast, shuffled, pushed down and pruned."""

import re

import pytest

from costloom.operators import catalog as catalogs
from costloom.operators import costing, paging, pricing, reports
from costloom.sources import tables
from samples import NOW, TODAY, catalog_of, spec, specs_of
from workload import inputs


def plan(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def nodes(frame):
    tree = plan(frame).split("\n\n")[0]
    return re.findall(r"^[\s:+\-*]*([A-Z]\w+)", tree, flags=re.M)


def test_cost_lines_never_shuffle_the_resources(spark, sf_dir):
    specs = inputs.specs(spark, sf_dir).select("*")
    lines = costing.boq_lines(specs, inputs.catalog(spark, sf_dir), "b", NOW)
    kinds = nodes(lines)
    assert kinds.count("BroadcastHashJoin") == 11  # three build the input, eight look up prices
    for bad in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Window"):
        assert bad not in kinds
    assert not [k for k in kinds if "Python" in k or "Pandas" in k]
    # Nothing is shuffled, also not to build the broadcast sides.
    assert "Exchange" not in kinds


def test_large_books_use_no_cross_join(spark, sf_dir):
    priced = pricing.price_all(inputs.specs(spark, sf_dir), inputs.catalog(spark, sf_dir), max_rows=0)
    kinds = nodes(priced)
    assert "BroadcastNestedLoopJoin" not in kinds and "CartesianProduct" not in kinds


def test_catalog_build_is_one_narrow_stage(spark, sf_dir):
    built = catalogs.build_catalog(inputs.feed(spark, sf_dir), TODAY, NOW)
    kinds = nodes(built)
    assert "Exchange" not in kinds and "BroadcastExchange" not in kinds
    assert not [k for k in kinds if "Python" in k]


def test_scans_read_only_needed_columns(spark, sf_dir):
    text = plan(reports.cost_by(inputs.lines(spark, sf_dir), "region"))
    orders = re.search(r"orders.parquet\].*?ReadSchema: (\S+)", text, flags=re.S).group(1)
    assert "o_totalprice" not in orders
    customer = re.search(r"customer.parquet\].*?ReadSchema: (\S+)", text, flags=re.S).group(1)
    assert customer == "struct<c_custkey:bigint,c_nationkey:int>"


def test_date_reports_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.append_lines(costing.boq_lines(specs_of(spark, spec()), catalog_of(spark), "b", NOW), path, "all")
    stored = tables.read(spark, path, "results")
    for report in (
        reports.cost_history(stored, TODAY),
        reports.today_by_project(stored, TODAY),
        reports.result_stats(stored, TODAY),
    ):
        text = plan(report)
        assert re.search(r"PartitionFilters: \[isnotnull\(calc_date#\d+\), \(calc_date#\d+ (>=|=) ", text), text
    # The lines of a run share files, so a run's id skips other files by their value ranges.
    assert re.search(r"PushedFilters: .*EqualTo\(boq_id,b\)", plan(stored.where("boq_id = 'b'")))
    assert "additional_storage_costs" not in re.search(r"ReadSchema: (.*)", plan(reports.cost_history(stored, TODAY)))[1]


def test_writing_one_day_does_not_shuffle(spark):
    lines = costing.boq_lines(specs_of(spark, spec()), catalog_of(spark), "b", NOW)
    top = plan(tables.lay_out(lines, "results")).split("\n\n")[0]
    before_join = top.split("BroadcastHashJoin")[0]
    assert "Exchange" not in before_join and "Sort" in before_join


def test_refresh_is_narrow(spark):
    from costloom.operators import maintenance

    merged = maintenance.refresh(catalog_of(spark), catalog_of(spark), TODAY, NOW)
    assert "Exchange" not in nodes(merged)


def test_pages_are_top_k(spark, sf_dir):
    page = paging.page(inputs.specs(spark, sf_dir), paging.SPEC_ORDER, 3, 50)
    assert "TakeOrderedAndProject" in nodes(page)


def test_disks_share_one_exchange_on_the_order_key(spark, sf_dir):
    text = plan(inputs.specs_with_disks(spark, sf_dir))
    exchanges = re.findall(r"hashpartitioning\((\w+)#", text)
    assert exchanges.count("l_orderkey") == 1 and "resource_id" not in exchanges


def test_every_order_line_is_a_disk(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert inputs.specs_with_disks(spark, sf_dir).selectExpr("sum(size(additional_disks))").first()[0] == lines


def test_distinct_counts_do_not_multiply_rows(spark, sf_dir):
    lines = inputs.lines(spark, sf_dir)
    for report in (
        reports.resource_stats(inputs.specs(spark, sf_dir)),
        reports.result_stats(lines, inputs.AS_OF),
        reports.cost_history(lines, inputs.AS_OF),
    ):
        tree = plan(report).split("\n\n")[0]
        # Expand may appear above the pre-aggregated rows, never directly over the scan.
        below = tree[tree.rfind("Expand") :] if "Expand" in tree else ""
        assert not below or "HashAggregate" in below


@pytest.mark.parametrize("name", ["dashboard"])
def test_dashboard_has_no_cross_join(spark, sf_dir, name):
    from workload import registry

    kinds = nodes(registry.QUERIES[name](spark, sf_dir))
    assert "BroadcastNestedLoopJoin" not in kinds and "CartesianProduct" not in kinds
