"""Registered queries against SQL on the smallest tables. ``python check.py`` compares all of them."""

import json
import os
import re

import pytest

import __spark_entry__ as entry
import check
from workload import oracles, registry

# One or more of each operator family; set COSTLOOM_ALL=1 for all.
CHOSEN = [
    "sku_prefilter_region", "sku_base_price", "catalog_daily", "catalog_adhoc", "specs_filter", "spec_defaults",
    "spec_rejects", "spec_backdate", "resources_page", "resources_deep_page", "page_info", "price_all",
    "price_all_large_book", "boq_disks", "boq_lines", "boq_requests", "boq_discounts", "dashboard", "cost_history",
    "boq_summary_by_id", "update_report", "catalog_refresh", "catalog_page", "results_append", "cost_anomaly",
    "daily_rollup", "budget_check", "budget_crossings", "price_all_stored", "stream_refresh", "report_format",
    "run_boq", "refresh_job", "catalog_append", "stream_and_run", "table_layout", "resources_stored_page",
    "specs_clustered", "stream_anomalies",
]


def names():
    return sorted(oracles.oracle_sql()) if os.environ.get("COSTLOOM_ALL") else CHOSEN


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.duck(sf_dir)


@pytest.mark.parametrize("name", names())
def test_equal(spark, duck, sf_dir, name):
    assert check.compare(spark, duck, sf_dir, name) is None


def test_every_query_has_sql():
    assert set(oracles.oracle_sql()) == set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1500


def test_report_format(spark, sf_dir):
    rows = entry.queries()["report_format"](spark, sf_dir)
    assert rows.count() == 1500
    for row in rows.take(50):
        assert re.fullmatch(r"\$(\d{1,3},)*\d{1,3}\.\d\d", row["currency"])
        assert row["currency"][1:].replace(",", "") == row["fixed"]
        assert re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4}", row["date"])
        assert json.loads(row["json"]).keys() == {"resource_id", "vcpu_count", "usage_pattern"}
