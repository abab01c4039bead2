"""Pages of a stored list against the whole list."""

import random

import pytest
from pyspark.sql import functions as F

from costloom.operators import paging
from costloom.sources import ordered

ORDER = [("a", "desc"), ("b", "asc")]


def some_rows(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, 1, 2, 3]), rng.randint(0, n), f"x{i}") for i in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    df = spark.createDataFrame(some_rows(500), "a int, b int, c string").repartition(6)
    return ordered.store(df, str(tmp_path / "lists"), ORDER)


@pytest.mark.parametrize("size", [7, 100, 499, 600])
def test_pages_join_to_the_whole_list(spark, folder, size):
    pages = [[tuple(r) for r in ordered.page(spark, folder, n, size).collect()] for n in range(1, 500 // size + 2)]
    joined = [row for page in pages for row in page]
    assert sorted(joined, key=str) == sorted(some_rows(500), key=str)
    key = lambda row: (-(row[0] or 0), row[1])
    assert [key(row) for row in joined] == sorted(map(key, joined))
    assert all(len(page) == size for page in pages[: 500 // size])
    assert ordered.page(spark, folder, 500 // size + 2, size).count() == 0


def test_a_changing_source_leaves_pages_alone(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame(some_rows(90), "a int, b int, c string").write.parquet(source)
    folder = ordered.store(spark.read.parquet(source), str(tmp_path / "lists"), ORDER)
    joined = []
    for number in range(1, 10):
        joined += [r["c"] for r in ordered.page(spark, folder, number, 10).collect()]
        more = spark.createDataFrame([(3, 0, f"new{number}")], "a int, b int, c string")
        more.write.mode("append").parquet(source)  # would be the first row of every page
    assert sorted(joined) == sorted(f"x{i}" for i in range(90))
    newer = ordered.store(spark.read.parquet(source), str(tmp_path / "lists"), ORDER)
    assert ordered.page_info(spark, newer, 1, 10).first()["total_pages"] == 10
    assert ordered.page_info(spark, folder, 1, 10).first()["total_pages"] == 9


def test_a_page_opens_its_ranges_only(spark, tmp_path):
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") * 7919 % 40_000).alias("b"), F.lit("t" * 9).alias("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = ordered.store(df, str(tmp_path / "lists"), ORDER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    page = ordered.page(spark, folder, 39_000 // 50, 50)
    assert [r["b"] for r in page.collect()] == list(range(38_950, 39_000))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [(({ordered.PART}" in plan or f"PartitionFilters: [isnotnull({ordered.PART}" in plan, plan
    assert ordered.PLACE in plan.split("PushedFilters: ")[1].split("]")[0]


def test_empty_list_and_bad_numbers(spark, tmp_path):
    folder = ordered.store(spark.createDataFrame([], "a int, b int, c string"), str(tmp_path / "lists"), ORDER)
    assert ordered.page(spark, folder, 1, 50).count() == 0
    info = ordered.page_info(spark, folder, 1, 50).first()
    assert tuple(info) == tuple(paging.page_info(spark.createDataFrame([], "a int"), 1, 50).first())
    for number, size in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            ordered.page(spark, folder, number, size)
    ordered.drop(spark, folder)


def test_facts_equal_those_of_the_list(spark, folder):
    df = spark.createDataFrame(some_rows(500), "a int, b int, c string")
    for number, size in ((1, 50), (10, 50), (11, 50), (2, 499)):
        assert ordered.page_info(spark, folder, number, size).first() == paging.page_info(df, number, size).first()
