"""The stored rollup against a full recomputation, and lookups of single runs."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from costloom.operators import reports
from costloom.plans import jobs, listings
from costloom.sources import rollups, tables
from tests.samples import NOW, catalog_of, seed_specs
from workload import registry

DAYS = [date(2024, 4, 28) + timedelta(days=i) for i in range(9)]  # over the end of a month
FIELDS = "calc_date date, boq_id string, project_id string, region string, pricing_model string, total_cost_usd double, total_discount_usd double"


def some_lines(rng, writer):
    return [
        (
            rng.choice(DAYS), rng.choice([f"{writer}-{i}" for i in range(4)] + ["shared", None]), rng.choice(["p1", "p2", None]),
            rng.choice(["r1", "r2"]), "spot", rng.choice([None, 0.0, round(rng.random() * 9, 6)]), round(rng.random(), 6),
        )
        for _ in range(rng.randint(0, 25))
    ]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_updates_equal_a_full_recomputation(spark, tmp_path):
    rng, path, now = random.Random(3), str(tmp_path / "rollup"), {}
    for step, writer in enumerate(["a", "b", "a", "c", "b", "b"]):
        now[writer] = [] if step == 4 else some_lines(rng, writer)  # once, nothing is left of a writer
        touched = rollups.update(spark.createDataFrame(now[writer], FIELDS), path, writer)
        assert set(touched) >= {r[0] for r in now[writer]} - set(touched) or step > 1
    whole = spark.createDataFrame([r for some in now.values() for r in some], FIELDS)
    as_of = DAYS[-1]
    expected = reports.daily_rollup(whole).select("calc_date", *rollups.GROUPS, "line_count", F.coalesce("cost_micros", F.lit(0)), F.coalesce("discount_micros", F.lit(0)))
    assert rows(rollups.by_group(spark, path).withColumn("cost_micros", F.col("cost_micros").cast("decimal(20,0)"))) == rows(expected)
    for days in (0, 3, 5, 400):
        assert rows(rollups.history(spark, path, as_of, days)) == rows(reports.cost_history(whole, as_of, days))
        assert rows(rollups.result_stats(spark, path, as_of, days)) == rows(reports.result_stats(whole, as_of, days))


def test_an_update_that_died_is_made_good(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "rollup")
    first, second = some_lines(rng, "a") + some_lines(rng, "a"), some_lines(rng, "a")
    rollups.update(spark.createDataFrame(first, FIELDS), path, "a")
    days = rows(rollups.by_group(spark, path))
    # The deltas of an update arrive, but the days are not made anew.
    broken = spark.createDataFrame([("a", "px", "r1", "spot", 7, 7, 7, 7, DAYS[0])], rollups.FIELDS["deltas"].replace("decimal(28,0)", "bigint"))
    broken.select(*(F.col(c).cast(t) for c, t in spark.createDataFrame([], rollups.FIELDS["deltas"]).dtypes)).write.mode("append").parquet(f"{path}/deltas")
    assert rows(rollups.by_group(spark, path)) == days
    rollups.update(spark.createDataFrame(second, FIELDS), path, "a")
    rollups.update(spark.createDataFrame(second, FIELDS), path, "a")
    other = str(tmp_path / "other")
    rollups.update(spark.createDataFrame(second, FIELDS), other, "a")
    assert rows(rollups.by_group(spark, path)) == rows(rollups.by_group(spark, other))


def test_numbers_of_runs_are_dense_and_stay(spark, tmp_path):
    path = str(tmp_path / "rollup")
    line = lambda run: (DAYS[0], run, "p", "r", "spot", 1.0, 0.0)
    rollups.update(spark.createDataFrame([line(f"x{i}") for i in range(100)], FIELDS).repartition(7), path, "a")
    before = dict(rollups.read(spark, path, "runs").collect())
    rollups.update(spark.createDataFrame([line(f"x{i}") for i in range(50, 180)], FIELDS).repartition(7), path, "b")
    after = dict(rollups.read(spark, path, "runs").collect())
    assert sorted(after.values()) == list(range(1, 181)) and before.items() <= after.items()
    assert rollups.result_stats(spark, path, DAYS[0], 0).first()["total_calculations"] == 180


def test_empty_rollup(spark, tmp_path):
    path = str(tmp_path / "rollup")
    assert rollups.update(spark.createDataFrame([], FIELDS), path, "a") == []
    assert rollups.history(spark, path, DAYS[0], 30).count() == 0
    assert tuple(rollups.result_stats(spark, path, DAYS[0], 30).first()) == (0, None, None, 0)


def test_a_writer_that_runs_again_replaces_all_its_lines(spark, tmp_path):
    path, rollup = str(tmp_path / "results"), str(tmp_path / "rollup")
    specs, catalog = seed_specs(spark), catalog_of(spark)
    run = lambda boq_id, now: jobs.run_boq(specs, catalog, path, boq_id=boq_id, now=now)
    n = run("one", NOW).lines.count()
    run("two: a/b", NOW)
    for writer in ("one", "two: a/b"):
        jobs.roll_up(spark, path, rollup, writer)
    assert tables.read(spark, path, "results").count() == 2 * n
    run("one", NOW + timedelta(days=1))  # another day
    assert {r[0] for r in tables.run_lines(spark, path, "one").select("calc_date").distinct().collect()} == {(NOW + timedelta(days=1)).date()}
    assert tables.run_lines(spark, path, "two: a/b").count() == n
    stored = tables.read(spark, path, "results")
    tables.append_lines(stored.where("false").drop("calc_date", tables.WRITER), path, "one")  # no line is left
    assert tables.read(spark, path, "results").count() == n and tables.run_lines(spark, path, "one").count() == 0
    jobs.roll_up(spark, path, rollup, "one")
    assert rollups.by_group(spark, rollup).agg(F.sum("line_count")).first()[0] == n


def test_a_lookup_of_one_run_opens_its_files_only(spark, tmp_path):
    path = str(tmp_path / "results")
    specs, catalog = seed_specs(spark), catalog_of(spark)
    for i in range(6):
        jobs.run_boq(specs, catalog, path, boq_id=f"run-{i}", now=NOW + timedelta(days=i))
    lines = tables.run_lines(spark, path, "run-4")
    assert lines.inputFiles() and all(f"/{tables.WRITER}=run-4/" in file for file in lines.inputFiles())
    assert rows(lines) == rows(tables.read(spark, path, "results").where("boq_id = 'run-4'"))
    listing = listings.run_results(spark, path, "run-4")
    assert listing.rows.count() == min(50, lines.count()) and listing.summary.first()["total_resources"] == lines.count()
    register = {(r["boq_id"], r["lines"]) for r in tables.run_register(spark, path).collect()}
    assert register == {(f"run-{i}", lines.count()) for i in range(6)}
    assert tables.run_lines(spark, path, "none").count() == 0
    plan = tables.run_register(spark, path, "run-4")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_rows_of_a_bitmap_meet_before_it_is_begun(spark, tmp_path, monkeypatch):
    plans, path = {}, str(tmp_path / "rollup")
    replaced = tables.replace_days

    def noted(df, place, *rest):
        plans[place.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        replaced(df, place, *rest)

    monkeypatch.setattr(tables, "replace_days", noted)
    lines = [(day, f"run-{i}", "p", "r", "spot", 1.0, 0.0) for i in range(50) for day in DAYS]
    rollups.update(spark.createDataFrame(lines, FIELDS), path, "a")
    assert rollups.result_stats(spark, path, DAYS[-1], 400).first()["total_calculations"] == 50
    # From the result down to the scan: both steps of the bitmaps come before the first exchange.
    above = plans["bitmaps"].split("Exchange")[0]
    assert "partial_bitmap_construct_agg" in above and plans["bitmaps"].count("partial_bitmap_construct_agg") == 1


def test_lines_are_stored_with_the_fields_that_an_update_reads(spark, sf_dir, monkeypatch):
    widths = []
    settle = registry.settle
    monkeypatch.setattr(registry, "settle", lambda df: (widths.append(df.columns), settle(df))[1])
    found = registry.QUERIES["rollup_updates"](spark, sf_dir)
    assert widths == [[*rollups.LINE_FIELDS, "resource_id"]]
    number = F.substring("boq_id", 5, 20).cast("bigint")
    kept = (number % 2 == 0) | (F.substring("resource_id", 5, 20).cast("bigint") % 2 == 0)
    expected = reports.daily_rollup(registry.lines(spark, sf_dir).where(kept))
    assert found.count() == expected.count() and found.agg(F.sum("line_count")).first() == expected.agg(F.sum("line_count")).first()
