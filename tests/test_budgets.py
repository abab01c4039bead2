"""Where running costs pass budgets, against a plain running sum."""

import random
from datetime import date, timedelta

from costloom.operators import reports

FIELDS = "cost_center string, calc_date date, resource_id string, boq_id string, total_cost_usd double"
ORDER = ("calc_date", "resource_id", "boq_id")


def plain(rows, budgets):
    out = {}
    for center, budget in budgets.items():
        total, steps = 0, {}
        for r in rows:
            if r[0] == center:
                steps[r[1:4]] = steps.get(r[1:4], 0) + round((r[4] or 0) * 1e6)
        for key in sorted(steps, key=lambda k: tuple((v is not None, v) for v in k)):
            total += steps[key]
            if total > round(budget * 1e6):
                out[center] = (*key, total / 1e6, budget)
                break
    return out


def test_crossings_like_a_running_sum(spark):
    rng = random.Random(2)
    day = lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(40))
    rows = [
        (rng.choice(["big", "big", "big", "small", "none", None]), rng.choice([None, day(), day()]), f"r{rng.randrange(30)}", rng.choice(["a", "b"]), rng.choice([None, 0.0, rng.randrange(900) / 64]))
        for _ in range(3000)
    ]
    lines = spark.createDataFrame(rows, FIELDS).repartition(5)
    for big in (0.0, 1.0, 500.0, 3000.0, 9000.0, 1e9):
        budgets = {"big": big, "small": 700.0, "other": 1.0}
        for slices in (1, 9):
            found = reports.budget_crossings(lines, budgets, slices=slices).collect()
            assert {r["cost_center"]: tuple(r)[1:] for r in found} == plain(rows, budgets)


def test_no_lines(spark):
    assert reports.budget_crossings(spark.createDataFrame([], FIELDS), {"big": 1.0}).count() == 0


def test_one_center_spreads_over_tasks(spark):
    rows = spark.range(4000).selectExpr("'big' as cost_center", "date '2024-01-01' as calc_date", "cast(id as string) as resource_id", "'b' as boq_id", "1e0 as total_cost_usd")
    row = reports.budget_crossings(rows, {"big": 2500.0}, slices=8).first()
    assert row["reached_usd"] == 2501.0 and row["resource_id"] == sorted(map(str, range(4000)))[2500]
