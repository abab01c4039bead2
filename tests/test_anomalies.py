"""Streamed anomalies against a replay of the batches in plain Python."""

import random
from fractions import Fraction
from math import sqrt

from costloom.operators import reports
from costloom.sources import feed, tables
from costloom.streaming import anomalies, jobs

FIELDS = "resource_id string, project_id string, total_cost_usd double"


def some_batches(seed=4, count=5):
    rng = random.Random(seed)
    batches = []
    for b in range(count):
        rows = [(f"r{b}-{i}", rng.choice(["p1", "p2", "p3", None]), round(rng.gauss(1e6, 5), 6)) for i in range(60)]
        rows += [(f"r{b}-out", "p1", 1e6 + 100.0 * (b % 2)), (f"r{b}-new", f"only-{b}", 1e9), (f"r{b}-null", "p2", None)]
        batches.append(rows)
    return batches


def replay(batches, sigmas=2.0):
    """Flags of each line by exact means and variances of all earlier batches."""
    seen, out = {}, []
    for rows in batches:
        for name, project, cost in rows:
            n, costs = seen.get(project, (0, []))
            if project is None or cost is None or n < 2:
                continue
            s, q = sum(costs), sum(c * c for c in costs)
            limit = float(s / n) + sigmas * sqrt(max(0.0, float((q - s * s / n) / (n - 1))))
            if cost > limit:
                out.append((name, project, cost))
        for _, project, cost in rows:
            n, costs = seen.get(project, (0, []))
            seen[project] = (n + 1, costs + ([] if cost is None else [Fraction(round(cost * 1e6), 10**6)]))
    return sorted(out)


def stored_flags(spark, path):
    return sorted((r["resource_id"], r["project_id"], r["total_cost_usd"]) for r in anomalies.flagged(spark, path).collect())


def test_streamed_flags_equal_a_replay(spark, tmp_path):
    inbox, path, progress = (str(tmp_path / name) for name in ("lines", "flags", "progress"))
    batches = some_batches()
    for rows in batches:
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(inbox)
        anomalies.start_anomalies(feed.stream_lines(spark, inbox), path, progress, sigmas=2.0).awaitTermination()
    assert stored_flags(spark, path) == replay(batches) and len(replay(batches)) > 3
    stream = jobs.stream_id(spark, progress)
    assert len(tables.names(spark, f"{path}_moments/stream={stream}")) == 2


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "flags")
    batches = some_batches(seed=9)
    frames = [spark.createDataFrame(rows, FIELDS) for rows in batches]
    for number, frame in enumerate(frames):
        for _ in range(2):
            anomalies.anomaly_batch(frame, number, path, sigmas=2.0)
    assert stored_flags(spark, path) == replay(batches)
    whole = frames[0].unionAll(frames[1]).unionAll(frames[2]).unionAll(frames[3]).unionAll(frames[4])
    expected = sorted(map(tuple, reports.cost_moments(whole).collect()), key=str)
    assert sorted(map(tuple, anomalies.moments(spark, path, 5).collect()), key=str) == expected


def test_moments_of_a_batch_that_died_are_not_used(spark, tmp_path):
    path = str(tmp_path / "flags")
    batches = some_batches(seed=2, count=3)
    frames = [spark.createDataFrame(rows, FIELDS) for rows in batches]
    anomalies.anomaly_batch(frames[0], 0, path, sigmas=2.0)
    anomalies.anomaly_batch(frames[2], 1, path, sigmas=2.0)  # half of a batch, whose write did not finish
    tables.delete(spark, f"{path}_moments/stream=/batch=1/_SUCCESS")
    anomalies.anomaly_batch(frames[1], 1, path, sigmas=2.0)
    anomalies.anomaly_batch(frames[2], 2, path, sigmas=2.0)
    assert stored_flags(spark, path) == replay(batches)


def test_streams_do_not_share_moments(spark, tmp_path):
    path = str(tmp_path / "flags")
    rows = spark.createDataFrame(some_batches(seed=1)[0], FIELDS)
    anomalies.anomaly_batch(rows, 0, path, stream="a")
    assert anomalies.moments(spark, path, 9, "b").count() == 0 < anomalies.moments(spark, path, 9, "a").count()
    anomalies.anomaly_batch(rows.limit(0), 0, path, stream="b")
    assert anomalies.flagged(spark, path).count() == 0
