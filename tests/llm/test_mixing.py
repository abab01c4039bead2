import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from costloom.llm.mixing import TARGETS, fit_rates, mixed

VOCABULARY = {"clean": "the of and house tree river", "poor": "click buy cheap now free win", "toxic": "hate scum trash vile worst fool"}


def corpus(n=240):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        domain = rng.choices(["clean", "poor", "toxic"], weights=[6, 3, 1])[0]
        docs.append((i, " ".join(rng.choices(VOCABULARY[domain].split(), k=rng.choice([3, 20, 200])))))
        if i % 2:
            labels.append((i, int(domain != "poor"), int(domain == "toxic")))
    return docs, labels


def test_expected_tokens_meet_the_targets(spark):
    docs, labels = corpus()
    odd = [(900, None), (901, ""), (902, " \t\n"), (None, "the of and"), (903, "river " * 50000)]
    frame = spark.createDataFrame([(*d, "r") for d in docs + odd + docs[:1]], "doc_id long, text string, rate string")
    marks = spark.createDataFrame(labels + labels[:2] + [(900, 1, 0), (None, 1, 0), (5000, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    found = mixed(frame, marks)
    assert found.columns == ["doc_id", "text", "rate", "n_tokens", "p_clean", "p_poor", "p_toxic", "_rate", "copies"]
    rows = found.toPandas()
    assert len(rows) == len(docs) + len(odd) + 1
    total = rows.n_tokens.sum()
    assert (rows._rate >= 0).all() and ((rows.copies - rows._rate).abs() < 1).all()
    for domain, target in TARGETS.items():
        assert (rows.n_tokens * rows._rate * rows[f"p_{domain}"]).sum() / total == pytest.approx(target, abs=1e-5)
    assert np.allclose(rows[["p_clean", "p_poor", "p_toxic"]].sum(axis=1), 1)
    empty = rows[rows.doc_id.isin([900, 901, 902])]
    assert (empty.n_tokens == 0).all() and empty.p_clean.nunique() == 1
    assert len(set(rows[rows.doc_id == 0].copies)) == 1


def brute_force(tokens, shares, aims, steps=20000):
    """Least squares with r >= 0 in the metric of the tokens, by many small steps."""
    t = tokens / tokens.sum()
    gram = (shares * t[:, None]).T @ shares
    rate = np.ones(len(t))
    for _ in range(steps):
        gap = (shares * (t * rate)[:, None]).sum(axis=0) - aims
        rate = np.maximum(0, rate - 0.2 * shares @ np.linalg.solve(gram, gap))
    return (shares * (t * rate)[:, None]).sum(axis=0), rate


@pytest.mark.parametrize("aims", [{"clean": 0.98, "poor": 0.01, "toxic": 0.01}, {"clean": 0.2, "poor": 0.1, "toxic": 0.7}])
def test_projected_steps_like_brute_force(spark, aims):
    rng = np.random.default_rng(1)
    shares = rng.dirichlet([0.3, 0.2, 0.1], size=80)
    tokens = rng.integers(1, 500, 80)
    frame = spark.createDataFrame([(int(t), *map(float, s)) for t, s in zip(tokens, shares)], "t long, a double, b double, c double")
    rate = fit_rates(frame, "t", {"clean": "a", "poor": "b", "toxic": "c"}, aims)
    found = np.array([r[0] for r in frame.select(rate).collect()])
    expected, _ = brute_force(tokens.astype(float), shares, np.array(list(aims.values())))
    reached = (shares * (tokens / tokens.sum() * found)[:, None]).sum(axis=0)
    assert (found >= 0).all()
    assert np.abs(reached - list(aims.values())).max() <= np.abs(expected - list(aims.values())).max() + 2e-3


def test_missing_domains_and_labels(spark):
    docs, labels = corpus(60)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    two = mixed(frame, spark.createDataFrame([x for x in labels if not x[2]], schema)).toPandas()
    assert (two.p_toxic == 0).all()
    assert (two.n_tokens * two.rate * two.p_clean).sum() / two.n_tokens.sum() == pytest.approx(0.9 / 0.98, abs=1e-4)
    none = spark.createDataFrame([], schema)
    assert {(r["rate"], r["copies"]) for r in mixed(frame, none).collect()} == {(1.0, 1)}
    assert mixed(frame.limit(0), spark.createDataFrame(labels, schema)).count() == 0


def test_main_path_is_native(spark):
    docs, labels = corpus(20)
    frame = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("the of and").alias("text"))
    marks = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert "Python" not in mixed(frame, marks)._jdf.queryExecution().toString()
