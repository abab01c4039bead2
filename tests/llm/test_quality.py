import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from costloom.llm import quality
from costloom.llm.quality import MIN_GROUP, STATISTICS, minimum_covariance, quality_rules, statistics_of


def brute_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            lines += 1
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for found in places.values() if len(found) > 1 for i in found for k in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), lines,
        len(re.findall("[A-Z]", text)), len(re.findall("[!?]", text)),
    )


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab #!A\n\t\x0b\x85é漢😀", max_size=120)), max_size=6))
def test_statistics_like_brute_force(texts):
    found = statistics_of(pa.array(texts, pa.string()))
    assert [tuple(row) for row in found.tolist()] == [brute_force(t) for t in texts]


def prose(rng, n):
    words = ["".join(rng.choices("aeionrst", k=rng.randint(2, 9))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def test_junk_goes_and_clean_texts_stay(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([20, 25, 60, 300, 3000])), "en", f"s{i % 2}") for i in range(3 * MIN_GROUP)]
    junk = [re.sub(r" ", "*** ", prose(rng, 200)), prose(rng, 200).upper().replace(" ", "!! "), "a b c d e f g h " * 400]
    rows += [(1000 + i, t, "en", "s0") for i, t in enumerate(junk)]
    rows += [(2000, None, "en", "s0"), (2001, "", "en", "s0"), (2002, prose(rng, 40), None, None), (None, prose(rng, 40), "xx", "s9")]
    rows += [rows[0], (2003, "word" * 50000 + " " + " ".join(f"x{i}" for i in range(30)), "en", "s1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, kept int")
    found = quality_rules(docs)
    assert found.columns == [*docs.columns, *STATISTICS, "base_failed", "distance", "_kept"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows) and got[5]["kept"] == 1
    for i, text, *_ in rows:
        row = got[i]
        words, *_, = base = brute_force(text)
        assert tuple(row[c] for c in STATISTICS) == base
        assert row["base_failed"] == (words < 20 or 100 * base[4] > 30 * words)
    assert all(got[i]["_kept"] for i in range(3 * MIN_GROUP)) and got[2002]["_kept"] and got[None]["_kept"]
    assert not any(got[i]["_kept"] for i in (1000, 1001, 1002, 2000, 2001))
    assert got[1000]["distance"] > 30 and not got[1000]["base_failed"]
    assert got[2003]["distance"] > 30  # one word of 200,000 letters


def test_small_and_empty_tables(spark):
    rng = random.Random(5)
    few = spark.createDataFrame([(1, prose(rng, 50), "en", "s"), (2, "short", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: (r["distance"], r["kept"]) for r in quality_rules(few).collect()} == {1: (None, True), 2: (None, False)}
    assert quality_rules(few.limit(0)).count() == 0


def test_estimate_resists_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(6)
    mixing = rng.normal(size=(6, 6)) * 0.3 + np.eye(6)
    good = rng.normal(size=(4000, 6)) @ mixing.T + 2
    x = np.vstack([good, rng.normal(size=(1000, 6)) * 0.1 + 40])
    rows = spark.createDataFrame([("g", r) for r in x.tolist()], "group string, x array<double>")
    model = minimum_covariance(rows).first()
    inverse = np.zeros((6, 6))
    inverse[np.triu_indices(6)] = model["inverse"]
    scatter = np.linalg.inv(inverse + inverse.T - np.diag(np.diag(inverse)))
    assert np.abs(np.array(model["centre"]) - 2).max() < 0.1
    assert np.abs(scatter - mixing @ mixing.T).max() < 0.15 * np.abs(mixing @ mixing.T).max()
    assert rows.select(F.col("x")[0]).count() == 5000


def test_both_routes_to_the_groups_give_the_same_answers(spark, monkeypatch):
    """Estimates joined instead of sent, with every group cut into slices, as one group that holds most rows is."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([25, 60, 200])) + "!" * rng.randint(0, 3), "en", "hot" if i % 4 else "cold") for i in range(5 * MIN_GROUP)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    answers = lambda: {r["doc_id"]: (r["distance"], r["kept"]) for r in quality_rules(docs, carry=["doc_id"]).collect()}
    sent = answers()
    lookup = quality.joins.lookup
    monkeypatch.setattr(quality.joins, "lookup", lambda *given, **named: lookup(*given, **{**named, "max_rows": 0, "hot_rows": 20}))
    joined = answers()
    assert sent.keys() == joined.keys() and len(sent) == len(rows)
    for i, (distance, kept) in sent.items():
        assert kept == joined[i][1] and abs(distance - joined[i][0]) < 1e-6 * max(1, distance)
