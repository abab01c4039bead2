import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from costloom.llm.toxicity import BUCKETS, Memory, Model, WINDOW, learn, peaks, scored, subwords, trimmed
from costloom.llm.words import chunks

BAD = ["scoundrel", "wretched", "despicable", "imbecile"]


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("aeionrstlmd", k=rng.randint(2, 9))) for _ in range(800)]
    rows = []
    for i in range(1600):
        text = rng.choices(words, k=rng.choice([5, 30, 120, 400]))
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(text), toxic))
    return rows, words


def test_bags_of_subwords():
    buckets, edge = subwords(["cat", "Cat", "", "cats", "é漢"])
    bags = [set(buckets[a:b]) for a, b in zip(edge, edge[1:])]
    assert bags[0] == bags[1] and len(bags[0] & bags[3]) >= 3 and all(len(b) > 0 for b in bags)
    assert buckets.min() >= 0 and buckets.max() < BUCKETS
    assert len(subwords([])[0]) == 0


def test_punctuation_around_words_goes():
    texts = ["(cat), --- 'dog'!", "", None, "!!!", "a-b c.d."]
    found = []
    for chunk in chunks(pa.array(texts)):
        own = trimmed(chunk)
        for row in range(own.rows):
            found.append([own.data[own.starts[i] : own.ends[i]].tobytes().decode() for i in range(own.words[row], own.words[row + 1])])
    assert found == [["cat", "dog"], [], [], [], ["a-b", "c.d"]]


def test_peaks_like_brute_force():
    rng = np.random.default_rng(2)
    model = Model(rng.normal(size=BUCKETS), bias=0.3)
    texts = ["", "one", " ".join(f"w{i % 13}" for i in range(40)), None, "a b c d e f g h i j"]
    peak, windows = peaks(pa.array(texts), Memory(model))
    for i, text in enumerate(texts):
        words = (text or "").split()
        score = [float(model.word_scores([w])[0]) for w in words]
        spans = [score[k : k + WINDOW] for k in range(max(1, len(words) - WINDOW + 1))] if words else []
        assert windows[i] == len(spans)
        assert peak[i] == pytest.approx(max((np.mean(s) for s in spans), default=0.0) + 0.3)


def test_held_out_misspelt_and_odd_texts(spark):
    rows, words = corpus()
    labelled = spark.createDataFrame([(t, y) for i, t, y in rows if i % 5] + [(None, 1), ("no label", None), ("", 0)], "text string, toxic int")
    model = learn(labelled)
    long = " ".join(random.Random(1).choices(words, k=40000))
    odd = [(5000, f"{' '.join(words[:60])} imbecille {' '.join(words[60:90])}"), (5001, long + " scoundrel wretched " + long[:5000]), (5002, None), (5003, ""), (5004, "?!")]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(*o, "x") for o in odd] + [(0, rows[0][1], "x")], "doc_id long, text string, score string")
    found = scored(docs, model, carry=["doc_id", "score"])
    assert found.columns == ["doc_id", "score", "_score", "predicted"] and found.count() == len(rows) + len(odd) + 1
    got = {r["doc_id"]: r for r in found.collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= r["_score"] <= 1 and r["predicted"] == (r["_score"] >= 0.3) for r in got.values())
    # Misspellings that no label shows stand above nearly all words.
    unseen = model.word_scores(["scoundrell", "wretchedd", "despicables", "imbeciles", "imbecille"])
    assert unseen.min() > np.quantile(model.word_scores(words), 0.99)
    assert got[5000]["_score"] > np.median([got[i]["_score"] for i, _, y in rows if not y])
    assert got[5001]["predicted"] == 1  # two words in forty thousand
    assert all(got[i]["_score"] == 0 for i in (5002, 5003, 5004))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert learn(docs.select("text", F.lit(1).alias("toxic"))) is None
    assert scored(docs, None).first()["score"] == 0.0
    assert scored(docs.limit(0), None).count() == 0
