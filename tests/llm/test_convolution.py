import random

import numpy as np
import pytest

from costloom.llm import convolution as conv
from costloom.llm.queries import op13_quality


@pytest.fixture(scope="module")
def network():
    texts, label = [], []
    rng = random.Random(2)
    for i in range(160):
        words = ["".join(rng.choices("aeinrst", k=rng.randint(2, 7))) for _ in range(rng.randint(5, 60))]
        label.append(i % 2)
        texts.append((" " if i % 2 else "### ").join(words).encode())
    return conv.train(texts, np.array(label, float)), texts, np.array(label)


def slow_odds(network, text):
    """Odds of the chunks of one text, window by window."""
    codes = [*text, *[conv.PAD] * (conv.WIDTH - 1)]
    answers = [np.concatenate([network.vectors[c] for c in codes[i : i + conv.WIDTH]]) @ network.filters for i in range(len(text))]
    peaks = [np.max(answers[i : i + conv.CHUNK], axis=0) for i in range(0, len(text), conv.CHUNK)]
    return network.chunk_odds(np.array(peaks)) if peaks else np.zeros(0)


def test_odds_like_brute_force(network):
    rng = random.Random(4)
    texts = [b"", b"x", b"", *(bytes(rng.choices(range(256), k=n)) for n in (5, 255, 256, 257, 900, conv.PIECE + 700)), b""]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    odds, n = conv.text_odds(network[0], np.frombuffer(b"".join(texts), np.uint8), bounds)
    assert n.tolist() == [-(-len(t) // conv.CHUNK) for t in texts]
    assert np.allclose(odds, np.concatenate([slow_odds(network[0], t) for t in texts]), atol=1e-3)


def test_learns_and_gradients_lower_the_loss(network):
    found, texts, label = network
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    odds, n = conv.text_odds(found, np.frombuffer(b"".join(texts), np.uint8), bounds)
    share = found.probability(conv.features_of(odds, n))
    assert ((share >= 0.5) == label).mean() > 0.97


def test_edge_texts_and_clashing_columns(spark, network):
    rows = [(1, "plain words here", 1), (1, "plain words here", 1), (2, None, 0), (3, "", 0), (None, "###", 0), (4, "a### " * 60_000, 0), (5, "é漢😀", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score int").repartition(3)
    found = conv.scored(docs, network[0])
    assert found.columns == ["doc_id", "text", "Score", "_score", "predicted"]
    rows = found.collect()
    assert len(rows) == 7 and all(0 <= r["_score"] <= 1 and r["predicted"] == int(r["_score"] >= 0.3) for r in rows)
    assert len({r["_score"] for r in rows if r["doc_id"] == 1}) == 1
    assert all(r["_score"] == 0 for r in rows if not r["text"])
    assert conv.scored(docs.limit(0), network[0]).count() == 0
    assert {r["_score"] for r in conv.scored(docs, None).collect()} == {0.0}


def test_no_model_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for rows in ([], [(1, 1), (2, 1)], [(1, 0), (7, 1)], [(None, 1), (1, 5)]):
        assert conv.learn(docs, spark.createDataFrame(rows, "doc_id long, quality int")) is None


def test_long_labelled_texts_are_spread_over_chunks(spark):
    text = "".join(chr(97 + i % 26) * conv.CHUNK for i in range(3 * conv.TRAIN_CHUNKS))
    docs = spark.createDataFrame([(i, text if i % 2 else f"{i} | ") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    found = conv.scored(docs, conv.learn(docs, labels), carry=["doc_id"]).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in found)


def test_held_out_accuracy(spark):
    rows = op13_quality(spark, "/root/testdata/sf0.01").collect()
    marks = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").collect()}
    judged = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    clean = [p for p, m in judged if m == 1]
    assert sum(p == m for p, m in judged) / len(judged) > 0.9 and sum(clean) / len(clean) > 0.95
