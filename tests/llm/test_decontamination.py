import random

import numpy as np
from hypothesis import given, settings, strategies as st

from costloom.llm.decontamination import _most, align, benchmark_matches, decontaminated


def smith_waterman(a, b):
    """Best local score: match 2, other word -1, gap -1."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(max(row) for row in table)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=25))
def test_alignment_like_brute_force(item, passage):
    score, first, last = align(np.array(item), np.array(passage, dtype=int))
    assert score == smith_waterman(item, passage)
    if score:
        assert smith_waterman(item, passage[first : last + 1]) == score


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=12), st.lists(st.integers(0, 6), max_size=25))
def test_no_alignment_scores_more_than_its_bound(item, passage):
    assert _most(np.array(item, np.uint64), np.array(passage, np.uint64)) >= smith_waterman(item, passage)


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(3, 6))) for _ in range(n)]


def corpus():
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.choice([14, 30, 60])))) for i in range(12)]
    rows = [(i, " ".join(words(rng, 150))) for i in range(60)]

    def planted(i, edit):
        text = items[i][1].split(" ")
        return " ".join(words(rng, 40) + edit(text) + words(rng, 40))

    leaks = {
        100: (0, lambda t: t), 101: (1, lambda t: [w.upper() + "," for w in t]),
        102: (2, lambda t: [w if k % 6 else "other" for k, w in enumerate(t)]), 103: (3, lambda t: t[: len(t) // 2] + ["more", "words"] + t[len(t) // 2 :]),
        104: (4, lambda t: [w for k, w in enumerate(t) if k % 7]), 105: (5, lambda t: t[2:-2]),
    }
    rows += [(i, planted(item, edit)) for i, (item, edit) in leaks.items()]
    rows += [(200 + k, f"{items[6][1]} number {k}") for k in range(40)]  # leaked often: no seed is rare
    rows += [(300, planted(7, lambda t: t[: len(t) // 4])), (301, None), (302, ""), (None, planted(8, lambda t: t)), (None, "clean text of nobody")]
    rows += [(303, " ".join(words(rng, 30000) + items[9][1].split(" ") + words(rng, 30000)))]
    return rows, items, {i: item for i, (item, _) in leaks.items()} | {200 + k: 6 for k in range(40)} | {303: 9, None: 8}


def test_edited_copies_are_found_and_clean_texts_left(spark):
    rows, items, leaks = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + rows[:3]], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame([*items, items[0], (50, None), (51, "too short"), (None, "no id here")], "item_id long, text string")
    found = {(r["id"], r["item_id"]): r for r in benchmark_matches(docs, tests).collect()}
    assert {i: item for i, item in found} == leaks and len(found) == len(leaks)
    by_id, by_item = dict(rows), dict(items)
    for (i, item), row in found.items():
        text = by_id[i] if i is not None else rows[-3][1]
        if len(text) < 5000:
            plain = lambda t: t.lower().replace(",", "").split()
            assert row["score"] == smith_waterman(plain(by_item[item]), plain(text)) / (2 * len(plain(by_item[item])))
        assert row["passage"] in text
    clean = decontaminated(docs, tests)
    assert clean.columns == docs.columns
    kept = [r["doc_id"] for r in clean.collect()]
    assert sorted(str(i) for i in kept) == sorted(str(i) for i, t in rows + rows[:3] if i not in leaks or t == "clean text of nobody")


def test_copies_with_broken_grams_are_found(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([20, 30, 38] * 8)]
    rows = []
    for i, text in items:
        item = text.split(" ")
        first = i // 3 % 4
        rows.append((i, " ".join(words(rng, 40) + [w if k % 4 != first else words(rng, 1)[0] for k, w in enumerate(item)] + words(rng, 40))))
        # three words survive at an odd place at the end; before them one word is put in after each
        rows.append((100 + i, " ".join(words(rng, 40) + [x for w in item[:-3] for x in (w, words(rng, 1)[0])] + item[-3:] + words(rng, 40))))
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["id"], r["item_id"]): r["score"] for r in benchmark_matches(docs, tests).collect()}
    by_item = dict(items)
    exact = {(i, i % 100): smith_waterman(by_item[i % 100].split(), t.split()) / (2 * len(by_item[i % 100].split())) for i, t in rows}
    assert min(exact[i, i] for i in by_item) > 0.6 and min(exact.values()) >= 0.5
    assert found == exact


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text of a document")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some text of an item")], "item_id long, text string")
    assert benchmark_matches(docs.limit(0), items).count() == 0
    assert benchmark_matches(docs, items.limit(0)).count() == 0
    assert decontaminated(docs, items.limit(0)).count() == 1
