import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from costloom.llm.components import components
from costloom.llm.near_duplicates import CHUNKS, SYMBOLS, near_duplicates, signature

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_force(rows, size, percent):
    """Component and set size of every (id, text)."""
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text, size))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        for left in sets[a]:
            for right in sets[b]:
                if left and right and 100 * len(left & right) >= percent * len(left | right):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: root(i) for i in sets}


def families(seed, groups=12, copies=9):
    """Texts and copies of them with from no to a third of the words replaced."""
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefghij", k=4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(random.choice([2, 4, 6, 30, 80, 200]))]
        for k in range(copies):
            copy = [word() if random.random() < k / copies / 6 else w for w in base]
            rows.append((len(rows) * 7 % 1009, " ".join(copy).title() if k % 2 else "  ".join(copy)))
    return rows


def test_like_brute_force_with_nulls_and_repeats(spark):
    rows = families(1) + [(2000, None), (2001, ""), (2002, " \n\t"), (None, "a b c d e"), (2003, "a b c d e"), (2004, "a b c d e"), (2004, "a b c d e")]
    rows += [(2005, "one text of its own that nobody else has at all"), (2005, "a b c d e")]  # an id with two texts
    rows += [(3000, "word " * 20000), (3001, "word " * 20001)]
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, kept string, component_id double")
    for size, percent in ((4, 80), (5, 80)):
        found = near_duplicates(docs, size=size, percent=percent).collect()
        expected = brute_force([r for r in rows if r[0] is not None], size, percent)
        assert len(found) == len(rows)
        for row in found:
            assert row["component_id"] == (None if row["doc_id"] is None else expected[row["doc_id"]])
            assert row["kept"] == (row["doc_id"] == row["component_id"])
        sizes = sorted((r["doc_id"] or -1, r["n_shingles"]) for r in found)
        assert sizes == sorted((i or -1, len(shingles(t, size))) for i, t in rows)


def test_large_group_of_loose_copies(spark):
    """Copies of one text, many too far from each other to be linked: the answer is exact without pairing the group."""
    random.seed(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if random.random() > i % 40 / 400 else f"x{random.random()}" for w in base)) for i in range(160)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    expected = brute_force(rows, 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert 2 < len(set(expected.values())) < 160


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    random.seed(5)
    pool = np.array([random.getrandbits(64) for _ in range(1800)], np.uint64)
    same = signature(pool[:1600]) == signature(pool[200:1800])  # similarity 1400 / 1800
    assert abs(same.mean() - 0.78) < 0.15
    assert len(same) == CHUNKS * SYMBOLS


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 160)]
    odd = [(5, 5), (300, 299), (299, 300), (400, 401), (401, 402), (402, 400)]
    found = components(spark.createDataFrame(chain + star + odd, "a long, b long"))
    expected = {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 300: 299, 401: 400, 402: 400}
    assert {r["node"]: r["component"] for r in found.collect()} == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert found.where(F.col("node") <= F.col("component")).count() == 0
