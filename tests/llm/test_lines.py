import random
import re

import pytest
from hypothesis import given, strategies as st

from costloom.llm import queries
from costloom.llm.lines import MIN_WORDS, repeated_lines, within_one_word, without_repeated_lines


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def brute_force(rows):
    lines = {}
    for i, text in rows:
        if i is not None:
            for k, line in enumerate((text or "").split("\n")):
                words = re.findall(r"[^\x20\x09-\x0D]+", line)
                if words:
                    lines[i, k] = words
    found = {}
    for at, words in lines.items():
        same = [o for o, w in lines.items() if o < at and w == words]
        first = min([o for o, w in lines.items() if w == words])
        near = [o for o, w in lines.items() if o < first and min(len(w), len(words)) >= MIN_WORDS and w != words and distance(w, words) <= 1]
        if same or near:
            found[at] = ("exact" if same else "near", *min(same + near))
    return found


def corpus(seed):
    random.seed(seed)
    word = lambda: random.choice("abcdefgh") * random.choice([1, 2, 3])
    pool = [[word() for _ in range(random.choice([1, 3, 7, 8, 9, 15, 40]))] for _ in range(30)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(random.choice([1, 2, 5])):
            line = list(random.choice(pool))
            edit, at = random.random(), random.randrange(len(line))
            if edit < 0.3:
                line[at] = word()
            elif edit < 0.5:
                line.insert(at, word())
            elif edit < 0.7:
                del line[at]
            text.append(("  " if edit < 0.1 else "") + " ".join(line) + ("\t" if edit > 0.9 else ""))
        rows.append((i * 3, "\n".join(text)))
    return rows


def test_like_brute_force(spark):
    rows = corpus(2) + [(900, None), (901, ""), (902, "\n\n \n"), (None, "aa bb cc")]
    rows += [(903, "long " * 5000 + "end"), (904, "long " * 5000 + "stop"), (905, "long " * 5001 + "end")]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, line string")
    found = {(r["id"], r["line"]): (r["kind"], r["of_id"], r["of_line"]) for r in repeated_lines(docs).collect()}
    assert found == brute_force(rows)
    assert {k for k, *_ in found.values()} == {"exact", "near"}
    kept = {r["doc_id"]: r for r in without_repeated_lines(docs.withColumnRenamed("line", "n_dropped_lines")).collect()}
    for i, text in rows:
        if i is not None:
            expected = None if text is None else "\n".join(t for k, t in enumerate(text.split("\n")) if (i, k) not in found)
            assert kept[i]["text"] == expected
            assert kept[i]["n_dropped_lines"] == "x" and kept[i]["_n_dropped_lines"] == sum(at[0] == i for at in found)
    assert kept[None]["text"] == "aa bb cc"


def test_one_line_with_many_variants(spark):
    """All differ from each other in the same word: each repeats the earliest, and no pairs are made of the group."""
    rows = [(i, f"this is page number {i} of a very long list") for i in range(300)]
    found = repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 299 and {(r["of_id"], r["of_line"]) for r in found} == {(0, 0)}


def test_repeated_rows_and_empty_tables(spark):
    line = "a line that stands in three rows of one id"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert [(r["id"], r["of_id"]) for r in repeated_lines(docs).collect()] == [(2, 1)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_lines(none).count() == 0 and without_repeated_lines(none).count() == 0


@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_within_one_word(a, b):
    assert within_one_word(a, b) == (distance(a, b) <= 1)


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_warc", "op3_line_dedup"])
def test_like_sql(spark, sf_dir, name):
    from check import compare, duck

    assert compare(spark, duck(sf_dir), sf_dir, name) is None
