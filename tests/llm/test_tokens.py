import base64
import random

import pytest
import tiktoken

from costloom.llm.queries import VOCABULARY
from costloom.llm import tokens
from costloom.llm.tokens import SPLIT, context_limits, encoded_lengths, length_quantiles, n_tokens

TEXTS = [None, "", "a", "hello world", "hello world", "<|endoftext|>", " \n\t ", "é漢😀" * 50, "x" * 3000, "the cat sat. " * 9000]


@pytest.fixture(scope="module")
def lengths():
    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    assert encoding.decode(encoding.encode_ordinary(TEXTS[7])) == TEXTS[7]
    return sorted(len(encoding.encode_ordinary(t or "")) for t in TEXTS)


def test_histogram_and_limits_like_brute_force(spark, lengths):
    docs = spark.createDataFrame([(t, 1) for t in TEXTS], "text string, n_tokens int")
    rows = context_limits(encoded_lengths(docs, VOCABULARY)).collect()
    assert [r["n_tokens"] for r in sorted(rows)] == sorted(set(lengths))
    for r in rows:
        limit = r["n_tokens"]
        assert r["docs"] == lengths.count(limit)
        assert r["docs_longer"] == sum(n > limit for n in lengths)
        assert r["docs_within"] == sum(n <= limit for n in lengths)
        assert r["tokens_within"] == sum(n for n in lengths if n <= limit)
        assert r["truncated_tokens"] == sum(min(n, limit) for n in lengths)
        assert r["total_tokens"] == sum(lengths) and r["quantile"] == r["docs_within"] / len(lengths)


def test_sums_across_blocks_and_between_lengths(spark):
    rng = random.Random(2)
    counts = {rng.randrange(0, 9000): rng.randint(1, 9) for _ in range(400)}
    limits = context_limits(spark.createDataFrame(list(counts.items()), "n_tokens long, docs long"))
    rows = {r["n_tokens"]: r for r in limits.collect()}
    whole = [n for n, k in counts.items() for _ in range(k)]
    for limit in (0, 17, 1024, 5000, 8999, 20000):
        at = max((n for n in rows if n <= limit), default=None)
        truncated = rows[at]["truncated_tokens"] + (limit - at) * rows[at]["docs_longer"] if at is not None else limit * len(whole)
        assert truncated == sum(min(n, limit) for n in whole)
    found = {r["share"]: r["n_tokens"] for r in length_quantiles(limits, [0.1, 0.5, 1.0]).collect()}
    whole.sort()
    assert found == {q: next(n for n in whole if sum(m <= n for m in whole) >= q * len(whole)) for q in (0.1, 0.5, 1.0)}


def test_empty_table(spark):
    none = encoded_lengths(spark.createDataFrame([], "text string"), VOCABULARY)
    assert none.count() == 0 and context_limits(none).count() == 0


@pytest.fixture(scope="module")
def encoding():
    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def test_runs_of_blanks_apart_like_the_whole_text(encoding, monkeypatch):
    monkeypatch.setattr(tokens, "_LONG_BLANK", tokens.re.compile(r"[^\S\x1c-\x1f]{3,}"))
    rng = random.Random(3)
    parts = ["a", "B1", " ", "    ", "\n", "\t", "\u3000", "\x1c", "\x85", "'s", "!", "é", "\r\n", "the"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert n_tokens(encoding, text) == len(encoding.encode_ordinary(text)), repr(text)


def test_very_long_runs_of_blanks(spark, encoding):
    n = 5_000_000
    mixed = "x" + "\n\t " * n + "y"
    texts = ["a" + " " * n + "b", "\n" * n, mixed]
    found = {r["n_tokens"]: r["docs"] for r in encoded_lengths(spark.createDataFrame([(t,) for t in texts], "text string"), VOCABULARY).collect()}
    # The vocabulary has single blanks and pairs of line feeds; mixed runs have no longer token either.
    assert found == {n + 1: 1, n // 2: 1, 3 * n + 1: 1}
