import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers

from costloom.llm import alignment
from costloom.llm.queries import BYTE_BPE, PIECE_BPE

LONG = " ".join(random.Random(3).choices(["alpha", "Übergröße", "the", "ναι", "x1", "don't", "<s>", "漢字"], k=30_000))
TEXTS = [
    (1, "Hello world, hello again"), (2, "Hello world, hello again"), (3, None), (4, ""), (5, " "), (6, "  two  blanks  "),
    (7, "tabs\t and\n lines\r\n  end \n"), (8, "<|endoftext|> and </s> <unk> <0x41>"), (9, "a▁b stays out"), (10, "漢字かな交じり文 😀😀 é́"),
    (11, "\x1c\x1d odd\x85 blanks　here  x"), (12, "'s 're don't 12345 ___!!!"), (13, LONG), (None, "Hello world"), (2, "Hello"), (14, "x" * 3000), (15, "\n" * 500 + "a"),
]


@pytest.fixture(scope="module")
def coders():
    first = tokenizers.Tokenizer.from_file(BYTE_BPE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def brute(coders, text):
    """Tokens, groups and links of one text, from both whole encodings."""
    first, second = coders
    alphabet = alignment.byte_alphabet()
    if not text:
        return [], [], [], []
    a = first.encode(" " + text, add_special_tokens=False).ids
    b = second.encode(text)
    a_bytes = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], [], []
    spans = [[], []]
    for k, parts in enumerate((a_bytes, b_bytes)):
        at = 0
        for part in parts:
            spans[k].append((at, at + len(part)))
            at += len(part)
    links, j = [], 0
    for i, (start, end) in enumerate(spans[0]):
        while spans[1][j][1] <= start:
            j += 1
        k = j
        while k < len(b) and spans[1][k][0] < end:
            links.append((a[i], b[k]))
            k += 1
    shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, last = [], 0
    for end in shared:
        groups.append(tuple([x for x, (s, e) in zip(ids, span) if s >= last and e <= end] for ids, span in ((a, spans[0]), (b, spans[1]))))
        last = end
    return a, b, groups, links


def short(texts):
    return [(i, t) for i, t in texts if t is None or len(t) < 5000]


def written(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def check_scores(rows, coders, texts):
    found = [(i, brute(coders, t)) for i, t in texts]
    counts = Counter(pair for _, (_, _, _, links) in found for pair in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    expected = Counter(
        (
            i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(written(groups).encode()).hexdigest() if a else "",
        )
        for i, (a, b, groups, links) in found
    )
    assert Counter(tuple(r) for r in rows) == expected


def test_scores_like_brute_force(spark, coders):
    texts = short(TEXTS)
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in texts], "doc_id long, text string, pairs int, N_A int").repartition(3)
    for bounds in ({}, {"max_rows": 0, "hot_rows": 2}):
        check_scores(alignment.alignment_scores(docs, BYTE_BPE, PIECE_BPE, carry=["doc_id"], **bounds).collect(), coders, texts)
    clash = alignment.alignment_scores(docs, BYTE_BPE, PIECE_BPE)
    assert clash.columns == ["doc_id", "text", "pairs", "N_A", "_n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert clash.count() == len(texts)


def test_groups_and_long_texts_cover_every_token(spark, coders):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = alignment.aligned_groups(docs, BYTE_BPE, PIECE_BPE).collect()
    first, second = coders
    for r in rows:
        if not r["a_ids"]:
            assert not r["b_ids"] and not r["groups"] and r["doc_id"] in (3, 4, 9)
            continue
        assert r["a_ids"] == first.encode(" " + r["text"], add_special_tokens=False).ids and r["b_ids"] == second.encode(r["text"])
        assert sum(g["n_a"] for g in r["groups"]) == len(r["a_ids"]) and sum(g["n_b"] for g in r["groups"]) == len(r["b_ids"])
        if len(r["text"]) < 5000:
            assert [(len(x), len(y)) for x, y in brute(coders, r["text"])[2]] == [tuple(g) for g in r["groups"]]


def test_words_apart_give_the_tokens_of_whole_texts(coders):
    with open(BYTE_BPE, encoding="utf-8") as file, open(PIECE_BPE, "rb") as other:
        aligner = alignment.Aligner(alignment.Tokenizers(file.read(), other.read()))
    rng = random.Random(5)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", "漢", "😀", "1", "'s", "!", "\x1c", "　", "the", "<s>", " "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(400)]
    aligner.align(texts[:200])
    found = aligner.align(texts)  # half of the words are known by now
    (a, _), (b, _) = aligner.a.take(found.words), aligner.b.take(found.words)
    first, second = coders
    assert a.tolist() == [i for t in texts for i in first.encode(" " + t, add_special_tokens=False).ids]
    assert b.tolist() == [i for t in texts for i in second.encode(t)]
    assert aligner.digests(found) == [hashlib.sha256(written(brute(coders, t)[2]).encode()).hexdigest() for t in texts]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_scores(docs, BYTE_BPE, PIECE_BPE).count() == 0
