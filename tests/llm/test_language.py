import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from costloom.llm import language
from costloom.llm.language import ORDER, Hashed, StoredModel, calibrate, fit, grams_of, identified, learn


def grams(text):
    out, clean = [], []
    for c in f" {text.lower()} ":
        clean.append(c if c.isalpha() else " ")
    whole = "".join(c for i, c in enumerate(clean) if c != " " or i == 0 or clean[i - 1] != " ")
    if whole.strip():
        whole = whole.rjust(ORDER)
    for i in range(len(whole) - ORDER + 1):
        out.append(whole[i : i + ORDER])
    return out


def unpacked(value):
    return "".join(chr(int(value) >> 16 * (ORDER - 1 - j) & 0xFFFF) for j in range(ORDER))


def kneser_ney(counts, alphabet):
    """A plain interpolated model: probability of the last character of a gram, by the textbook's recursion."""
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        before = defaultdict(set)
        for gram in tables[n + 1]:
            before[gram[1:]].add(gram[0])
        tables[n] = {g: len(s) for g, s in before.items()}

    def probability(gram):
        if not gram:
            return 1 / (alphabet + 1)
        table, context = tables[len(gram)], gram[:-1]
        once, twice = (sum(v == k for v in table.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        after = {g: v for g, v in table.items() if g[:-1] == context}
        if not after:
            return probability(gram[1:])
        total = sum(after.values())
        return max(table.get(gram, 0) - discount, 0) / total + discount * len(after) / total * probability(gram[1:])

    return probability


def test_grams_like_brute_force():
    texts = ["", "a", "Ab  c!d", "É漢字 kana", "12 34", "x" * 9, "𝔘𝔫𝔦", " lead", "trail "]
    packed, rows, letters = grams_of(texts)
    for i, text in enumerate(texts):
        expected = ["".join(c if ord(c) < 0xFFFF else chr(0xE000 + ord(c) % 6400) for c in g) for g in grams(text)]
        assert [unpacked(v) for v in packed[rows == i]] == expected
        assert letters[i] == sum(c.isalpha() for c in text.lower())


def test_probabilities_like_the_textbook():
    texts = {"aa": "the cat sat on the mat and the hat", "bb": "le chat est la et la table est la aussi"}
    rows = [(lang, int.from_bytes(b"".join(ord(c).to_bytes(2) for c in g), signed=True), n) for lang, t in texts.items() for g, n in Counter(grams(t)).items()]
    model = fit(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    alphabet = len({c for t in texts.values() for g in grams(t) for c in g[-1]})
    tested = grams("the chat sat et zzz quite new") + grams(texts["aa"])
    keys = np.array([int.from_bytes(b"".join(ord(c).to_bytes(2) for c in g)) for g in tested], np.uint64)
    found = model.log_probability(keys)
    for k, lang in enumerate(model.langs):
        plain = kneser_ney(Counter(grams(texts[lang])), alphabet)
        assert np.allclose(found[:, k], [math.log(plain(g)) for g in tested], atol=1e-5)


def test_hash_arrays():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    table = Hashed(keys[::2], np.arange(len(keys[::2])))
    assert np.array_equal(table.values[table.find(keys[::2])], np.arange(len(keys[::2])))
    assert (table.find(keys[1::2]) == -1).all()
    assert (Hashed(keys[:0], keys[:0]).find(keys) == -1).all()


LETTERS = {"en": "ethaonis", "de": "enrschüß", "fr": "éèaiuelq", "zh": "的一是不了人我在"}


def test_held_out_texts_and_odd_rows(spark):
    rng = random.Random(3)
    word = lambda lang: "".join(rng.choices(LETTERS[lang], weights=range(8, 0, -1), k=rng.randint(2, 8)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.choice([3, 20, 200]))), lang) for i, lang in enumerate(list(LETTERS) * 100)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "de"), (1003, "éèa iuelé " * 20000, None), (None, "ethaonis the", "en"), (1004, "жзиклмн " * 30, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd + rows[:2]], "doc_id long, text string, lang string, score double")
    model = learn(docs, "text", "lang", F.col("doc_id") % 3 != 1)
    found = identified(docs, model, carry=["doc_id", "lang", "score"])
    assert found.columns == ["doc_id", "lang", "score", "lang_pred", "_score", "entropy", "accepted"]
    got = found.collect()
    assert len(got) == len(rows) + len(odd) + 2
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["doc_id"] % 3 == 1]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["_score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by_id[i]["lang_pred"], by_id[i]["_score"], by_id[i]["accepted"]) == ("und", 0.0, False)
    assert by_id[1003]["lang_pred"] == "fr" and not by_id[1004]["accepted"]
    assert sum(r["accepted"] for r in held) > 0.9 * len(held)


def test_every_gram_is_kept(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生", k=12))
    texts = [" ".join(word() for _ in range(1600)) for _ in range(15)]
    docs = spark.createDataFrame([(t, "zh") for t in texts] + [("the cat sat on the mat", "en")], "text string, lang string")
    model = learn(docs, "text", "lang", F.lit(True))
    counted = {g for t in texts for g in grams(t)}
    assert len(counted) > 200_000
    keys = np.array([int.from_bytes(b"".join(ord(c).to_bytes(2) for c in g)) for g in counted], np.uint64)
    assert (model.seen[ORDER - 1].find(keys) >= 0).all()


def test_tables_answer_like_arrays(spark):
    rng = random.Random(6)
    word = lambda lang: "".join(rng.choices(LETTERS[lang], weights=range(8, 0, -1), k=rng.randint(2, 8)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.choice([1, 5, 40]))), lang) for i, lang in enumerate(list(LETTERS) * 30)]
    rows += [(None, "the thé 漢字", None), (None, "the thé 漢字", None), (1, "", "en"), (2, None, "en"), (3, "12 !", "de"), (4, "𝔘𝔫𝔦 жзи", None)]
    rows += [(5 + 3 * i, t, None) for i, t in enumerate(["a", "é", "一", "A!", "1b2", "ж", "𝔘", "th", " q", "x\n"])]  # one letter or two
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    learnt = F.col("doc_id") % 3 != 1
    small, large = learn(docs, "text", "lang", learnt), learn(docs, "text", "lang", learnt, broadcast_grams=10)
    assert isinstance(large, StoredModel) and large.langs == small.langs
    assert np.allclose([large.floor, large.heat, large.least_score], [small.floor, small.heat, small.least_score], atol=1e-4)
    assert np.allclose(large.most_entropy, small.most_entropy, atol=1e-4)
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None)
    one, two = (sorted(identified(docs, m).collect(), key=order) for m in (small, large))
    assert len(one) == len(two) == len(rows) and one[0].asDict().keys() == two[0].asDict().keys()
    for a, b in zip(one, two):
        assert (a["doc_id"], a["text"], a["lang"], a["lang_pred"]) == (b["doc_id"], b["text"], b["lang"], b["lang_pred"])
        assert (a["lang_pred"] == "und") == (not any(c.isalpha() for c in a["text"] or ""))
        assert abs(a["score"] - b["score"]) < 1e-9 and (a["entropy"] is None) == (b["entropy"] is None)
        assert a["entropy"] is None or abs(a["entropy"] - b["entropy"]) < 1e-9
    assert sum(a["accepted"] != b["accepted"] for a, b in zip(one, two)) <= 1  # a score at the limit itself


def test_scripts_beyond_the_basic_plane(spark):
    rng = random.Random(8)
    scripts = {"got": range(0x10330, 0x1034A), "osm": range(0x10480, 0x1049E)}
    rows = [(i, " ".join("".join(chr(rng.choice(scripts[x])) for _ in range(5)) for _ in range(12)), x) for i, x in enumerate(list(scripts) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = identified(docs, learn(docs, "text", "lang", F.col("doc_id") % 3 != 1)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)


def test_limits_come_from_texts_that_were_not_counted(spark, monkeypatch):
    rows = [(f"the cat number {chr(97 + i % 26)}{chr(97 + i // 26)} sat", "en") for i in range(400)] + [("le chat", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < 0.1 * (1 << 20))
    left = {g for t, _ in docs.exceptAll(drawn).collect() for g in grams(t)}
    only = {g for t, _ in drawn.collect() for g in grams(t)} - left
    measured = []
    monkeypatch.setattr(language, "calibrate", lambda model, *rest: (measured.append(model), calibrate(model, *rest)))
    model = learn(docs, "text", "lang", F.lit(True))
    find = lambda m, names: m.seen[ORDER - 1].find(np.array([int.from_bytes(b"".join(ord(c).to_bytes(2) for c in g)) for g in names], np.uint64))
    assert only and (find(measured[0], only) < 0).all() and (find(measured[0], left) >= 0).all()
    assert (find(model, only | left) >= 0).all() and (model.heat, model.least_score) == (measured[0].heat, measured[0].least_score)


def test_every_learnt_text_sets_heat_and_limits(spark):
    rng = random.Random(9)
    word = lambda lang: "".join(rng.choices(LETTERS[lang], weights=range(8, 0, -1), k=rng.randint(2, 8)))
    rows = [(" ".join(word(rng.choice([lang, "en"])) for _ in range(rng.choice([1, 2, 4, 20]))), lang) for lang in ["en", "de", "fr"] * 90]
    rows += rows[:40] + [("12 34", "en"), ("", "de")]  # copies count once, texts without a letter not at all
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("fold", F.floor(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / (1 << 20) * 10))
    model, dealt = learn(docs, "text", "lang", F.lit(True)), docs.collect()
    own, score, right, gaps, truths = [], [], [], [], []
    for fold in range(10):
        counts = Counter((r["lang"], g) for r in dealt if r["fold"] != fold for g in grams(r["text"]))
        packed = lambda g: int.from_bytes(b"".join(ord(c).to_bytes(2) for c in g), signed=True)
        apart = fit(pd.DataFrame([(lang, packed(g), n) for (lang, g), n in counts.items()], columns=["lang", "gram", "n"]))
        mine = sorted({(r["text"], r["lang"]) for r in dealt if r["fold"] == fold and any(c.isalpha() for c in r["text"])})
        entropies, sizes, _ = apart.entropies([t for t, _ in mine])
        truth = np.array([apart.langs.index(x) for _, x in mine])
        gaps.append((entropies - entropies.min(axis=1, keepdims=True)) * (sizes / (1 + sizes / language.LENGTH))[:, None])
        truths.append(truth)
        own += [(x, e[k]) for (_, x), e, k in zip(mine, entropies, truth) if e.argmin() == k]
        right.append(entropies.argmin(axis=1) == truth)
    gaps, truths, right = np.concatenate(gaps), np.concatenate(truths), np.concatenate(right)
    assert len(gaps) > 200 and not right.all()
    likelihood = [(-h * gaps[np.arange(len(gaps)), truths] - np.log(np.exp(-h * gaps).sum(axis=1))).sum() for h in language.HEATS]
    assert model.heat == language.HEATS[int(np.argmax(likelihood))]
    score = 1 / np.exp(-model.heat * gaps).sum(axis=1)
    enough = [x for x in set(score) if right[score >= x].mean() >= language.WANTED]
    assert math.isclose(model.least_score, min(enough, default=1.0), rel_tol=1e-9)
    for lang, limit in zip(model.langs, model.most_entropy):
        x = np.array([e for name, e in own if name == lang])
        spread = np.median(np.abs(x - np.median(x)))
        assert math.isclose(limit, np.median(x) + 10 * max(1.4826 * spread, 0.05), rel_tol=1e-9)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert learn(docs, "text", "lang", F.lit(True)) is None
    row = identified(docs, None).first()
    assert (row["lang_pred"], row["score"], row["accepted"]) == ("und", 0.0, False)
    assert identified(docs.limit(0), None).count() == 0
