import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from costloom.llm import dialogues
from costloom.llm.queries import damaged, op11_dialogues

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def brute_edits(rows):
    """(cost, audit, repaired rows) of the cheapest edits, by trying everything."""
    faults, seen = [], set()
    for role, text in rows:
        solid = SOLID.findall(text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        user = state in ("", "s", "a")
        after = "u" if user else "a"
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            cost, audit, out = best(i, after, inserts + 1)
            options.append((cost + 3, "I" + audit, ((("user" if user else "assistant"), ""), *out)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            options.append((cost + 4, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if role[:1] == after or (role[:1] == "s" and state == ""):
                    cost, audit, out = best(i + 1, role[:1], 0)
                    options.append((cost + extra, "K" + audit, ((role, text), *out)))
                cost, audit, out = best(i + 1, after, 0)
                options.append((cost + extra + 3, "R" + audit, ((("user" if user else "assistant"), text), *out)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    for i in range(len(rows), 0, -1):  # fill from the back, so that long conversations recurse little
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return faults, *best(0, "", 0)


def brute(turns):
    """The report of every conversation: {id: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)}."""
    out, groups = {}, defaultdict(list)
    for conv, turn, role, text in turns:
        groups[conv].append((turn, role, text))
    for conv, rows in groups.items():
        content = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, content(r)))
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults, cost, audit, repaired = brute_edits([r[1:] for r in rows])
        initials = [r[1][:1] for r in rows]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        text = "\n".join(f"{role}:{t}" for role, t in repaired)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def some_turns(rng, conversations, most):
    turns = []
    for conv in range(conversations):
        for _ in range(rng.randint(1, most)):
            turn = rng.choice([None, *range(most)]) if conv % 3 else rng.randint(0, 40)
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "User", "s"])
            text = rng.choice(["", " \n", "Yes.", "No!", "What?", "cut", "cut \t", f"{rng.randint(0, 9)}.", "é…", "line\ntwo?\n"])
            turns.append((None if conv == 0 else conv, turn, role, text))
    return turns


def reports(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def test_reports_like_brute_force(spark):
    turns = some_turns(random.Random(1), 150, 9)
    rows = [(*t, "x", 1) for t in turns]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string, Part int").repartition(5)
    found = dialogues.repaired(frame).report.collect()
    assert len(found) == len({t[0] for t in turns})
    assert {r[0]: tuple(r)[1:] for r in found} == brute(turns)


@pytest.mark.parametrize("size", [3, 64])
def test_long_conversations_over_many_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(dialogues, "CHUNK_ROWS", size)
    rng = random.Random(size)
    turns = some_turns(rng, 6, 9)
    for n, conv in ((900, 100), (150, 101), (1, 102)):
        turns += [(conv, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"{rng.randint(0, 200)}!", "cut"])) for i in range(n)]
    turns += [(103, 5, "user", "Same.")] * 300  # equal rows spread over ranges
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = dialogues.repaired(frame)
        assert dialogues.linked_ranges(found.pieces)
        assert reports(found.report) == brute(turns)
        rows = sorted(r for r in found.messages.collect() if r["id"] == 100)
        text = "\n".join(f"{r['role']}:{r['text']}" for r in rows)
        assert hashlib.sha256(text.encode()).hexdigest() == brute(turns)[100][-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranges_converge_like_one_range(spark):
    rng = random.Random(9)
    kinds = [bytes(rng.choices(range(16), k=rng.randint(1, 40))) for _ in range(30)]
    rows = [(part, 0 if part % 7 else 1, n, k) for part, k in enumerate(kinds) for n in (0,)]
    links = [(p, rows[p][1], p + 1) for p in range(29) if rows[p + 1][1] == 0]
    ends, states = dialogues.converge(spark.createDataFrame(rows, "part int, seg long, n long, kinds binary"), links)
    for p, _, q in links:
        last = q
        while any(a == last for a, _, _ in links):
            last += 1
        assert ends[p] == dialogues.Steps().backward(b"".join(kinds[q : last + 1]), dialogues.FINAL)[0]
    assert set(states) == {q for _, _, q in links}


def test_very_long_text_and_empty_table(spark):
    turns = [(1, 0, "user", "word " * 500_000 + "."), (1, 1, "assistant", "\n" * 1_000_000), (1, 2, "assistant", "Fine.")]
    schema = "conv_id long, turn long, role string, text string"
    assert reports(dialogues.repaired(spark.createDataFrame(turns, schema)).report) == brute(turns)
    assert dialogues.repaired(spark.createDataFrame([], schema)).report.count() == 0


def test_query_like_brute_force(spark, tmp_path):
    rng = random.Random(4)
    turns = some_turns(rng, 120, 8) + [(200, None, None, None), (200, 1, None, "x."), (None, 3, "user", None), (201, 7, "user", "Hi.")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    left = []
    for conv, turn, role, text in turns:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            row = (conv, turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            left += [row] * (2 if fault == 3 else 1)
    expected = brute(left)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    expected |= {c: nothing for c, *_ in turns if c not in expected}
    found = op11_dialogues(spark, str(tmp_path)).collect()
    assert len(found) == len(expected) and {r[0]: tuple(r)[1:] for r in found} == expected


def test_damage_on_the_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    expected = brute([tuple(r) for r in damaged(turns).select("conv_id", "turn", "role", "text").collect()])
    assert {k: v for k, v in reports(op11_dialogues(spark, sf_dir)).items() if k in expected} == expected
