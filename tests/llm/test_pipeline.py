import random

from pyspark.sql import functions as F

import corpus_pipeline
from costloom.llm.queries import QUERIES


def prose(rng, n):
    words = ["".join(rng.choices("aeionrst", k=rng.randint(2, 9))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def test_stages_and_their_decisions(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, prose(rng, 120), "en", f"s{i % 3}", 0, "x") for i in range(240)]
    rows += [(1000, "too short", "en", "s0", 9, "x"), (1001, None, None, None, None, None)]  # quality rules
    rows += [(1002, rows[3][1].split("\n")[0] + "\n" + prose(rng, 60), "en", "s1", 0, "x")]  # loses a line
    base = rows[5][1].replace("\n", " ").split(" ")
    rows += [(1003, " ".join(base), "en", "s2", 0, "x"), (1004, " ".join(base[:60] + ["other"] + base[61:90] + ["more"] + base[91:]), "en", "s2", 0, "x")]  # near copies
    item = prose(rng, 30).replace("\n", " ")
    rows += [(1005, prose(rng, 60) + " " + item + " " + prose(rng, 60), "en", "s2", 0, "x")]  # a leak
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    marks = [(i, 1, 0) for i in range(0, 240, 2)] + [(i, 0, 0) for i in range(1, 20, 2)] + [(31, 1, 1), (33, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    seen, frame = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, str(tmp_path))
        assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        path = str(tmp_path / name.replace(" ", "-"))
        after.write.parquet(path)
        frame = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r for r in frame.collect()}
    quality, lines, near, clean = seen.values()
    ids = {r[0] for r in rows}
    assert set(quality) == ids - {1000, 1001}
    assert set(lines) == set(quality)
    assert lines[1002]["text"] == rows[242][1].split("\n", 1)[1] and lines[1002]["n_chars"] == len(lines[1002]["text"])
    assert lines[7]["text"] == rows[7][1] and lines[7]["n_chars"] == 0  # untouched rows keep what they had
    assert set(lines) - set(near) == {1003, 1004}  # document 5 has the same words
    assert set(near) - set(clean) == {1005}
    last = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert last.columns[: len(docs.columns)] == docs.columns and last.where(F.col("copies") < 1).count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in last.collect())


def test_mixing_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(12)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(80))
    kinds = ["clean"] * 300 + ["poor"] * 60 + ["odd"] * 20  # odd: labelled clean, written like the poor
    rows = [(i, text("qxzjk" if k != "clean" else "aeionrst")) for i, k in enumerate(kinds)]
    marks = [(i, int(k != "poor"), 0) for i, k in enumerate(kinds) if k != "clean" or i % 2]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([*rows, (None, rows[310][1])], "doc_id long, text string")
    found = corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()
    rates = {r["doc_id"]: r["rate"] for r in found}
    assert len(found) == len(rates) and all(r["copies"] >= 1 for r in found)
    wanted = {i for i, k in enumerate(kinds) if k != "poor"}
    assert wanted <= set(rates) and min(rates[i] for i in wanted) >= 1
    assert len(set(rates) - wanted) < 30  # the poor still go by their rate


def test_empty_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir)
    assert frame.count() == 0


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
