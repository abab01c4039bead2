"""The corpus pipeline: documents through quality rules, deduplication, decontamination and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage's result is written and read again before the next, so a lost executor never costs more than one stage. A stage
handles nulls, repeated rows, empty tables and extra columns as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from costloom.llm.decontamination import decontaminated
from costloom.llm.lines import without_repeated_lines
from costloom.llm.mixing import domain_of, mixed
from costloom.llm.near_duplicates import near_duplicates
from costloom.llm.quality import quality_rules
from costloom.llm.storage import fresh, stored, table

# Shares of the tokens that the mix aims at.
TARGETS = {"clean": 0.985, "poor": 0.01, "toxic": 0.005}
BROADCAST_IDS = 500_000  # removed ids sent to every executor at most; more are joined by a shuffle

# No SQL: robust estimates, signatures, alignments and gradient steps cannot be expressed; brute force tests them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    (kept,) = fresh(docs, "kept")
    return quality_rules(docs).where(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; one that loses its last word goes. ``n_chars`` follows."""
    (dropped,) = fresh(docs, "n_dropped_lines")
    found = without_repeated_lines(docs).where((F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col(dropped) > 0, length).otherwise(F.col("n_chars")))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id."""
    gone = stored(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes at least once, with memberships, rate and number of copies.

    Only poor and toxic documents go by a rate below 1: one that is more likely clean than poor and than toxic, or that
    is labelled clean and nothing else, has rate 1 and one copy at least.
    """
    labels = table(spark, sf_dir, "labels")
    p_clean, p_poor, p_toxic, rate, copies, key, marked = fresh(docs, "p_clean", "p_poor", "p_toxic", "rate", "copies", "label_id", "labelled")
    rows = mixed(docs, labels, TARGETS)
    low = F.col(rate) < 1
    sure = F.col(p_clean) >= F.greatest(p_poor, p_toxic)
    raised = {rate: F.greatest(rate, F.lit(1.0)), copies: F.greatest(copies, F.lit(1).cast("long"))}
    domains = labels.select(F.col("doc_id").cast("long").alias(key), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    clean = domains.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("domain").alias("least"), F.max("domain").alias("most"))
    clean = stored(clean.where("least = 'clean' and most = 'clean'").select(key, F.lit(True).alias(marked)), "labelled-clean")
    if clean.count() <= BROADCAST_IDS:
        clean = F.broadcast(clean)
    doubtful = rows.where(low & ~sure).join(clean, F.col("doc_id").cast("long") == F.col(key), "left")
    doubtful = doubtful.withColumns({c: F.when(F.col(marked), value).otherwise(F.col(c)) for c, value in raised.items()})
    taken = rows.where(~low | sure).withColumns(raised).unionByName(doubtful.select(*(F.col(f"`{c}`") for c in rows.columns)))
    return taken.where(F.col(copies) >= 1)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
