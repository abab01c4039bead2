"""Quality rules: text statistics, and robust multivariate outliers among them per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from costloom.llm.storage import fresh, stored
from costloom.llm.words import Chunk, chunks, ngrams, sum_hash, constants
from costloom.operators import joins

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8  # words
MIN_GROUP = 100  # rows a group needs for an estimate of its own; smaller ones take their language's, then the table's
GROUPS_SENT = 100_000  # groups whose estimates (some 250 bytes each) are sent to the executors; more are joined
CORE = 0.75  # share of a group's rows that the least determinant is sought over
STEPS = 4
PRIOR_WORDS, PRIOR_LINES = 50, 10  # of an average text mixed into each, so that short texts do not stand out by chance
FLOOR = 0.05  # added spread of each transformed statistic, so that constant ones have a finite distance
MAX_DISTANCE = 30.0  # squared; six normal variables exceed it 4 times in 100,000

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
_P = 6
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


def _table(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in characters]] = True
    return found


_SYMBOLS, _MARKS = _table("#*$%&|<>"), _table("!?")
_CAPITALS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SOLID = ~_table(" \t\n\v\f\r")
_BYTE = constants(256, 21)


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def _again(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: is it in its row more than once, and is it a later one. ``rows`` must ascend."""
    order = np.argsort(values, kind="stable")
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = (values[order][1:] == values[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    several, later = np.zeros(len(values), bool), np.zeros(len(values), bool)
    several[order], later[order] = same[1:] | same[:-1], same[:-1]
    return several, later


def _lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word and later equal ones, per row."""
    data, bounds = chunk.data, chunk.bounds
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SOLID[data], out=solid[1:])
    rows = np.repeat(np.arange(chunk.rows), np.diff(np.searchsorted(breaks, bounds)) + 1)
    full = solid[ends] > solid[starts]
    starts, ends, rows = starts[full], ends[full], rows[full]
    _, later = _again(sum_hash(_BYTE[data], starts, ends) + (ends - starts).astype(np.uint64), rows)
    return np.bincount(rows, minlength=chunk.rows), np.bincount(rows, weights=later, minlength=chunk.rows).astype(np.int64)


def _repeated(chunk: Chunk) -> np.ndarray:
    """Words inside windows that the row has more than once, per row."""
    grams, at = ngrams(chunk.hashes(lower=False), chunk.words, WINDOW)
    if not len(at):
        return np.zeros(chunk.rows, np.int64)
    several, _ = _again(grams, np.searchsorted(chunk.words, at, side="right"))
    change = np.zeros(len(chunk.starts) + 1, np.int64)
    np.add.at(change, at[several], 1)
    np.add.at(change, at[several] + WINDOW, -1)
    return _per_row(np.cumsum(change)[:-1] > 0, chunk.words)


def statistics_of(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text; null reads as empty."""
    out = np.zeros((len(column), len(STATISTICS)), np.int64)
    for chunk in chunks(column):
        data, bounds, part = chunk.data, chunk.bounds, out[chunk.first : chunk.last]
        part[:, 0] = np.diff(chunk.words)
        part[:, 1] = _per_row(_SOLID[data] & ((data & 0xC0) != 0x80), bounds)
        part[:, 2] = _per_row(_SYMBOLS[data], bounds)
        part[:, 5], part[:, 3] = _lines(chunk)
        part[:, 4] = _repeated(chunk)
        part[:, 6] = _per_row(_CAPITALS[data], bounds)
        part[:, 7] = _per_row(_MARKS[data], bounds)
    return out


def with_statistics(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """``carry`` columns of every row, and the statistics of its text. Narrow: rows stay where they are."""
    fields = [docs.schema[c] for c in carry] + [T.StructField(c, T.LongType()) for c in STATISTICS]
    wanted = carry if text_col in carry else [*carry, text_col]
    at = wanted.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics_of(batch.column(at))
            columns = [batch.column(i) for i in range(len(carry))] + [pa.array(x) for x in found.T.copy()]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(*wanted).mapInArrow(run, T.StructType(fields))


def _share(part: str, whole: str, prior: float) -> Column:
    return F.least(F.lit(1.0), F.col(part) / (F.col(whole) + prior))


def _vector() -> Column:
    """Log of the mean word length; angles of the shares of characters, which spread evenly from none to all; and plain
    shares of what is repeated, as one repeated line or passage is no outlier."""
    length = (F.col("word_chars") + 5.0 * PRIOR_WORDS) / (F.col("n_words") + PRIOR_WORDS)
    characters = [_share(c, "word_chars", 5.0 * PRIOR_WORDS) for c in ("n_symbols", "n_marks", "n_capitals")]
    repeats = [_share("n_repeat_words", "n_words", PRIOR_WORDS), _share("n_dup_lines", "n_lines", PRIOR_LINES)]
    return F.array(*(F.round(p, 4) for p in (F.log(length), *(F.asin(F.sqrt(c)) for c in characters), *repeats)))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x`` from ``centre`` under ``inverse``, the upper half of the inverse scatter."""
    gap = [F.col("x")[i] - F.col("centre")[i] for i in range(_P)]
    terms = [gap[i] * gap[j] * F.col("inverse")[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def _chi2_below(x: float, even: int) -> float:
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(even // 2))


def _chi2_at(share: float, even: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_below(mid, even) < share else (low, mid)
    return high


def _consistency(share: float) -> float:
    """What the scatter of the innermost ``share`` of normal rows must be multiplied by."""
    return share / _chi2_below(_chi2_at(share, _P), _P + 2)


def _inverted(factor: float):
    """Group moments to centre and inverse scatter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            centres, inverses = [], []
            for n, sums, squares in zip(frame["n"], frame["sums"], frame["squares"]):
                centre = np.asarray(sums, float) / n
                scatter = np.zeros((_P, _P))
                for k, (i, j) in enumerate(_PAIRS):
                    scatter[i, j] = scatter[j, i] = squares[k] / n - centre[i] * centre[j]
                value, axes = np.linalg.eigh(factor * scatter)
                inverse = (axes / (np.maximum(value, 0) + FLOOR**2)) @ axes.T
                centres.append(centre.tolist())
                inverses.append([float(inverse[i, j]) for i, j in _PAIRS])
            yield pd.DataFrame({"group": frame["group"], "centre": centres, "inverse": inverses})

    return run


_MODEL = "group string, centre array<double>, inverse array<double>"


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    x = F.col("x")
    sums = F.array(*(F.sum(x[i]) for i in range(_P)))
    squares = F.array(*(F.sum(x[i] * x[j]) for i, j in _PAIRS))
    totals = rows.groupBy("group").agg(F.count("*").alias("n"), sums.alias("sums"), squares.alias("squares"))
    return stored(totals.mapInPandas(_inverted(factor), _MODEL), "estimate")


def _with_group(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with the stored facts of their group. Few groups are broadcast, so that a group that holds much of the table
    stays spread; beyond that, rows of such a group are cut into slices."""
    return joins.lookup(rows, facts, ["group"], "inner", spread_by=["x"], max_rows=GROUPS_SENT)


def _start(rows: DataFrame) -> DataFrame:
    """Medians and median deviations of each group."""
    x = F.col("x")
    middle = rows.groupBy("group").agg(F.array(*(F.percentile(x[i], F.lit(0.5)) for i in range(_P))).alias("centre"))
    gaps = _with_group(rows, stored(middle, "medians")).select("group", "centre", *(F.abs(x[i] - F.col("centre")[i]).alias(f"g{i}") for i in range(_P)))
    spread = gaps.groupBy("group").agg(
        F.first("centre").alias("centre"), *(F.percentile(F.round(f"g{i}", 4), F.lit(0.5)).alias(f"s{i}") for i in range(_P))
    )
    inverse = [1 / (F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOOR**2) if i == j else F.lit(0.0) for i, j in _PAIRS]
    return stored(spread.select("group", "centre", F.array(*inverse).alias("inverse")), "estimate")


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """Centre and inverse scatter of the rows ``x`` of each ``group``: concentration steps of the MCD estimator.

    Each step measures all rows, finds the distance that holds ``CORE`` of each group from a histogram (at most 1,300
    bins a group, whatever its size) and re-estimates from the rows within. The last step weighs in all rows up to the
    97.5 % point. Every step is two aggregations with map-side combine; a hot group adds no more shuffled rows than a
    small one.
    """
    model = _start(rows)
    every = Window.partitionBy("group")
    for step in range(STEPS + 1):
        measured = _with_group(rows, model).withColumn("d2", _distance())
        if step < STEPS:
            measured = measured.withColumn("bin", F.floor(F.log2(F.greatest("d2", F.lit(1e-9))) * 16))
            bins = measured.groupBy("group", "bin").agg(F.count("*").alias("n"))
            below = bins.withColumn("below", F.sum("n").over(every.orderBy("bin"))).withColumn("all", F.sum("n").over(every))
            core = below.where(F.col("below") >= CORE * F.col("all")).groupBy("group").agg(F.min("bin").alias("core"))
            inner = _with_group(measured, stored(core, "core")).where("bin <= core")
            model = _moments(inner, _consistency(CORE))
        else:
            model = _moments(measured.where(F.col("d2") <= _chi2_at(0.975, _P)), _consistency(0.975))
    return model


def quality_rules(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """``carry`` columns (default: all) of every row, its ``STATISTICS``, ``base_failed``, ``distance`` and ``kept``.

    A row fails the base rules with fewer than 20 words or with more than 30 % of its words in 8-word windows that the
    text has more than once. The others are outliers, and not kept, if the squared Mahalanobis distance of their
    transformed statistics exceeds ``MAX_DISTANCE`` under the minimum-covariance-determinant estimate of their language
    and source; groups under ``MIN_GROUP`` rows take the estimate of their language, and languages under it that of the
    table. A table with fewer rows has no estimate: distance is null and the base rules decide.

    Null text is empty and fails; null language or source is a group of its own (the empty name's). Repeated rows are
    returned as often as they come. Input columns named like an added column keep their name; the added one is
    prefixed with "_".
    """
    carry = list(docs.columns) if carry is None else carry
    names = fresh(docs.select(*[F.col(f"`{c}`") for c in carry]), *STATISTICS, "base_failed", "distance", "kept")
    lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang_col, source_col))
    of_group = [lang.alias("group_lang"), source.alias("group_source")]
    text = F.col(f"`{text_col}`").alias("measured_text")
    kept_columns = [F.col(f"`{c}`").alias("measured_text" if c == text_col else f"carried{i}") for i, c in enumerate(carry)]
    carried = ["measured_text" if c == text_col else f"carried{i}" for i, c in enumerate(carry)]
    wide = docs.select(*kept_columns, *([] if text_col in carry else [text]), *of_group)
    # Texts are read and measured once: what is carried is stored beside the statistics.
    slim = stored(with_statistics(wide, "measured_text", [*carried, "group_lang", "group_source"]), "statistics")

    passed = slim.where(~_base_failed())
    by_source = passed.groupBy("group_lang", "group_source").agg(F.count("*").alias("n_source"))
    by_lang = passed.groupBy("group_lang").agg(F.count("*").alias("n_lang"))
    total = passed.count()
    own = F.concat_ws("\u0001", F.lit("s"), "group_lang", "group_source")
    of_lang = F.concat_ws("\u0001", F.lit("l"), "group_lang")
    group = F.when(F.col("n_source") >= MIN_GROUP, own).when(F.col("n_lang") >= MIN_GROUP, of_lang)
    group = group.otherwise(F.lit("*") if total >= MIN_GROUP else F.lit(None).cast("string"))
    groups = stored(by_source.join(by_lang, "group_lang").select("group_lang", "group_source", group.alias("group")), "groups")

    used = groups.where("group is not null").select("group").distinct()
    fits = passed.select(_vector().alias("x"), F.explode(F.array(own, of_lang, F.lit("*"))).alias("group"))
    model = minimum_covariance(stored(_with_group(fits, stored(used, "groups")), "vectors"))

    of_rows = stored(groups.join(model, "group", "left"), "models")
    measured = (
        joins.lookup(slim, of_rows, ["group_lang", "group_source"], "left", spread_by=STATISTICS, max_rows=GROUPS_SENT)
        .withColumn("failed", _base_failed())
        .withColumn("x", _vector())
        .withColumn("d2", F.when(~F.col("failed"), _distance()))
    )
    kept = ~F.col("failed") & F.coalesce(F.col("d2") <= MAX_DISTANCE, F.lit(True))
    added = [*(F.col(c) for c in STATISTICS), F.col("failed"), F.col("d2"), kept]
    return measured.select(
        *(F.col(new).alias(old) for new, old in zip(carried, carry)), *(c.alias(n) for c, n in zip(added, names))
    )
