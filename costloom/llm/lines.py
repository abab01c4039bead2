"""Line deduplication: exact copies by hash, near copies by a deletion-neighbourhood join on words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from costloom.llm.storage import discard, fresh, stored
from costloom.llm.words import Chunk, chunks, constants, mix, power_of, sum_hash

MIN_WORDS = 8  # of both lines of a near pair; shorter lines are only compared for equality
BROADCAST_DOCS = 500_000  # documents with candidate lines sent to every executor at most; more are joined by a shuffle

_C = constants(4, 31)


class Lines:
    """The lines of a chunk that have a word."""

    def __init__(self, chunk: Chunk) -> None:
        breaks = np.flatnonzero(chunk.data == 0x0A)
        starts = np.sort(np.concatenate([chunk.bounds[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([breaks, chunk.bounds[1:]]), kind="stable")
        before = np.searchsorted(breaks, chunk.bounds)
        rows = np.repeat(np.arange(chunk.rows), np.diff(before) + 1)
        first, last = np.searchsorted(chunk.starts, starts), np.searchsorted(chunk.starts, ends)
        full = last > first
        self.rows, self.number = rows[full], (np.arange(len(starts)) - rows - before[rows])[full]
        self.first, self.last, self.starts, self.ends = first[full], last[full], starts[full], ends[full]
        self.size = self.last - self.first
        self.words = chunk.hashes(lower=False)
        self.hash1 = mix(sum_hash(self.words, self.first, self.last) + self.size.astype(np.uint64))
        self.hash2 = mix(sum_hash(mix(self.words ^ _C[0]), self.first, self.last))

    def half_keys(self) -> list[np.ndarray]:
        """First and second half of the line, as one of two lines of which the shorter has ``size`` or ``size - 1`` words."""
        found = []
        for shorter in (self.size, self.size - 1):
            half, rest = shorter // 2, shorter - shorter // 2
            tag = shorter.astype(np.uint64) * _C[1]
            found.append(mix(sum_hash(self.words, self.first, self.first + half) + tag))
            found.append(mix(sum_hash(self.words, self.last - rest, self.last) + tag + _C[2]))
        return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            lines = Lines(chunk)
            ids = batch.column(0).slice(chunk.first, chunk.rows).take(pa.array(lines.rows))
            keys = [pa.array(k.view(np.int64), mask=lines.size < MIN_WORDS + i // 2) for i, k in enumerate(lines.half_keys())]
            columns = [ids, pa.array(lines.number), pa.array(lines.size), pa.array(lines.hash1.view(np.int64)), pa.array(lines.hash2.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + keys, ["id", "line", "size", "h1", "h2", "k0", "k1", "k2", "k3"])


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, lines, hashes) to the texts of those lines."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        wanted, marks = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for chunk in chunks(texts):
            lines, out = Lines(chunk), []
            edge = np.searchsorted(lines.rows, np.arange(chunk.rows + 1))
            for row in range(chunk.rows):
                mine = dict(zip(lines.number[edge[row] : edge[row + 1]].tolist(), range(edge[row], edge[row + 1])))
                for number, mark in zip(wanted[chunk.first + row], marks[chunk.first + row]):
                    at = mine.get(number)
                    if at is not None and int(lines.hash1[at].view(np.int64)) == mark:
                        line = chunk.data[lines.starts[at] : lines.ends[at]].tobytes().decode()
                        out.append((ids[chunk.first + row], number, line))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["id", "line", "words"]
                )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line whole (gap -1) and with each of its words left out, as hashed keys."""
    names = ["key", "size", "gap", "id", "line"]
    for batch in batches:
        for chunk in chunks(batch.column(2)):
            lines = Lines(chunk)
            size = lines.size
            total = np.concatenate([[0], np.cumsum(size + 1)])
            line = np.repeat(np.arange(len(size)), size + 1)
            gap = np.arange(total[-1]) - total[line] - 1
            at, whole = lines.first[line] + gap, gap < 0
            left = sum_hash(lines.words, lines.first[line], np.where(whole, lines.last[line], at))
            right = sum_hash(lines.words, np.where(whole, lines.last[line], at + 1), lines.last[line])
            keys = mix(left + right * power_of(np.where(whole, 0, gap)) + (size[line] - ~whole).astype(np.uint64) * _C[3])
            rows = pa.array(chunk.first + lines.rows[line])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(size[line]), pa.array(gap), batch.column(0).take(rows), batch.column(1).take(rows)], names
            )


def within_one_word(a: list[str], b: list[str]) -> bool:
    """Can one inserted, deleted or replaced word make ``b`` of ``a``?"""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    front = next((i for i in range(short) if a[i] != b[i]), short)
    back = next((i for i in range(short - front) if a[-1 - i] != b[-1 - i]), short - front)
    return front + back >= max(len(a), len(b)) - 1


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spaces = " \t\n\v\f\r"
    cut = str.maketrans(dict.fromkeys(spaces, " "))
    for batch in batches:
        left, right = ([t.translate(cut).split(" ") for t in batch.column(i).to_pylist()] for i in (4, 5))
        good = [within_one_word([w for w in a if w], [w for w in b if w]) for a, b in zip(left, right)]
        yield batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines that repeat an earlier one: ``id``, ``line`` (from 0), ``size`` (words), ``kind``, ``of_id``, ``of_line``.

    Lines are the parts of a text between line feeds; those without a word never count. Earlier means a smaller
    (id, line). A line repeats one with the same words (kind ``exact``) or, if both have at least ``MIN_WORDS`` words,
    one that becomes it when a word is inserted, deleted or replaced (kind ``near``). ``of_id`` and ``of_line`` are the
    earliest such line, which may itself repeat a third.

    Equal lines are one before any join. Of the others, only those that share a half with another line can be near one
    (an edit leaves one half as it is), so only these emit their deletion neighbourhood: the line with each word left
    out. Lines equal without the same word are a substitution apart, whichever two of a bucket one takes, so a bucket
    needs its earliest row and no pairs; a whole line that equals another's variant is a deletion apart.

    Null and empty texts have no lines. Rows with a null id take no part. Rows that share an id count as one document:
    a line repeats only lines at a smaller place. Other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    lines = stored(
        source.mapInArrow(_scan, "id long, line long, size long, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long"), "lines"
    )
    same = ["h1", "h2", "size"]
    firsts = stored(
        lines.groupBy(*same).agg(
            F.min(F.struct("id", "line")).alias("at"), F.max(F.struct("id", "line")).alias("last"),
            *(F.first(k).alias(k) for k in ("k0", "k1", "k2", "k3")),
        ),
        "firsts",
    )
    halves = firsts.where(F.col("size") >= MIN_WORDS).select("h1", "h2", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    halves = halves.where("key is not null")
    met = halves.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("key")
    able = halves.join(met, "key", "left_semi").select("h1", "h2").distinct()
    places = (
        firsts.join(able, ["h1", "h2"], "left_semi")
        .groupBy(F.col("at.id").alias("id"))
        .agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "h1")).alias("found"))
        .select("id", F.col("found.line").alias("line"), F.col("found.h1").alias("h1"))
    )
    places = stored(places, "places")
    if places.count() <= BROADCAST_DOCS:
        places = F.broadcast(places)
    picked = source.join(places, "id").select("id", "text", "line", "h1").mapInArrow(_pick, "id long, line long, words string")
    picked = stored(picked.dropDuplicates(["id", "line"]), "picked")

    variants = picked.select("id", "line", "words").mapInArrow(_variants, "key long, size long, gap long, id long, line long")
    here, bucket = F.struct("id", "line"), Window.partitionBy("key")
    earliest = variants.select(
        here.alias("at"), "gap",
        F.min(here).over(Window.partitionBy("key", "size", "gap")).alias("replaced"),
        F.min(F.when(F.col("gap") < 0, here)).over(bucket).alias("whole"),
        F.min(F.when(F.col("gap") >= 0, here)).over(bucket).alias("longer"),
    )
    partners = F.when(F.col("gap") < 0, F.array("longer")).otherwise(F.array("replaced", "whole"))
    pairs = earliest.select("at", F.explode(partners).alias("of")).where("of < at").distinct()
    text = picked.select("id", "line", "words")
    checked = (
        pairs.select(F.col("at.id").alias("id"), F.col("at.line").alias("line"), F.col("of.id").alias("of_id"), F.col("of.line").alias("of_line"))
        .join(text.withColumnRenamed("words", "left"), ["id", "line"])
        .join(text.toDF("of_id", "of_line", "right"), ["of_id", "of_line"])
        .select("id", "line", "of_id", "of_line", "left", "right")
        .mapInArrow(_verify, "id long, line long, of_id long, of_line long")
    )
    near = checked.groupBy(F.struct("id", "line").alias("at")).agg(
        F.min(F.struct(F.col("of_id").alias("id"), F.col("of_line").alias("line"))).alias("near")
    )
    verdicts = stored(firsts.select(*same, "at", "last").join(near, "at", "left").where("near is not null or at < last"), "verdicts")
    discard(picked)
    found = lines.select(*same, "id", "line").join(verdicts, same).withColumn("here", here)
    exact: Column = F.col("at") < F.col("here")
    of = F.least(F.when(exact, F.col("at")), F.col("near"))
    return found.where(exact | F.col("near").isNotNull()).select(
        "id", "line", "size", F.when(exact, "exact").otherwise("near").alias("kind"), of["id"].alias("of_id"), of["line"].alias("of_line")
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its text less the lines of :func:`repeated_lines`, and how many those were (``n_dropped_lines``).

    Other lines stay as they are, in order; a null text stays null. Rows are returned as often as they come.
    """
    dropped = repeated_lines(docs, id_col, text_col).groupBy("id").agg(F.collect_set("line").alias("gone"))
    (name,) = fresh(docs, "n_dropped_lines")
    at, columns = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()
            for i, lines in enumerate(gone):
                if lines and texts[i] is not None:
                    skip = set(lines)
                    texts[i] = "\n".join(t for k, t in enumerate(texts[i].split("\n")) if k not in skip)
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            arrays.append(pa.array([len(x or ()) for x in gone], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, [*columns, name])

    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    rows = plain.join(dropped, F.col(f"c{columns.index(id_col)}").cast("long") == F.col("id"), "left").drop("id")
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
