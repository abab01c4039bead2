"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costloom.llm.storage import stored
from costloom.llm.words import Chunk, chunks, mix, ngrams

GRAM = 3  # words in a seed
THRESHOLD = 0.5  # of the score that the whole item would have against itself
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 1 << 23  # of the filter sent to every task: 1 MB, whatever the number of items
BROADCAST_ROWS = 500_000  # seeds or contaminated documents sent to every executor at most; more are joined by a shuffle

_BETWEEN = np.ones(256, bool)  # words are runs of ASCII letters and digits and of other characters than ASCII
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of every n-gram."""
    values, at = ngrams(chunk.hashes(lower=True), chunk.words, GRAM)
    return values, at, np.searchsorted(chunk.words, at, side="right") - 1


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(1), space=_BETWEEN):
            values, at, rows = _grams(chunk)
            size = np.diff(chunk.words)[rows]
            columns = [batch.column(0).take(pa.array(chunk.first + rows)), pa.array(at - chunk.words[rows]), pa.array(values.view(np.int64)), pa.array(size)]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "item_at", "gram", "item_words"])


def _filter(grams: DataFrame) -> np.ndarray:
    """A bit for each slot that a gram falls into."""
    slot = F.shiftrightunsigned("gram", 64 - FILTER_BITS.bit_length() + 1)
    bits = grams.select(slot.alias("slot")).select(
        F.shiftright("slot", 6).alias("cell"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")
    )
    cells = bits.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()  # at most FILTER_BITS / 64 rows
    found = np.zeros(FILTER_BITS // 64, np.int64)
    for cell, value in cells:
        found[cell] = value
    return found.view(np.uint8)


def _passes(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    slot = values >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
    return (found[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _held(found: np.ndarray):
    """N-grams of the filter that a document holds, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.zeros(0, np.uint64)]
            for chunk in chunks(batch.column(0), space=_BETWEEN):
                values, _, _ = _grams(chunk)
                seen.append(np.unique(values[_passes(values, found)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(seen)).view(np.int64))], ["gram"])

    return run


def _passages(found: np.ndarray, reach: int):
    """The surroundings of the seeds in each text; neighbouring ones are one passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text_hash", "first_word", "passage", "at", "gram"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for chunk in chunks(batch.column(2), space=_BETWEEN):
                values, at, rows = _grams(chunk)
                hit = np.flatnonzero(_passes(values, found))
                if not len(hit):
                    continue
                at, rows, values = at[hit], rows[hit], values[hit].view(np.int64)
                cut = np.flatnonzero((np.diff(at) > 2 * reach) | (np.diff(rows) > 0)) + 1
                for lo, hi in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])):
                    row = rows[lo]
                    first = max(at[lo] - reach, chunk.words[row])
                    last = min(at[hi - 1] + reach, chunk.words[row + 1]) - 1
                    out[0].append(batch.column(0)[chunk.first + row])
                    out[1].append(batch.column(1)[chunk.first + row])
                    out[2].append(int(first - chunk.words[row]))
                    out[3].append(chunk.data[chunk.starts[first] : chunk.ends[last]].tobytes().decode())
                    out[4].append((at[lo:hi] - first).tolist())
                    out[5].append(values[lo:hi].tolist())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            scalars = [[x.as_py() for x in c] if i < 2 else c for i, c in enumerate(out)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(scalars, kinds)], names)

    return run


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and the first and last word of the passage in it."""
    steps = np.arange(len(passage) + 1) * -GAP
    before = np.zeros(len(passage) + 1, np.int64)
    origin = np.arange(len(passage) + 1)
    best = (0, 0, -1)
    for word in item:
        moved = before[:-1] + np.where(passage == word, MATCH, MISMATCH)
        score, start = np.zeros_like(before), np.arange(len(passage) + 1)
        up = before[1:] + GAP
        score[1:] = np.maximum(np.maximum(moved, up), 0)
        start[1:] = np.where(score[1:] == 0, start[1:], np.where(score[1:] == moved, origin[:-1], origin[1:]))
        rising = score + steps  # gaps along the passage: a running maximum
        top = np.maximum.accumulate(rising)
        source = np.maximum.accumulate(np.where(rising == top, np.arange(len(top)), 0))
        before, origin = top - steps, np.where(top > rising, start[source], start)
        end = int(before.argmax())
        if before[end] > best[0]:
            best = (int(before[end]), int(origin[end]), end - 1)
    return best


def _most(item: np.ndarray, passage: np.ndarray) -> int:
    """No alignment scores more: runs of matches are parted by an edit each, so edits + 1 >= matches - pairs kept."""
    matches = int(np.isin(item, passage).sum())
    pairs = [x[:-1] * np.uint64(3) + mix(x[1:]) for x in (item, passage)]
    return min(MATCH * matches, matches + int(np.isin(*pairs).sum()) + 1)


def _scores(threshold: float):
    """Rows (id, text hash, item, first word, passage, item text, first and last place to look at) to alignments that
    may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text_hash", "item_id", "score", "first_word", "n_words", "passage"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            passages = [None] * batch.num_rows
            for chunk in chunks(batch.column(4), space=_BETWEEN):
                hashes = chunk.hashes(lower=True)
                for row in range(chunk.rows):
                    lo, hi = chunk.words[row], chunk.words[row + 1]
                    passages[chunk.first + row] = (hashes[lo:hi], chunk.starts[lo:hi], chunk.ends[lo:hi], chunk.data)
            rest = {n: batch.column(n).to_pylist() for n in ("id", "text_hash", "item_id", "first_word", "lo", "hi")}
            for chunk in chunks(batch.column(5), space=_BETWEEN):
                hashes = chunk.hashes(lower=True)
                for row in range(chunk.rows):
                    at = chunk.first + row
                    item = hashes[chunk.words[row] : chunk.words[row + 1]]
                    words, starts, ends, data = passages[at]
                    lo, hi = max(rest["lo"][at], 0), min(rest["hi"][at], len(words))
                    if _most(item, words[lo:hi]) / (MATCH * len(item)) < threshold:
                        continue
                    score, first, last = align(item, words[lo:hi])
                    text = data[starts[lo + first] : ends[lo + last]].tobytes().decode() if last >= first else ""
                    out.append(
                        (rest["id"][at], rest["text_hash"][at], rest["item_id"][at], score / (MATCH * len(item)),
                         rest["first_word"][at] + lo + first, last - first + 1, text)
                    )
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def benchmark_matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """Documents that hold a copy of an item, exact or edited: ``id``, ``text_hash``, ``item_id``, ``score``,
    ``first_word``, ``n_words`` and ``passage`` of the best alignment of each document and item.

    Words are runs of letters, digits and non-ASCII characters, A-Z read as a-z. The score is that of the best local
    alignment (match 2, other word -1, gap -1) over what the item has against itself; matches reach ``threshold``.
    Seeds: every 3-gram of an item that some document holds. A text is aligned with every item of which three words in
    a row survive in it, over all that an alignment that reaches ``threshold`` can cover. A copy without such words
    scores 0.75 + 1 / (2 * words of the item) at most (with every third word replaced, 0.5) and is
    not found. Two narrow passes read the documents (n-grams held, then passages around seeds); only passages are
    shuffled. Both use a filter of fixed size, and an exact join follows. There is no cap on frequent seeds, so an item
    that leaked into a third of the corpus is found there.

    Null and empty texts match nothing, nor do items of fewer than three words. Rows with a null id keep it;
    ``text_hash`` (xxhash64) tells them apart. Repeated rows and repeated items give one match. Other columns are
    ignored. An empty table on either side gives an empty result.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    source = source.select("id", F.xxhash64("text").alias("text_hash"), "text")
    tests = items.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("item"))
    tests = stored(tests.where("item is not null and item_id is not null").distinct(), "items")
    grams = stored(tests.mapInArrow(_item_grams, "item_id long, item_at long, gram long, item_words long"), "grams")
    longest = grams.agg(F.max("item_words")).first()[0] or 0

    held = source.select("text").mapInArrow(_held(_filter(grams)), "gram long").distinct()
    seeds = stored(grams.join(held, "gram", "left_semi"), "seeds")
    near = F.broadcast(seeds) if seeds.count() <= BROADCAST_ROWS else seeds

    spare = 2 * max(1 - threshold, 0)  # words for each of the item's that an alignment may insert and reach the threshold
    passages = source.mapInArrow(
        _passages(_filter(seeds), longest + math.ceil(spare * longest) + GRAM),
        "id long, text_hash long, first_word long, passage string, at array<long>, gram array<long>",
    )
    passages = stored(passages.withColumn("passage_id", F.monotonically_increasing_id()), "passages")
    hits = passages.select("passage_id", F.explode(F.arrays_zip("at", "gram")).alias("hit"))
    hits = hits.select("passage_id", F.col("hit.at").alias("at"), F.col("hit.gram").alias("gram"))
    slack = F.ceil(F.col("item_words") * spare) + GRAM
    spans = (
        hits.join(near, "gram")
        .groupBy("passage_id", "item_id")
        .agg(
            F.min(F.col("at") - F.col("item_at") - slack).cast("long").alias("lo"),
            F.max(F.col("at") - F.col("item_at") + F.col("item_words") + slack).cast("long").alias("hi"),
        )
    )
    rows = spans.join(passages.drop("at", "gram"), "passage_id").join(tests, "item_id")
    scored = rows.select("id", "text_hash", "item_id", "first_word", "passage", "item", "lo", "hi").mapInArrow(
        _scores(threshold), "id long, text_hash long, item_id long, score double, first_word long, n_words long, passage string"
    )
    best = scored.where(F.col("score") >= threshold).groupBy("id", "text_hash", "item_id")
    order = F.struct("score", (-F.col("first_word")).alias("first"), "n_words", "passage")
    return best.agg(F.max(order).alias("m")).select(
        "id", "text_hash", "item_id", "m.score", (-F.col("m.first")).alias("first_word"), "m.n_words", "m.passage"
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row of ``docs`` whose text holds no copy of an item, unchanged; null texts stay."""
    bad = stored(benchmark_matches(docs, items, id_col, text_col, **options).select("id", "text_hash").distinct(), "contaminated")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    clean = rows.join(bad, at.cast("long").eqNullSafe(bad["id"]) & (F.xxhash64(text) == bad["text_hash"]), "left_anti")
    return clean.toDF(*docs.columns)
