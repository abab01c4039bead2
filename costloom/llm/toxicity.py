"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, so an unseen misspelling shares vectors with the word it comes from. A text
is scored by its most toxic window of ``WINDOW`` words, so a few words in a long text are not averaged away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from costloom.llm.storage import fresh, stored
from costloom.llm.words import Chunk, chunks, constants, mix

WINDOW = 6  # words
GRAM_SIZES = (3, 4, 5)  # characters, with a mark before and after the word
BUCKETS = 1 << 17
WIDTH = 8  # of a vector
TRAIN_ROWS = 4000  # labelled texts of each class that are learnt from, chosen by a hash
TRAIN_WINDOWS = 100_000  # windows of each class that reach the driver, chosen by a hash
ROUNDS, ROUND_WINDOWS = 3, 30_000  # of training, and windows of each class in one
EPOCHS, BATCH, RATE, PACE, DECAY = 4, 256, 0.5, 8.0, 1e-4
THRESHOLD = 0.3
KEPT_WORDS = 1 << 20  # word scores that a task remembers before it starts anew

_MARKS = np.zeros(256, bool)
_MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def trimmed(chunk: Chunk) -> Chunk:
    """The words without ASCII punctuation at either end; words of punctuation alone go."""
    n = len(chunk.data)
    inner = np.flatnonzero(~_MARKS[chunk.data])
    if not len(inner):
        return Chunk(chunk.first, chunk.last, chunk.data, chunk.bounds, inner, inner, np.zeros(chunk.rows + 1, np.int64))
    following = np.append(inner, n)[np.searchsorted(inner, chunk.starts)]
    previous = np.insert(inner, 0, -1)[np.searchsorted(inner, chunk.ends)] + 1
    good = following < previous
    words = np.concatenate([[0], np.cumsum(good)])[chunk.words]
    return Chunk(chunk.first, chunk.last, chunk.data, chunk.bounds, following[good], previous[good], words)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character n-grams, one after the other, and where each word's begin (and the end)."""
    marked = [f"<{w.lower() or ' '}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = np.concatenate([[0], np.cumsum([len(m) for m in marked])]).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.diff(edge))
    values, owners = [], []
    for size in GRAM_SIZES:
        if len(codes) >= size:
            total = np.zeros(len(codes) - size + 1, np.uint64)
            for j, factor in enumerate(constants(size, 40 + size)):
                total += codes[j : len(codes) - size + 1 + j] * factor
            inside = owner[: len(total)] == owner[size - 1 :]
            values.append(total[inside])
            owners.append(owner[: len(total)][inside])
    if not values:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    buckets = (mix(np.concatenate(values)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return buckets[order], np.concatenate([[0], np.cumsum(np.bincount(owners_all, minlength=len(words)))])


def _means(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Mean of each run of rows; runs are not empty."""
    sizes = np.diff(edge)
    shape = (-1,) + (1,) * (values.ndim - 1)
    return np.add.reduceat(values, edge[:-1], axis=0) / sizes.reshape(shape)


@dataclass
class Model:
    vectors: np.ndarray  # of the subwords, already times the softmax's weights: a log odds each
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    length: float = 0.0  # weight of the log of the number of windows

    def word_scores(self, words: list[str]) -> np.ndarray:
        buckets, edge = subwords(words)
        return _means(self.vectors[buckets], edge) if len(words) else np.zeros(0)

    def probability(self, peak: np.ndarray, windows: np.ndarray) -> np.ndarray:
        odds = self.slope * peak + self.length * np.log(np.maximum(windows, 1)) + self.offset
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


class Memory:
    """Scores of words already met, by hash."""

    def __init__(self, model: Model) -> None:
        self.model, self.hashes, self.scores = model, np.zeros(0, np.uint64), np.zeros(0)

    def of(self, chunk: Chunk) -> np.ndarray:
        hashes = chunk.hashes(lower=True)
        names, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > KEPT_WORDS:
            self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros(0)
        place = np.searchsorted(self.hashes, names)
        known = np.zeros(len(names), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == names[inside]
        values = np.zeros(len(names))
        values[known] = self.scores[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data = chunk.data
            values[new] = self.model.word_scores([data[chunk.starts[i] : chunk.ends[i]].tobytes().decode("utf-8", "replace") for i in first[new]])
            self.hashes = np.insert(self.hashes, place[new], names[new])
            self.scores = np.insert(self.scores, place[new], values[new])
        return values[at]


def peaks(column: pa.Array, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the most toxic window of each text, and its number of windows (0 without a word)."""
    peak, windows = np.full(len(column), memory.model.bias), np.zeros(len(column), np.int64)
    for whole in chunks(column):
        chunk = trimmed(whole)
        total = np.concatenate([[0.0], np.cumsum(memory.of(chunk))])
        sizes = np.diff(chunk.words)
        n = np.maximum(sizes - WINDOW + 1, (sizes > 0).astype(np.int64))
        rows = np.repeat(np.arange(chunk.rows), n)
        starts = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + chunk.words[rows]
        ends = np.minimum(starts + WINDOW, chunk.words[rows + 1])
        full = np.flatnonzero(n)
        if len(full):
            means = (total[ends] - total[starts]) / (ends - starts)
            peak[chunk.first + full] = memory.model.bias + np.maximum.reduceat(means, (np.cumsum(n) - n)[full])
        windows[chunk.first : chunk.last] = n
    return peak, windows


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) to windows of words one after the other, with a number that stands for the text."""
    for batch in batches:
        for whole in chunks(batch.column(0)):
            chunk, out = trimmed(whole), ([], [], [])
            marks = batch.column(1).slice(chunk.first, chunk.rows).to_pylist()
            draws = batch.column(2).slice(chunk.first, chunk.rows).to_pylist()
            for row in range(chunk.rows):
                for at in range(chunk.words[row], chunk.words[row + 1], WINDOW):
                    last = min(at + WINDOW, chunk.words[row + 1])
                    out[0].append(" ".join(chunk.data[chunk.starts[i] : chunk.ends[i]].tobytes().decode() for i in range(at, last)))
                    out[1].append(marks[row])
                    out[2].append(draws[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["words", "toxic", "draw"]
            )


def _summed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by ``at``."""
    return np.stack([np.bincount(at, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def train(windows: list[str], toxic: np.ndarray, seed: int = 7) -> Model:
    """Vectors of subwords and softmax weights by stochastic gradient descent over windows, with weight decay."""
    names: dict[str, int] = {}
    tokens = [np.array([names.setdefault(w, len(names)) for w in text.lower().split(" ")], np.int64) for text in windows]
    buckets, edge = subwords(list(names))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = random.uniform(-1, 1, (WIDTH, 2)), np.zeros(2)
    batches = math.ceil(len(tokens) / BATCH)
    for step in range(EPOCHS * batches):
        if step % batches == 0:
            order = random.permutation(len(tokens))
        chosen = order[step % batches * BATCH : (step % batches + 1) * BATCH]
        rate = RATE * (1 - step / (EPOCHS * batches))
        parts = [tokens[i] for i in chosen]
        counts = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), counts)
        words, local = np.unique(np.concatenate(parts), return_inverse=True)
        sizes = edge[words + 1] - edge[words]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        cells, cell = np.unique(buckets[np.arange(starts[-1]) - np.repeat(starts[:-1] - edge[words], sizes)], return_inverse=True)
        of_word = _means(vectors[cells][cell], starts)
        hidden = _summed(of_word[local], owner, len(parts)) / counts[:, None]
        odds = hidden @ weights + bias
        shares = np.exp(odds - odds.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        shares[np.arange(len(chosen)), toxic[chosen]] -= 1
        slope = (shares @ weights.T) / counts[:, None]  # per window; its words share it evenly
        per_word = _summed(slope[owner], local, len(words)) / sizes[:, None]
        weights -= rate * (hidden.T @ shares / len(chosen) + DECAY * weights)
        bias -= rate * shares.mean(axis=0)
        moved = _summed(np.repeat(per_word, sizes, axis=0), cell, len(cells))
        vectors[cells] -= rate * (PACE * moved + DECAY * vectors[cells])
    return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(windows: list[str], toxic: np.ndarray, text_of: np.ndarray, seed: int = 7) -> Model:
    """Train on windows with the labels of their texts, then again with the most toxic window of each toxic text.

    A label says that a text is toxic somewhere. After the first round, the windows of a toxic text compete, and only
    the highest stands for it; clean texts are clean in every window.
    """
    random = np.random.default_rng(seed)
    clean, found = np.flatnonzero(toxic == 0), np.flatnonzero(toxic == 1)
    column = pa.array(windows, pa.string())
    for turn in range(ROUNDS):
        some = random.permutation(clean)[:ROUND_WINDOWS]
        chosen = random.permutation(found)[:ROUND_WINDOWS]
        if turn:
            chosen = np.resize(chosen, max(len(chosen), len(some) // 3))
        kept = np.concatenate([some, chosen])
        model = train([windows[i] for i in kept], toxic[kept], seed)
        if turn < ROUNDS - 1:
            score, _ = peaks(column, Memory(model))
            mine = np.flatnonzero(toxic == 1)
            order = mine[np.lexsort((-score[mine], text_of[mine]))]
            found = order[np.concatenate([[True], text_of[order][1:] != text_of[order][:-1]])]
    return model


def settle_odds(model: Model, peak: np.ndarray, windows: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
    """Logistic regression of the label on a text's peak and length, by Newton steps with a little ridge."""
    x = np.stack([peak, np.log(np.maximum(windows, 1)), np.ones(len(peak))], axis=1)
    beta = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        share = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (weight * (share - toxic)) + 1e-3 * beta
        bend = (x * (weight * share * (1 - share))[:, None]).T @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        beta -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.length, model.offset = (float(b) for b in beta)


_GRAIN = 1 << 20


def _drawn(df: DataFrame, key: Column, wanted: int, of: dict[int, int]) -> DataFrame:
    """About ``wanted`` rows of each class, chosen by a hash; ``of`` has the rows there are."""
    limit = F.when(F.col("toxic") == 1, _GRAIN * wanted / of.get(1, 1)).otherwise(_GRAIN * wanted / of.get(0, 1))
    return df.where(F.pmod(key, F.lit(_GRAIN)) < limit)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> tuple[DataFrame, float]:
    """About ``TRAIN_ROWS`` labelled texts of each class, and the share of toxic labels among all.

    The labels are drawn before they meet the texts, by a hash of the id, and broadcast: texts are not shuffled.
    Null ids and labels other than 0 and 1 are ignored, repeated labels count once.
    """
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    marks = marks.where("id is not null and toxic in (0, 1)").distinct()
    totals = dict(marks.groupBy("toxic").count().collect())
    chosen = _drawn(marks, F.xxhash64("id"), TRAIN_ROWS, totals)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("text", "toxic")
    return stored(rows, "labelled"), totals.get(1, 0) / max(sum(totals.values()), 1)


def learn(
    labelled: DataFrame, share: float | None = None, text_col: str = "text", label_col: str = "toxic"
) -> Model | None:
    """Fit on the rows of ``labelled`` whose label is 0 or 1; None if a class is missing. ``share`` of the texts are
    toxic where the model is used (default: as in ``labelled``).

    About ``TRAIN_ROWS`` texts and ``TRAIN_WINDOWS`` windows of each class are drawn by hashes, copies of a text once;
    those windows are what reaches the driver.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    rows = rows.where("text is not null and toxic in (0, 1)")
    totals = dict(rows.groupBy("toxic").count().collect())
    if set(totals) != {0, 1}:
        return None
    sample = stored(_drawn(rows, F.xxhash64("text"), TRAIN_ROWS, totals).dropDuplicates(["text", "toxic"]), "labelled")
    cut = stored(sample.select("text", "toxic", F.xxhash64("text")).mapInArrow(_windows, "words string, toxic int, draw long"), "windows")
    sizes = dict(cut.groupBy("toxic").count().collect())
    if set(sizes) != {0, 1}:
        return None
    picked = _drawn(cut, F.xxhash64("words", "draw", F.lit(5)), TRAIN_WINDOWS, sizes).orderBy("toxic", "words", "draw").toPandas()
    words, toxic = picked["words"].tolist(), picked["toxic"].to_numpy(np.int64)
    model = fit(words, toxic, picked["draw"].to_numpy(np.int64))
    found = sample.select("text", "toxic").mapInArrow(_peaks_of(model), "toxic int, peak double, windows long").toPandas()
    mark = found["toxic"].to_numpy(float)
    share = share or totals[1] / (totals[0] + totals[1])  # undo the even sampling of the classes
    weight = np.where(mark == 1, share / max(mark.mean(), 1e-9), (1 - share) / max(1 - mark.mean(), 1e-9))
    settle_odds(model, found["peak"].to_numpy(), found["windows"].to_numpy(), mark, weight)
    return model


def _peaks_of(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(model)
        for batch in batches:
            peak, windows = peaks(batch.column(0), memory)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(peak), pa.array(windows)], ["toxic", "peak", "windows"])

    return run


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all) of every row, ``score`` (0 to 1, higher is more toxic) and ``predicted``.

    Whole texts are read; nothing but the text enters the score. Null texts, empty texts and texts of punctuation alone
    get score 0. Without a model (no labels of both classes) every score is 0. Repeated rows are returned as often as
    they come. Input columns named like an added column keep their name; the added one is prefixed with "_".
    """
    carry = list(docs.columns) if carry is None else carry
    names = fresh(docs.select(*[F.col(f"`{c}`") for c in carry]), "score", "predicted")
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    fields += [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = model and Memory(model)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if model is not None:
                peak, windows = peaks(batch.column(len(carry)), memory)
                score = np.where(windows > 0, model.probability(peak, windows), 0.0)
            columns = [batch.column(i) for i in range(len(carry))]
            columns += [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col(f"`{text_col}`").alias("text to read"))
    return rows.mapInArrow(run, T.StructType(fields)).toDF(*carry, *names)
