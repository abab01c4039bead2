"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

Learned filters slide over every byte. A text is cut into chunks of ``CHUNK`` bytes that overlap by the width of a filter
less one, so that each window lies in exactly one chunk and the chunks cover the whole text. In each chunk the strongest
answer of every filter is kept; a small layer turns these into the odds of a chunk, and mean and least odds of the
chunks, with the length, into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from costloom.llm.storage import fresh, stored
from costloom.llm.words import text_buffers

CHUNK = 256  # bytes that windows of one chunk begin at
WIDTH, VECTOR, FILTERS, HIDDEN = 6, 8, 24, 12
PAD = 256  # stands behind the last byte
THRESHOLD = 0.3
TRAIN_ROWS = 1200  # labelled texts of each class that are learnt from, chosen by a hash
TRAIN_CHUNKS = 96  # of a longer labelled text, drawn evenly; scoring reads all chunks of every text
STEP_CHUNKS = 4  # of a text in one step of training, drawn anew each time
EPOCHS, BATCH, RATE = 12, 48, 0.004
PIECE = 1 << 15  # bytes whose answers are computed at once


@dataclass
class Network:
    vectors: np.ndarray  # (257, VECTOR), of the bytes and the pad
    filters: np.ndarray  # (WIDTH * VECTOR, FILTERS)
    bias: np.ndarray
    layer: np.ndarray  # (FILTERS, HIDDEN)
    layer_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    combine: np.ndarray  # weights of mean odds, least odds, log of the number of chunks, and one

    def answers(self, codes: np.ndarray) -> np.ndarray:
        """Of every filter at each place but the last ``WIDTH - 1``."""
        windows = np.lib.stride_tricks.sliding_window_view(self.vectors[codes].ravel(), WIDTH * VECTOR)[::VECTOR]
        return np.ascontiguousarray(windows) @ self.filters

    def rounded(self) -> Network:
        """Weights as multiples of 1/256. Sums of their products are then exact, so equal texts score alike wherever
        they stand, in any order of additions."""
        first, second, *others = (np.round(w.astype(np.float64) * 256) / 256 for w in (
            self.vectors, self.filters, self.bias, self.layer, self.layer_bias, self.out, self.out_bias
        ))
        return Network(first.astype(np.float32), second.astype(np.float32), *others, self.combine)

    def chunk_odds(self, peaks: np.ndarray) -> np.ndarray:
        found = np.maximum(peaks + self.bias, 0)
        return np.maximum(found @ self.layer + self.layer_bias, 0) @ self.out + self.out_bias[0]

    def probability(self, features: np.ndarray) -> np.ndarray:
        odds = sum(features[:, k] * weight for k, weight in enumerate(self.combine))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def coded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts as numbers, each text followed by ``WIDTH - 1`` pads; and where each begins."""
    sizes = np.diff(bounds)
    starts = np.concatenate([[0], np.cumsum(sizes + WIDTH - 1)])
    codes = np.full(starts[-1], PAD, np.int64)
    codes[np.arange(bounds[-1] - bounds[0]) + np.repeat(np.arange(len(sizes)) * (WIDTH - 1), sizes)] = data[bounds[0] : bounds[-1]]
    return codes, starts


def text_odds(network: Network, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of every chunk of each text (none of an empty one), and the number of chunks."""
    sizes = np.diff(bounds)
    n = -(-sizes // CHUNK)
    starts = np.repeat(bounds[:-1], n) + CHUNK * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    ends = np.minimum(starts + CHUNK, np.repeat(bounds[1:], n))
    peaks, first = np.empty((len(starts), FILTERS), np.float32), 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + PIECE, side="right")), first + 1)
        # Each chunk reads on into the next one of its text, or into pads.
        text_end = np.repeat(bounds[1:], n)[first:last]
        stop = np.minimum(ends[first:last] + WIDTH - 1, text_end)
        lengths = ends[first:last] - starts[first:last] + WIDTH - 1
        at = np.concatenate([[0], np.cumsum(lengths)])
        codes = np.full(at[-1], PAD, np.int64)
        real = stop - starts[first:last]
        inside = np.arange(real.sum()) - np.repeat(np.cumsum(real) - real, real)
        codes[np.repeat(at[:-1], real) + inside] = data[np.repeat(starts[first:last], real) + inside]
        answers = network.answers(codes)
        # Windows that cross from one chunk's end into the next chunk's beginning belong to neither.
        edges = np.stack([at[:-1], at[1:] - (WIDTH - 1)], axis=1).ravel()
        peaks[first:last] = np.maximum.reduceat(answers, np.minimum(edges, len(answers) - 1), axis=0)[::2]
        first = last
    return network.chunk_odds(peaks), n


def features_of(odds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text: mean and least odds of its chunks, log of their number, and one."""
    out = np.zeros((len(n), 4))
    full = np.flatnonzero(n)
    firsts = (np.cumsum(n) - n)[full]
    if len(full):
        out[full, 0] = np.add.reduceat(odds, firsts) / n[full]
        out[full, 1] = np.minimum.reduceat(odds, firsts)
    out[:, 2], out[:, 3] = np.log(np.maximum(n, 1)), 1
    return out


def train(texts: list[bytes], label: np.ndarray, seed: int = 5) -> Network:
    """Fit all weights by back-propagation (Adam); in each step a few chunks speak for a text."""
    random = np.random.default_rng(seed)
    scale = [0.5, 1 / np.sqrt(WIDTH * VECTOR * 0.25), 0, 1 / np.sqrt(FILTERS), 0, 1 / np.sqrt(HIDDEN), 0]
    shapes = [(PAD + 1, VECTOR), (WIDTH * VECTOR, FILTERS), (FILTERS,), (FILTERS, HIDDEN), (HIDDEN,), (HIDDEN,), (1,)]
    weights = [(random.standard_normal(shape) * s).astype(np.float32) for shape, s in zip(shapes, scale)]
    network = Network(*weights, np.array([1.0, 0.0, 0.0, 0.0]))
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    codes, starts = coded(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    n_chunks = np.maximum(-(-(np.diff(starts) - WIDTH + 1) // CHUNK), 1)
    steps = EPOCHS * -(-len(texts) // BATCH)
    for step in range(steps):
        at = step % -(-len(texts) // BATCH)
        if not at:
            order = random.permutation(len(texts))
        chosen = order[at * BATCH : (at + 1) * BATCH]
        taken = np.minimum(n_chunks[chosen], STEP_CHUNKS)
        owner = np.repeat(np.arange(len(chosen)), taken)
        chunk = (random.random(len(owner)) * n_chunks[chosen][owner]).astype(np.int64)
        begin = starts[chosen][owner] + CHUNK * chunk
        places = begin[:, None] + np.arange(CHUNK + WIDTH - 1)
        block = np.where(places < starts[chosen + 1][owner][:, None], codes[np.minimum(places, len(codes) - 1)], PAD)
        answers = np.stack([network.answers(row) for row in block])
        peak = answers.argmax(axis=1)
        best = np.take_along_axis(answers, peak[:, None, :], axis=1)[:, 0]
        found = np.maximum(best + network.bias, 0)
        hidden = np.maximum(found @ network.layer + network.layer_bias, 0)
        odds = np.bincount(owner, hidden @ network.out + network.out_bias[0], len(chosen)) / taken
        share = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        slope = (((share - label[chosen]) / len(chosen) / taken)[owner]).astype(np.float32)
        d_hidden = slope[:, None] * network.out * (hidden > 0)
        d_found = d_hidden @ network.layer.T * (found > 0)
        seen = np.take_along_axis(block[:, None, :], peak[:, :, None] + np.arange(WIDTH), axis=2)  # chunk, filter, place
        read = network.vectors[seen].reshape(len(block), FILTERS, -1)
        moved = (d_found[:, :, None] * network.filters.T).reshape(-1, VECTOR)  # of each byte read
        d_vectors = np.stack([np.bincount(seen.ravel(), moved[:, k], PAD + 1) for k in range(VECTOR)], axis=1)
        slopes = [
            d_vectors, np.einsum("cf,cfk->kf", d_found, read), d_found.sum(axis=0), found.T @ d_hidden, d_hidden.sum(axis=0),
            hidden.T @ slope, slope.sum(keepdims=True),
        ]
        rate = RATE * min(1.0, 2.0 * (1 - step / steps))
        for weight, gradient, (mean, square) in zip(weights, slopes, moments):
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient * gradient - square)
            weight -= rate * (mean / (1 - 0.9 ** (step + 1))) / (np.sqrt(square / (1 - 0.99 ** (step + 1))) + 1e-7)
    return network.rounded()


def settle_odds(network: Network, features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
    """Logistic regression of the label on the features of whole texts, by Newton steps with a little ridge."""
    beta = np.array([1.0, 0.0, 0.0, 0.0])
    for _ in range(60):
        share = 1 / (1 + np.exp(-np.clip(features @ beta, -500, 500)))
        slope = features.T @ (weight * (share - label)) + 1e-2 * beta
        bend = (features * (weight * share * (1 - share))[:, None]).T @ features + 1e-2 * np.eye(4)
        step = np.linalg.solve(bend, slope)
        beta -= step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    network.combine = beta


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Network | None:
    """Fit on labelled texts; None if a class is missing.

    Labels other than 0 and 1, null ids and null texts are ignored; repeated labels and copies of a text count once. About
    ``TRAIN_ROWS`` texts a class are drawn by a hash of the id before the labels, broadcast, meet the texts. The driver
    receives these texts, of each at most ``TRAIN_CHUNKS`` chunks, spread evenly over it.
    """
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marks = marks.where("id is not null and label in (0, 1)").distinct()
    totals = dict(marks.groupBy("label").count().collect())
    if set(totals) != {0, 1}:
        return None
    grain = 1 << 20
    limit = F.when(F.col("label") == 1, grain * TRAIN_ROWS / totals[1]).otherwise(grain * TRAIN_ROWS / totals[0])
    chosen = marks.where(F.pmod(F.xxhash64("id"), F.lit(grain)) < limit)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("bytes"))
    n = F.ceil(F.length("bytes") / CHUNK)
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(TRAIN_CHUNKS - 1)),
        lambda i: F.substring("bytes", F.floor(i * n / TRAIN_CHUNKS).cast("int") * CHUNK + 1, F.lit(CHUNK)),
    )
    cut = F.when(n <= TRAIN_CHUNKS, F.col("bytes")).otherwise(F.concat(*(spread[i] for i in range(TRAIN_CHUNKS))))
    rows = texts.where("bytes is not null and length(bytes) > 0").join(F.broadcast(chosen), "id").select(cut.alias("bytes"), "label")
    picked = stored(rows.dropDuplicates(["bytes", "label"]), "labelled").orderBy("label", "bytes").toPandas()
    label = picked["label"].to_numpy(np.float64)
    if len(set(label)) < 2:
        return None
    sample = [bytes(b) for b in picked["bytes"]]
    network = train(sample, label)
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in sample])])
    features = features_of(*text_odds(network, np.frombuffer(b"".join(sample), np.uint8), bounds))
    share = totals[1] / (totals[0] + totals[1])  # undo the even sampling of the classes
    settle_odds(network, features, label, np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean())))
    return network


def scored(docs: DataFrame, network: Network | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all) of every row, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Whole texts are read, however long; nothing but the text enters the score. Null and empty texts, and all texts without
    a network, get 0. Repeated rows are returned as often as they come and score alike; an empty table gives no rows.
    Input columns named like an added column keep their name; the added one is prefixed with "_".
    """
    carry = list(docs.columns) if carry is None else carry
    names = fresh(docs.select(*[F.col(f"`{c}`") for c in carry]), "score", "predicted")
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    fields += [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if network is not None and batch.num_rows:
                odds, n = text_odds(network, *text_buffers(batch.column(len(carry))))
                score = np.where(n > 0, network.probability(features_of(odds, n)), 0.0)
            columns = [batch.column(i) for i in range(len(carry))]
            columns += [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col(f"`{text_col}`").alias("text to read"))
    return rows.mapInArrow(run, T.StructType(fields)).toDF(*carry, *names)
