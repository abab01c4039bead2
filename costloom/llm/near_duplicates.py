"""Near-duplicate documents: a multi-index Hamming join on b-bit MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from costloom.llm.components import components
from costloom.llm.storage import discard, stored
from costloom.llm.words import chunks, constants, mix, ngrams

CHUNKS = 14  # of a signature
SYMBOLS = 7  # eight-bit symbols in a chunk
BROADCAST_IDS = 500_000  # rows of three integers sent to every executor at most; more are joined by a shuffle

_WIDTH = CHUNKS * SYMBOLS
_FACTORS = (constants(_WIDTH, 71) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (constants(_WIDTH, 72) >> np.uint64(32)).astype(np.uint32)
_BLOCK = 512  # shingles hashed at once; the table of all functions fits a core's cache


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row. A text of fewer words is one shingle; no word, no shingle."""
    for chunk in chunks(column):
        hashes = chunk.hashes(lower=True)
        grams, at = ngrams(hashes, chunk.words, size)
        edge = np.searchsorted(at, chunk.words)
        for row in range(chunk.rows):
            lo, hi = chunk.words[row], chunk.words[row + 1]
            if hi - lo >= size:
                yield chunk.first + row, np.unique(grams[edge[row] : edge[row + 1]])
            elif hi > lo:
                short = (hashes[lo:hi] * constants(size, 3)[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                yield chunk.first + row, mix(np.array([short], np.uint64))
            else:
                yield chunk.first + row, np.zeros(0, np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    """One byte of the least value under each of the hash functions."""
    least = np.full(_WIDTH, 0xFFFFFFFF, np.uint32)
    folded = (values >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(folded), _BLOCK):
        table = _FACTORS[:, None] * folded[None, start : start + _BLOCK]
        table += _SHIFTS[:, None]
        np.minimum(least, table.min(axis=1), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            count, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            marks = np.zeros((n, _WIDTH), np.uint8)
            for row, values in shingle_sets(batch.column(1), size):
                count[row] = len(values)
                if len(values):
                    prints[row, 0] = values.sum(dtype=np.uint64)
                    prints[row, 1] = mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                    marks[row] = signature(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(count), pa.array(prints[:, 0].view(np.int64)),
                 pa.array(prints[:, 1].view(np.int64)), _binary(marks)],
                ["id", "text_hash", "n_shingles", "print1", "print2", "signature"],
            )

    return run


def _keys(batches):
    """Every chunk once with each of its symbols left out: 48 bits of symbols under the number of the gap."""
    gaps = (np.uint64(0xFF) << (np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(8))) ^ np.uint64(0xFFFFFFFFFFFFFFFF)
    names = np.arange(_WIDTH, dtype=np.uint64).reshape(CHUNKS, SYMBOLS) << np.uint64(56)
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            n, column = batch.num_rows, batch.column(1)
            marks = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, CHUNKS, SYMBOLS)
            packed = np.zeros((n, CHUNKS), np.uint64)
            for j in range(SYMBOLS):
                packed |= marks[:, :, j].astype(np.uint64) << np.uint64(8 * j)
            keys = (packed[:, :, None] & gaps[None, None, :]) | names[None]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), _WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "node"])


def _confirm(size: int, percent: int):
    """Of rows (a, b, text of a, text of b), those whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            left = dict(shingle_sets(batch.column(2), size))
            keep = np.zeros(batch.num_rows, bool)
            for row, values in shingle_sets(batch.column(3), size):
                shared = len(np.intersect1d(left[row], values, assume_unique=True))
                union = len(left[row]) + len(values) - shared
                keep[row] = union > 0 and 100 * shared >= percent * union
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"]
            )

    return run


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_confirm(size, percent), "a long, b long")


def _tokens(size: int):
    """Rows (node, comp, text) to one row per shingle of the set."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [values for _, values in shingle_sets(part.column(2), size)]
                n = np.array([len(v) for v in sets], np.int64)
                rows = pa.array(np.repeat(np.arange(len(n)), n))
                token = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.repeat(n, n)), pa.array(token)],
                    ["node", "comp", "n", "token"],
                )

    return run


def _across(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of nodes (a, b) of different components that may be linked, without pairing whole buckets.

    Rows (node, comp) are those that met others in a bucket. In any one order of all shingles, two linked sets share a
    shingle near the beginning of both: if u and v have i and j shingles before their first common one, at most
    n_u - i and n_v - j are shared, and a link needs percent (n_u + n_v) / (100 + percent). The order is by rarity among
    these nodes, so what a copy has for itself comes first and meets nobody. Longer sets look for shorter ones by
    shingle and size class, only as far as their place allows. Within a shingle, rows of its largest component are
    paired with those of others only.
    """
    sets = texts.join(rows, "node").select("node", "comp", "text")
    tokens = stored(sets.mapInArrow(_tokens(size), "node long, comp long, n long, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("df > 1")
    of_node = Window.partitionBy("node")
    ranked = tokens.join(often, "token").withColumn("place", F.row_number().over(of_node.orderBy("df", "token")))
    place = F.col("n") - F.count("*").over(of_node) + F.col("place") - 1  # shingles of the node alone come first
    ranked = ranked.withColumn("place", place).where("lo < hi").where(f"100 * (n - place) >= {percent} * n")
    prefix = stored(ranked.select("node", "comp", "n", "token", "place"), "prefix")
    counts = prefix.groupBy("token", "comp").agg(F.count("*").alias("k"))
    largest = counts.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.count("*").alias("comps"))
    prefix = prefix.join(largest.where("comps > 1"), "token")

    def step(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / math.log(1.02)).cast("int")

    shorter = F.least(F.col("n"), F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent).cast("long") - F.col("n"))
    least = F.ceil(F.col("n") * percent / 100).cast("long")
    longer = prefix.where(shorter >= least).withColumn("step", F.explode(F.sequence(step(least), step(shorter))))
    shorter_sets = prefix.where(f"{100 + percent} * (n - place) >= {2 * percent} * n").select(
        "token", step(F.col("n")).alias("step"), *(F.col(c).alias(f"{c}2") for c in ("node", "comp", "n", "place"))
    )
    fits = f"n2 <= n and comp <> comp2 and {100 + percent} * least(n - place, n2 - place2) >= {percent} * (n + n2)"
    pairs = [
        longer.where("comp <> largest").join(shorter_sets, ["token", "step"]),
        longer.where("comp = largest").join(shorter_sets.join(largest, "token").where("comp2 <> largest").drop("largest", "comps"), ["token", "step"]),
    ]
    return (
        pairs[0].where(fits).select("node", "node2")
        .union(pairs[1].where(fits).select("node", "node2"))
        .select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` (least id reachable by links) and ``kept``.

    Two documents are linked when their sets of distinct ``size``-word shingles (A-Z read as a-z) have a Jaccard
    similarity of at least ``percent`` / 100. Signatures have 98 one-byte MinHash symbols in 14 chunks of 7. A pair
    that differs in at most 27 symbols has a chunk with at most one differing symbol (pigeonhole), and each document
    enumerates the allowed error: every chunk with each symbol left out is a key, so each such pair meets in a bucket.
    A pair of similarity 0.8 misses every bucket with a probability of 6 in a million, one of 0.85 of 1 in a hundred
    million. Equal sets are one node before any join. Buckets are not expanded into all pairs: rows are first
    tested against the first and the previous row of their bucket; rows of a bucket that are then in different
    components are compared by their rarest shingles (:func:`_across`), so no link between components is lost.

    Null or empty texts and texts without a word have no shingles, no links and are kept. Rows that share an id are
    linked, and each is returned. Rows with a null id are returned with a null component, kept, and linked with
    nothing. Other columns are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    source = source.select("id", "text", F.xxhash64("text").alias("text_hash"))
    sketch = stored(
        source.select("id", "text", "text_hash").mapInArrow(
            _sketches(size),
            "id long, text_hash long, n_shingles long, print1 long, print2 long, signature binary",
        ),
        "sketch",
    )
    sets = ["print1", "print2", "n_shingles"]
    marked = sketch.where("id is not null and n_shingles > 0")
    least = marked.groupBy(*sets).agg(F.min(F.struct("id", "text_hash", "signature")).alias("m"))
    nodes = stored(least.select(F.monotonically_increasing_id().alias("node"), *sets, "m.*"), "nodes")
    members = marked.select("id", *sets).join(nodes.select("node", *sets), sets).select("id", "node")
    spread = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    same_id = members.join(spread, "id").where("node > a").select("a", F.col("node").alias("b")).distinct()

    order = Window.partitionBy("key").orderBy("node")
    buckets = stored(
        nodes.select("node", "signature")
        .mapInArrow(_keys, "key long, node long")
        .select("key", "node", *(f.over(order).alias(n) for n, f in (("before", F.lag("node")), ("after", F.lead("node")), ("first", F.first("node")))))
        .where("before is not null or after is not null")
        .drop("after"),
        "buckets",
    )
    needed = stored(buckets.select("node").distinct().join(nodes.select("node", "id", "text_hash"), "node"), "needed")
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    texts = stored(source.join(needed, ["id", "text_hash"]).select("node", "text").dropDuplicates(["node"]), "texts")

    near = buckets.select(F.explode(F.array("before", "first")).alias("a"), F.col("node").alias("b"))
    tested = stored(near.where("a < b").distinct(), "tested")
    links = stored(_linked(tested, texts, size, percent).union(same_id), "links")
    labels = components(links)
    rows = buckets.select("key", "node").join(labels, "node", "left")
    rows = rows.select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rows = rows.join(mixed.select("key"), "key", "left_semi").select("node", "comp").distinct()
    pairs = stored(_across(rows, texts, size, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    found = stored(_linked(pairs, texts, size, percent), "links")
    if not found.isEmpty():
        labels = components(links.union(found))
    discard(buckets, texts)

    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first_id = named.groupBy("component").agg(F.min("id").alias("component_id"))
    found = named.join(first_id, "component").select(*sets, "component_id")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component_id")), F.col("id"))
    return (
        sketch.select("id", *sets)
        .join(found, sets, "left")
        .select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
    )
