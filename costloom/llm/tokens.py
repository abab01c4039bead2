"""Token counts: an exact histogram of encoded lengths answers totals and quantiles for every context limit."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from costloom.llm.storage import stored

# Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STEP = 1024  # lengths in a block of the suffix sums
# The pattern's look-ahead overflows the stack on a run of about a million blanks, so long runs are encoded apart.
_LONG_BLANK = re.compile(r"[^\S\x1c-\x1f]{10000,}")


def n_tokens(encoding, text: str) -> int:
    """Number of tokens of a whole text.

    The pattern makes one token run of all blanks but the last, which goes with what follows; at the end of a text it
    takes all of them. A run begins a new match, because nothing but blanks goes on across it.
    """
    total, at = 0, 0
    for run in _LONG_BLANK.finditer(text):
        first, last = run.span()
        split = last if last == len(text) else last - 1
        total += len(encoding.encode_ordinary(text[at:first])) + len(encoding._encode_single_piece(text[first:split]))
        at = split
    return total + len(encoding.encode_ordinary(text[at:]))


def encoded_lengths(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``n_tokens`` and ``docs``: how many texts have that many tokens. Null and empty texts have none.

    ``vocabulary`` is a file of byte-pair ranks that the driver reads; it travels with the job. Whole texts are encoded,
    of any length, runs of blanks included; strings that look like special tokens are ordinary text. Repeated rows and
    equal lengths are counted each, an empty table gives no rows, and no other column is read, so none can clash. Each
    batch sends one row per length.
    """
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    packed = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=packed.value, special_tokens={})
        for batch in batches:
            lengths = [n_tokens(encoding, t) if t else 0 for t in batch.column(0).to_pylist()]
            sizes, n = np.unique(np.array(lengths, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(n.astype(np.int64))], ["n_tokens", "docs"])

    rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "n_tokens long, docs long")
    return rows.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def context_limits(lengths: DataFrame) -> DataFrame:
    """For every occurring length as context limit, from the histogram alone.

    ``docs`` of that length, ``docs_longer`` (cut by the limit), ``docs_within``, ``tokens_within`` (of uncut texts),
    ``truncated_tokens`` (left when every text is cut at the limit), ``total_tokens`` and ``quantile``, the share of
    documents within. Sums run inside blocks of lengths, then over the blocks, so no task holds all lengths. Between
    two lengths L < M, a limit X leaves truncated_tokens(L) + (X - L) * docs_longer(L). The histogram is stored first,
    because both sums read it.
    """
    rows = stored(lengths, "lengths").withColumn("block", F.floor(F.col("n_tokens") / STEP)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    upward = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(upward), F.lit(0)).alias("docs_below"),
        F.coalesce(F.sum("block_tokens").over(upward), F.lit(0)).alias("tokens_below"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens")
    summed = rows.join(blocks, "block").select(
        "n_tokens", "docs", "all_docs", "total_tokens",
        (F.col("docs_below") + F.sum("docs").over(inside)).alias("docs_within"),
        (F.col("tokens_below") + F.sum("tokens").over(inside)).alias("tokens_within"),
    )
    longer = F.col("all_docs") - F.col("docs_within")
    return summed.select(
        "n_tokens", "docs", longer.alias("docs_longer"), "docs_within", "tokens_within",
        (F.col("tokens_within") + F.col("n_tokens") * longer).alias("truncated_tokens"),
        "total_tokens", (F.col("docs_within") / F.col("all_docs")).alias("quantile"),
    )


def length_quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least each share of the documents stays within."""
    wanted = F.array(*(F.lit(float(s)) for s in shares))
    met = limits.select("n_tokens", F.explode(F.filter(wanted, lambda s: s <= F.col("quantile"))).alias("share"))
    return met.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
