"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

After full tokenisation, ends that both tokenizers share before tokens marked by a space cut a document into windows of
token ids. The same windows return all over a corpus, so a task aligns each tuple of ids once and remembers it.

Texts that are null, empty, or that either tokenizer does not give back byte by byte (as a leading space and the text)
have no tokens: zeros, empty arrays and an empty digest. Whole texts are read. Repeated rows are returned as often as
they come, an empty table gives no rows, and input columns named like an added column keep their name; the added one is
prefixed with "_".
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from costloom.llm.storage import fresh, stored
from costloom.operators.joins import lookup

PIECE_BYTES = 1 << 20  # text worked on at once inside a batch
KEPT = 400_000  # words that a Python worker remembers, with their windows, before it starts anew
PAIR_BOUNDS = {"max_rows": 3_000_000, "max_bytes": 192 << 20}  # a larger table of pairs is joined by a shuffle

# A word ends where a space follows something that is not white space. Neither tokenizer has a token across that place.
_WORD_END = re.compile(r"(?<=\S)(?= )")
_BLANK_BEFORE_SPACE = re.compile(r" (?<=\s )")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others for
    256 and up in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pool:
    """Runs of integers, added one after the other and gathered by number."""

    def __init__(self) -> None:
        self.values, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)])

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.ends[numbers + 1] - self.ends[numbers]

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs one after the other, and the size of each."""
        sizes = self.sizes(numbers)
        first = np.repeat(self.ends[numbers] - (np.cumsum(sizes) - sizes), sizes)
        return self.values[first + np.arange(len(first))].astype(np.int64), sizes


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.first = tokenizers.Tokenizer.from_str(byte_level)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.first.get_vocab_size(with_added_tokens=True)
        for token, i in self.first.get_vocab(with_added_tokens=True).items():
            known = all(c in alphabet for c in token)
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.b_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        # A token as it stands in the written groups: inside one, at the end of its first half, at its end.
        self.n_ids = max(len(self.a_bytes), len(names))
        self.written = np.array([f"{i}{mark}" for mark in ",|;" for i in range(self.n_ids)], object)
        # Words are encoded apart only if no piece goes on after a space, so that none could cross a word's end.
        self.by_words = "▁" in names and not any("▁" in name.lstrip("▁") for name in names)
        self.blank = names.index("▁") if self.by_words else 0
        self.a_sizes, self.b_sizes = [len(b) for b in self.a_bytes], [len(b) for b in self.b_bytes]
        self.a_size, self.b_size = np.array(self.a_sizes, np.int64), np.array(self.b_sizes, np.int64)
        self.a_spaced = np.array([b[:1] == b" " for b in self.a_bytes])
        self.b_spaced = np.array([name[:1] == "▁" for name in names])

    def split(self, text: str) -> list[str]:
        """Words of a text, each without the space before it."""
        if not self.by_words:
            return [text]
        if text[:1] != " " and not _BLANK_BEFORE_SPACE.search(text):
            return text.split(" ")
        return [word[1:] for word in _WORD_END.split(" " + text)]

    def encode(self, words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For both tokenizers, the ids of all words one after the other and their numbers; and which words both give
        back byte by byte."""
        wanted = [b" " + word.encode() for word in words]
        sizes = np.array(list(map(len, wanted)), np.int64)
        whole, sound, out = b"".join(wanted), np.ones(len(words), bool), []
        # A text that ends in one space leaves a word without a character; the library gives no prefix to that.
        second = [ids or [self.blank] for ids in self.second.encode(words, num_threads=1)]
        flat_second = np.array(list(chain.from_iterable(second)), np.int64), np.array(list(map(len, second)), np.int64)
        for (flat, n), table, lengths in ((self._first(words, sizes), self.a_bytes, self.a_size), (flat_second, self.b_bytes, self.b_size)):
            out.append((flat, n))
            ends = np.cumsum(lengths[flat])[np.cumsum(n) - 1]
            if not (ends == np.cumsum(sizes)).all() or b"".join([table[i] for i in flat.tolist()]) != whole:
                parts = np.split(flat, np.cumsum(n)[:-1])
                sound &= [b"".join([table[i] for i in part.tolist()]) == text for part, text in zip(parts, wanted)]
        return out, sound

    def _first(self, words: list[str], sizes: np.ndarray, together: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the first tokenizer. Words that end in no blank are encoded in one string, which is quicker."""
        plain = [i for i, word in enumerate(words) if self.by_words and word and not word[-1:].isspace()]
        runs = [plain[at : at + together] for at in range(0, len(plain), together)]
        coded = [c.ids for c in self.first.encode_batch_fast([" " + " ".join([words[i] for i in run]) for run in runs], add_special_tokens=False)]
        # Words of the joined strings in one row: their ends must be ends of tokens, else the word is encoded apart.
        ids = np.array(list(chain.from_iterable(coded)), np.int64)
        ends, cuts = np.cumsum(self.a_size[ids]), np.cumsum(sizes[plain])
        places = np.searchsorted(ends, cuts)
        if len(plain) and (places[-1] >= len(ends) or (ends[places] != cuts).any()):
            plain, ids, places = [], ids[:0], places[:0]
        others = sorted(set(range(len(words))) - set(plain))
        apart = [self.first.encode(" " + words[i], add_special_tokens=False).ids for i in others]
        found = Pool()
        found.add(ids, np.diff(places, prepend=-1))
        found.add(np.array(list(chain.from_iterable(apart)), np.int64), np.array(list(map(len, apart)), np.int64))
        order = np.empty(len(words), np.int64)
        order[[*plain, *others]] = np.arange(len(words))
        return found.take(order)


@dataclass
class Aligned:
    """The alignment of some texts: words and windows one after the other, and per text the sizes."""

    words: np.ndarray  # number of each word
    windows: np.ndarray  # number of each window
    n_windows: np.ndarray  # of each text
    n_a: np.ndarray
    n_b: np.ndarray


_APART = b"\xff" * 4  # between the ids of both tokenizers in the name of a window; no id


@dataclass
class Aligner:
    tokens: Tokenizers

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.a, self.b, self.windows_of, self.sound = Pool(), Pool(), Pool(), np.zeros(0, bool)  # by word
        self.windows: dict[bytes, int] = {}  # by the ids of both tokenizers
        self.links, self.group_sizes, self.texts = Pool(), Pool(), []  # by window
        self.pair_number: dict[int, int] = {}  # by (id of the first << 32) + id of the second

    def _meet(self, words: list[str]) -> None:
        """Tokenise new words and find their windows.

        A document's tokens are those of its words. A word's end is an end of both tokenizers, and the next word begins
        with a space in both, so it is an anchor; further anchors lie inside words that hold runs of blanks.
        """
        ((a, n_a), (b, n_b)), sound = self.tokens.encode(words)
        self.a.add(a, n_a)
        self.b.add(b, n_b)
        tokens, word = self.tokens, np.arange(len(words))
        a, b = a[sound[np.repeat(word, n_a)]], b[sound[np.repeat(word, n_b)]]
        # Both cover the same bytes of every sound word, so places count through all of them.
        a_ends, b_ends = np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b])
        i = np.flatnonzero(np.isin(a_ends, b_ends, assume_unique=True))
        j = np.searchsorted(b_ends, a_ends[i])
        anchor = np.append(tokens.a_spaced[a], True)[i + 1] & np.append(tokens.b_spaced[b], True)[j + 1]
        last = np.cumsum(n_a * sound)
        anchor |= np.isin(i + 1, last)
        i, j = i[anchor] + 1, j[anchor] + 1
        a_ids, b_ids = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        edges = [[0, *(4 * at).tolist()] for at in (i, j)]
        keys = [a_ids[p:q] + _APART + b_ids[r:t] for p, q, r, t in zip(edges[0], edges[0][1:], edges[1], edges[1][1:])]
        found = list(map(self.windows.get, keys))
        if None in found:
            self._learn(list(dict.fromkeys(key for key, known in zip(keys, found) if known is None)))
            found = list(map(self.windows.get, keys))
        n = np.bincount(np.flatnonzero(sound)[np.searchsorted(last[sound], i)], minlength=len(words))
        self.windows_of.add(np.array(found, np.int64), n)
        self.sound = np.concatenate([self.sound, sound])
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))

    def _learn(self, keys: list[bytes]) -> None:
        """Align new windows: their groups, and a link for each pair of tokens that share a byte.

        Both sides of a window cover the same bytes, so places count through all of them.
        """
        tokens = self.tokens
        ids = np.frombuffer(b"".join([key + _APART for key in keys]), "<u4").astype(np.int64)
        apart = np.flatnonzero(ids == 0xFFFFFFFF)
        first, second = apart[::2], apart[1::2]
        n_a, n_b = first - np.append(0, second[:-1] + 1), second - first - 1
        of_a = np.repeat(np.tile([True, False], len(keys)), np.stack([n_a + 1, n_b + 1], axis=1).ravel())
        a, b = ids[of_a & (ids != 0xFFFFFFFF)], ids[~of_a & (ids != 0xFFFFFFFF)]
        a_ends, b_ends = np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b])
        window_ends = a_ends[np.cumsum(n_a) - 1]
        # Between two neighbouring ends of either tokenizer lies exactly one overlapping pair.
        ends = np.union1d(a_ends, b_ends)
        pairs, like = np.unique((a[np.searchsorted(a_ends, ends)] << 32) + b[np.searchsorted(b_ends, ends)], return_inverse=True)
        numbers = [self.pair_number.setdefault(pair, len(self.pair_number)) for pair in pairs.tolist()]
        self.links.add(np.array(numbers, np.int64)[like], np.bincount(np.searchsorted(window_ends, ends)))
        a_last, b_last = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
        a_cuts, b_cuts = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        sizes = np.stack([np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)], axis=1)
        self.group_sizes.add(sizes.ravel(), 2 * np.bincount(np.searchsorted(window_ends, a_ends[a_last])))
        # All tokens as they are written: group by group, those of the first tokenizer before those of the second.
        group = np.concatenate([np.repeat(np.arange(len(sizes)), sizes[:, k]) for k in (0, 1)])
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), group))
        marks = np.concatenate([a_last * 1, b_last * 2])[order]
        written = tokens.written[marks * tokens.n_ids + np.concatenate([a, b])[order]].tolist()
        edges = [0, *np.cumsum(n_a + n_b).tolist()]
        self.texts += ["".join(written[first:last]) for first, last in zip(edges, edges[1:])]
        self.windows.update(zip(keys, range(len(self.windows), len(self.windows) + len(keys))))

    def align(self, texts: list[str]) -> Aligned:
        if len(self.words) > KEPT:
            self.forget()
        split = [self.tokens.split(text) if text else [] for text in texts]
        flat = list(chain.from_iterable(split))
        numbers = list(map(self.words.get, flat))
        if None in numbers:
            self._meet([word for word in dict.fromkeys(flat) if word not in self.words])
            numbers = list(map(self.words.get, flat))
        numbers, owner = np.array(numbers, np.int64), np.repeat(np.arange(len(texts)), list(map(len, split)))
        # One word that is not given back leaves a text without tokens.
        kept = (np.bincount(owner, ~self.sound[numbers], len(texts)) == 0)[owner]
        numbers, owner = numbers[kept], owner[kept]
        windows, n = self.windows_of.take(numbers)
        sizes = [np.bincount(owner, w, len(texts)).astype(np.int64) for w in (n, self.a.sizes(numbers), self.b.sizes(numbers))]
        return Aligned(numbers, windows, *sizes)

    def digests(self, found: Aligned) -> list[str]:
        """SHA-256 of the groups of each text, written ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        out, first, windows, texts = [], 0, found.windows.tolist(), self.texts
        for n in found.n_windows.tolist():
            joined = "".join([texts[w] for w in windows[first : first + n]])
            out.append(hashlib.sha256(joined[:-1].encode()).hexdigest() if n else "")
            first += n
        return out

    def sizes(self, found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes of all groups, as pairs of the tokens of either tokenizer, and the groups and links of each text."""
        groups, twice = self.group_sizes.take(found.windows)
        owner = np.repeat(np.arange(len(found.n_a)), found.n_windows)
        n_links = np.bincount(owner, self.links.sizes(found.windows), len(found.n_a))
        return groups.reshape(-1, 2), np.bincount(owner, twice // 2, len(found.n_a)).astype(np.int64), n_links.astype(np.int64)

    def pair_times(self, found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different linked pairs of each text: how many a text has, the pairs, and how often each is linked."""
        base, many = max(len(self.texts), 1), max(len(self.pair_number), 1)
        owner = np.repeat(np.arange(len(found.n_a)), found.n_windows)
        cells, times = np.unique(owner * base + found.windows, return_counts=True)
        numbers, sizes = self.links.take(cells % base)
        cells = np.repeat(cells // base, sizes) * many + numbers
        order = np.argsort(cells, kind="stable")
        cells, starts = cells[order], np.zeros(0, np.int64)
        if len(cells):
            starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            times = np.add.reduceat(np.repeat(times, sizes)[order], starts)
        cells = cells[starts]
        pairs = np.fromiter(self.pair_number, np.int64, len(self.pair_number))
        return np.bincount(cells // many, minlength=len(found.n_a)), pairs[cells % many], times


_ALIGNERS: dict[int, Aligner] = {}  # of this Python worker: what one task has learnt serves the next


def _aligner(byte_level: str, pieces: bytes) -> Aligner:
    key = hash((byte_level, pieces))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(Tokenizers(byte_level, pieces))
    return _ALIGNERS[key]


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about PIECE_BYTES characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > PIECE_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text or "")
    if first < len(texts):
        yield first, len(texts)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _files(docs: DataFrame, byte_level: str, pieces: str):
    """The driver reads both vocabulary files; they travel with the job."""
    with open(byte_level, encoding="utf-8") as file, open(pieces, "rb") as other:
        return docs.sparkSession.sparkContext.broadcast((file.read(), other.read()))


def _mapped(docs: DataFrame, vocabularies, text_col: str, carry: list[str], added: T.StructType, work) -> DataFrame:
    """Rows of ``docs`` with ``carry`` columns and those that ``work(aligner, texts)`` gives."""
    names = fresh(docs.select(*[F.col(f"`{c}`") for c in carry]), *added.names)
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)] + list(added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*vocabularies.value)
        for batch in batches:
            texts = batch.column(len(carry)).to_pylist()
            for first, last in _runs(texts):
                columns = [batch.column(i).slice(first, last - first) for i in range(len(carry))]
                columns += work(aligner, [text or "" for text in texts[first:last]])
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col(f"`{text_col}`").alias("text to read"))
    return rows.mapInArrow(run, T.StructType(fields)).toDF(*carry, *names)


def aligned_groups(
    docs: DataFrame, byte_level: str, pieces: str, text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """``a_ids`` and ``b_ids`` of every text and its ``groups``: how many tokens of either (``n_a``, ``n_b``) lie between
    two ends that both share, in order. Byte-level file first, piece model second."""

    def work(aligner: Aligner, texts: list[str]) -> list[pa.Array]:
        found = aligner.align(texts)
        (a, _), (b, _) = aligner.a.take(found.words), aligner.b.take(found.words)
        groups, n_groups, _ = aligner.sizes(found)
        pairs = [pa.array(groups[:, k].astype(np.int32)) for k in (0, 1)]
        rows = pa.StructArray.from_arrays(pairs, ["n_a", "n_b"])
        ids = [_lists(n, pa.array(v.astype(np.int32))) for n, v in ((found.n_a, a), (found.n_b, b))]
        return [*ids, _lists(n_groups, rows)]

    added = T.StructType.fromDDL("a_ids array<int>, b_ids array<int>, groups array<struct<n_a: int, n_b: int>>")
    return _mapped(docs, _files(docs, byte_level, pieces), text_col, list(docs.columns) if carry is None else carry, added, work)


def linked_pairs(
    docs: DataFrame, byte_level: str, pieces: str, text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Per text ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and its different linked ``pairs``
    ((id of the first << 32) + id of the second) with how many ``times`` each is linked."""

    def work(aligner: Aligner, texts: list[str]) -> list[pa.Array]:
        found = aligner.align(texts)
        _, n_groups, n_links = aligner.sizes(found)
        n, pairs, times = aligner.pair_times(found)
        counts = [pa.array(v, pa.int64()) for v in (found.n_a, found.n_b, n_groups, n_links)]
        return [*counts, pa.array(aligner.digests(found)), _lists(n, pa.array(pairs)), _lists(n, pa.array(times, pa.int64()))]

    added = T.StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    )
    return _mapped(docs, _files(docs, byte_level, pieces), text_col, list(docs.columns) if carry is None else carry, added, work)


def pair_counts(linked: DataFrame, pairs_col: str = "pairs") -> DataFrame:
    """``pair``, ``docs`` (how many documents hold it linked) and ``best`` (1 if no pair of its first id is in more).

    The bests are one row per token of the first vocabulary, so they are broadcast.
    """
    counts = stored(linked.select(F.explode(f"`{pairs_col}`").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    a_id = F.shiftright("pair", 32)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("most"))
    rated = counts.join(F.broadcast(most), a_id == F.col("a_id"))
    return rated.select("pair", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best"))


def alignment_scores(
    docs: DataFrame, byte_level: str, pieces: str, text_col: str = "text", carry: list[str] | None = None, **bounds: int
) -> DataFrame:
    """Sizes and digest of every text's alignment, ``n_best`` (links to the first id's most common partner, ties
    included) and ``count_sum`` (over links, the documents that hold the pair linked).

    Texts are encoded once; their pairs are stored and joined with the corpus's counts, by broadcast if the counts are
    measured to be within ``bounds``, else by a shuffle that cuts hot pairs into slices.
    """
    carry = list(docs.columns) if carry is None else carry
    (row,) = fresh(docs, "row number")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = stored(linked_pairs(numbered, byte_level, pieces, text_col, [*carry, row]), "linked")
    *_, n_a, n_b, n_groups, n_links, digest, pairs, times = found.columns
    counts = stored(pair_counts(found, pairs), "pair-counts")
    links = found.select(F.col(f"`{row}`").alias("row"), F.inline(F.arrays_zip(F.col(pairs).alias("pair"), F.col(times).alias("times"))))
    met = lookup(links, counts, ["pair"], "inner", spread_by=["row"], **(PAIR_BOUNDS | bounds))
    sums = met.groupBy(F.col("row").alias(row)).agg(
        F.sum(F.col("times") * F.col("best")).alias("sum of best"), F.sum(F.col("times") * F.col("docs")).alias("sum of counts")
    )
    n_best, count_sum = fresh(found, "n_best", "count_sum")
    whole = found.drop(pairs, times).join(sums, row, "left")
    sizes = [F.col(c) for c in (n_a, n_b, n_groups, n_links)]
    return whole.select(
        *(F.col(f"`{c}`") for c in carry), *sizes, F.coalesce("sum of best", F.lit(0)).alias(n_best),
        F.coalesce("sum of counts", F.lit(0)).alias(count_sum), digest,
    )
