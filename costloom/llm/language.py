"""Language identification with interpolated Kneser-Ney character models, in sorted hash arrays or stored tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from costloom.llm.storage import fresh, stored
from costloom.llm.words import mix
from costloom.session import scratch_path

ORDER = 4  # characters
BROADCAST_GRAMS = 1_000_000  # counted n-grams of a model sent to every executor at most; more stay in tables
BROADCAST_CELLS = 8_000_000  # different n-grams times languages of such a model
FOLDS = 10  # parts of the texts; each is measured by models of the others, which sets temperature and limits for rejection
HEATS = np.exp(np.linspace(np.log(0.01), np.log(3.0), 60))
LENGTH = 100.0  # characters at most that a text speaks for in its score
WANTED = 0.99  # share of right answers among those accepted
UNKNOWN = "und"
CHUNK = 1 << 20  # characters worked on at once

_PRIVATE, _PRIVATE_SIZE = 0xE000, 6400
_ALPHABET = 0x33480  # no letters beyond
_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(_ALPHABET)), bool, _ALPHABET)
    return _LETTER


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed n-grams of all texts, the row of each, and the letters in each row.

    Letters are lower-cased; every run of other characters is one space, and texts begin and end with one; a single
    letter has two spaces before it, so that every letter is in an n-gram. Letters beyond U+FFFF are spread over the
    code points of private use, none of which is a letter, so four pack into 64 bits.
    """
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters()[np.minimum(codes, _ALPHABET - 1)] & (codes < _ALPHABET)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0:1] = True
    keep[1:] |= rows[1:] != rows[:-1]
    spread = np.where(codes > 0xFFFF, _PRIVATE + codes % _PRIVATE_SIZE, codes)
    symbols = np.where(letter, spread, 32)[keep].astype(np.uint64)
    rows, n_letters = rows[keep], np.bincount(rows[letter], minlength=len(texts))
    sizes = np.bincount(rows, minlength=len(texts))
    missing = np.where(n_letters > 0, np.maximum(ORDER - sizes, 0), 0)
    at = np.repeat(np.cumsum(sizes) - sizes, missing)
    symbols, rows = np.insert(symbols, at, 32), np.insert(rows, at, np.repeat(np.arange(len(texts)), missing))
    size = len(symbols) - ORDER + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    packed = np.zeros(size, np.uint64)
    for j in range(ORDER):
        packed |= symbols[j : size + j] << np.uint64(16 * (ORDER - 1 - j))
    inside = rows[: len(rows) - ORDER + 1] == rows[ORDER - 1 :]
    return packed[inside], rows[:size][inside], n_letters


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``fold``, ``gram``, ``n`` of rows (``text``, ``lang``, ``fold``): counted inside tasks first, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, folds = (batch.column(i).to_pylist() for i in range(3))
            groups = {}
            for text, lang, fold in zip(texts, langs, folds):
                groups.setdefault((lang, fold), []).append(text)
            for (lang, fold), mine in sorted(groups.items()):
                parts = [np.unique(grams_of(mine[a:b])[0], return_counts=True) for a, b in _groups(mine)]
                grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array([fold] * len(grams), pa.int32()), pa.array(grams.view(np.int64)), pa.array(n)],
                    ["lang", "fold", "gram", "n"],
                )

    counted = rows.select("text", "lang", "fold").mapInArrow(run, "lang string, fold int, gram long, n long")
    return counted.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


class Hashed:
    """Rows of values under 64-bit keys: a sorted array of hashes, and where each of their leading bits begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        hashed = mix(keys)
        order = np.argsort(hashed)
        self.hashes, self.values = hashed[order], values[order]
        self.bits = max(1, int(len(keys)).bit_length())
        heads = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.heads = np.searchsorted(self.hashes, heads)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.hashes):
            return found
        wanted = mix(keys)
        at = self.heads[wanted >> np.uint64(64 - self.bits)]
        left = np.arange(len(keys))
        while len(left):
            inside = at < len(self.hashes)
            left, at, wanted = left[inside], at[inside], wanted[inside]
            here = self.hashes[at]
            hit = here == wanted
            found[left[hit]] = at[hit]
            more = here < wanted
            left, at, wanted = left[more], at[more] + 1, wanted[more]
        return found


def _lower(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` characters."""
    return keys & np.uint64((1 << (16 * order)) - 1)


@dataclass
class Model:
    langs: list[str]
    seen: list[Hashed]  # by order from 1: log probability of each n-gram that some language has
    left: list[Hashed]  # by order from 1: log of the weight that each context leaves to the lower order
    floor: float  # log probability of an unseen character
    heat: float = 1.0
    least_score: float = 0.0
    most_entropy: list[float] | None = None

    def log_probability(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of the last character of each n-gram after the others, a column per language."""
        if order == 0:
            return np.full((len(grams), len(self.langs)), self.floor)
        table = self.seen[order - 1]
        at = table.find(grams)
        out = np.empty((len(grams), len(self.langs)))
        hit = at >= 0
        out[hit] = table.values[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            below = self.log_probability(_lower(grams[miss], order - 1), order - 1)
            context = self.left[order - 1]
            known = context.find(grams[miss] >> np.uint64(16))
            below[known >= 0] += context.values[known[known >= 0]]
            out[miss] = below
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character of every text under every language, its n-grams and its letters."""
        total, sizes, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for a, b in _groups(texts):
            grams, rows, letters[a:b] = grams_of(texts[a:b])
            found = self.log_probability(grams)
            sizes[a:b] = np.bincount(rows, minlength=b - a)
            for k in range(len(self.langs)):
                total[a:b, k] = np.bincount(rows, weights=found[:, k], minlength=b - a)
        return -total / np.maximum(sizes, 1)[:, None], sizes, letters

    def scores(self, entropies: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Share of the best language: softmax of the entropies times heat and length."""
        evidence = self.heat * (sizes / (1 + sizes / LENGTH))[:, None] * (entropies - entropies.min(axis=1, keepdims=True))
        return 1 / np.exp(-evidence).sum(axis=1)


def fit(counts: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney models of all languages of a table of ``lang``, ``gram`` and ``n``."""
    langs = sorted(counts["lang"].unique())
    tables, contexts = [{} for _ in range(ORDER)], [{} for _ in range(ORDER)]
    for lang in langs:
        own = counts[counts["lang"] == lang]
        keys, n = own["gram"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        for size in range(ORDER, 0, -1):
            once, twice = int((n == 1).sum()), int((n == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            before = keys >> np.uint64(16)
            names, at, kinds = np.unique(before, return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=n)
            tables[size - 1][lang] = (keys, np.maximum(n - discount, 0) / total[at])
            contexts[size - 1][lang] = (names, discount * kinds / total)
            keys, n = np.unique(_lower(keys, size - 1), return_counts=True)  # how many characters come before
    symbols = np.unique(np.concatenate([tables[0][lang][0] for lang in langs]))
    floor = -np.log(len(symbols) + 1.0)

    def looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, other: float) -> np.ndarray:
        names, values = table
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        return np.where(names[at] == keys, values[at], other)

    seen, left = [], []
    for size in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([tables[size - 1][lang][0] for lang in langs]))
        values = np.empty((len(keys), len(langs)))
        for k, lang in enumerate(langs):
            probability = np.full(len(keys), np.exp(floor))
            for lower in range(1, size + 1):
                part = _lower(keys, lower)
                rest = looked_up(contexts[lower - 1][lang], part >> np.uint64(16), 1.0)
                probability = looked_up(tables[lower - 1][lang], part, 0.0) + rest * probability
            values[:, k] = np.log(probability)
        seen.append(Hashed(keys, values))
        names = np.unique(np.concatenate([contexts[size - 1][lang][0] for lang in langs]))
        rest = np.stack([np.log(looked_up(contexts[size - 1][lang], names, 1.0)) for lang in langs], axis=1)
        left.append(Hashed(names, rest))
    return Model(langs, seen, left, floor)


@dataclass
class StoredModel:
    """The same models in stored tables: by order from 1, rows of ``f`` (model), ``key``, ``k`` (language) and ``value``."""

    langs: list[str]
    terms: list[DataFrame]  # what an n-gram's own count adds to its probability
    left: list[DataFrame]  # the weight that a context leaves to the lower order; 1 without a row
    floors: dict[int, float]  # by model
    heat: float = 1.0
    least_score: float = 0.0
    most_entropy: list[float] | None = None
    scores = Model.scores

    @property
    def floor(self) -> float:
        return self.floors[0]

    def entropies(self, rows: DataFrame) -> DataFrame:
        """``row``, ``entropies``, ``size`` and ``letters`` of rows (``row``, ``f``, ``text``) with an n-gram."""
        counted = stored(rows.where("text is not null").mapInArrow(_row_grams, "row long, f int, gram long, n long, size long, letters long"), "row-grams")
        logs = self._logs(counted.select("f", F.col("gram").alias("key")).distinct())
        each = counted.join(logs.withColumnRenamed("key", "gram"), ["f", "gram"])
        each = each.select("row", "size", "letters", "n", F.posexplode("logs").alias("k", "log"))
        sums = each.groupBy("row", "k").agg(F.sum(-F.col("n") * F.col("log") / F.col("size")).alias("x"), F.first("size").alias("size"), F.first("letters").alias("letters"))
        found = sums.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("xs"), F.first("size").alias("size"), F.first("letters").alias("letters"))
        return found.select("row", F.col("xs.x").alias("entropies"), "size", "letters")

    def _logs(self, wanted: DataFrame) -> DataFrame:
        """``f``, ``key`` and ``logs``: log probability of each wanted n-gram by language, orders from 1 up."""
        floors = F.create_map(*(F.lit(x) for f, floor in self.floors.items() for x in (f, float(np.exp(floor)))))
        keys = [stored(wanted, "wanted")]
        for size in range(ORDER - 1, 0, -1):
            keys.append(stored(keys[-1].select("f", _lower_key("key", size).alias("key")).distinct(), "wanted"))
        below = None
        for size in range(1, ORDER + 1):
            terms, left = (t[size - 1].groupBy("f", "key").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m")) for t in (self.terms, self.left))
            rows = keys[ORDER - size].withColumn("context", F.shiftrightunsigned("key", 16))
            rows = rows.join(terms.withColumnRenamed("m", "term"), ["f", "key"], "left")
            rows = rows.join(left.withColumnsRenamed({"key": "context", "m": "rest"}), ["f", "context"], "left")
            if below is None:
                rows = rows.withColumn("below", F.array_repeat(floors[F.col("f")], len(self.langs)))
            else:
                rows = rows.withColumn("lower", _lower_key("key", size - 1)).join(below.withColumnsRenamed({"key": "lower", "p": "below"}), ["f", "lower"])
            own, rest = "coalesce(term[i], 0d)", "coalesce(rest[i], 1d)"
            below = stored(rows.select("f", "key", F.expr(f"transform(below, (x, i) -> {own} + {rest} * x)").alias("p")), "probabilities")
        return below.select("f", "key", F.expr("transform(p, x -> ln(x))").alias("logs"))


def _lower_key(name: str, order: int) -> Column:
    return F.col(name).bitwiseAND(F.lit((1 << (16 * order)) - 1).cast("long"))


def _row_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, f, text) to the different n-grams of each, their number, that of all, and the letters."""
    for batch in batches:
        names, models = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        texts = batch.column(2).to_pylist()
        for a, b in _groups(texts):
            grams, rows, letters = grams_of(texts[a:b])
            order = np.lexsort((grams, rows))
            grams, rows = grams[order], rows[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(rows) > 0) | (grams[1:] != grams[:-1])])[: len(rows)])
            n, sizes, rows = np.diff(np.append(first, len(grams))), np.bincount(rows, minlength=b - a), rows[first]
            columns = [names[a:b][rows], models[a:b][rows], grams[first].view(np.int64), n, sizes[rows], letters[rows]]
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["row", "f", "gram", "n", "size", "letters"])


def fit_stored(counts: DataFrame, langs: list[str]) -> StoredModel:
    """:func:`fit` as aggregations over a stored table of ``f`` (model), ``lang``, ``gram`` and ``n``, of any size."""
    spark = counts.sparkSession
    names = F.broadcast(spark.createDataFrame(list(enumerate(langs)), "k int, lang string"))
    table = stored(counts.join(names, "lang").select("f", "k", F.col("gram").alias("key"), "n"), "order")
    terms, left = [], []
    for size in range(ORDER, 0, -1):
        number = lambda n: F.sum((F.col("n") == n).cast("long"))
        few = table.groupBy("f", "k").agg(number(1).alias("once"), number(2).alias("twice"))
        discount = F.expr("if(once > 0 and twice > 0, once / (once + 2 * twice), 0.5d)").alias("discount")
        discounts = F.broadcast(stored(few.select("f", "k", discount), "discounts"))  # a row for each model and language
        rows = table.withColumn("context", F.shiftrightunsigned("key", 16))
        contexts = rows.groupBy("f", "k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        contexts = stored(contexts.join(discounts, ["f", "k"]), "contexts")
        own = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
        terms.insert(0, stored(rows.join(contexts, ["f", "k", "context"]).select("f", "key", "k", own.alias("value")), "terms"))
        left.insert(0, contexts.select("f", F.col("context").alias("key"), "k", (F.col("discount") * F.col("kinds") / F.col("total")).alias("value")))
        if size > 1:  # how many characters come before
            table = stored(table.groupBy("f", "k", _lower_key("key", size - 1).alias("key")).agg(F.count("*").alias("n")), "order")
    symbols = table.groupBy("f").agg(F.count_distinct("key")).collect()  # a row for each model
    return StoredModel(langs, terms, left, {f: float(-np.log(n + 1.0)) for f, n in symbols})


def _running(rows: DataFrame, by: list[Column], *sums: str) -> DataFrame:
    """Rows with sums of columns over all rows up to each in the order of ``by``, in which no two rows are equal.

    Each task has a range of the rows, and adds the sums of the ranges before it to its own.
    """
    ranges = stored(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranges")
    before, starts = [0] * len(sums), []
    for part, *own in sorted(ranges.groupBy("part").agg(*(F.sum(c) for c in sums)).collect()):  # a row for each task
        starts.append((part, *before))
        before = [a + b for a, b in zip(before, own)]
    starts = rows.sparkSession.createDataFrame(starts, "part int, " + ", ".join(f"start_{c} bigint" for c in sums))
    so_far = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    totals = ((F.sum(c).over(so_far) + F.col(f"start_{c}")).alias(f"{c}_so_far") for c in sums)
    return ranges.join(F.broadcast(starts), "part").select(*rows.columns, *totals)


def _medians(rows: DataFrame) -> DataFrame:
    """``lang`` and ``middle``: the median of ``x`` by language, of rows (``lang``, ``x``)."""
    counted = stored(rows.groupBy("lang", "x").agg(F.count("*").alias("n")), "values")
    first, starts = 0, []
    for lang, n in sorted(counted.groupBy("lang").agg(F.sum("n")).collect()):  # a row for each language
        starts.append((lang, first, n))
        first += n
    starts = rows.sparkSession.createDataFrame(starts, "lang string, first bigint, total bigint")
    found = _running(counted, [F.col("lang"), F.col("x")], "n").join(F.broadcast(starts), "lang")
    low, high = (F.min(F.expr(f"if(n_so_far - first > {at}, x, null)")) for at in ("(total - 1) div 2", "total div 2"))
    return stored(found.groupBy("lang").agg(((low + high) / 2).alias("middle")), "medians")


def calibrate(model: Model | StoredModel, found: DataFrame) -> None:
    """Heat by likelihood; the least score at which ``WANTED`` of the answers are right. ``found`` has a row for every
    text measured: ``gaps`` (to the lowest entropy, times length), ``truth`` (place of its language), ``right``."""

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(HEATS))
        for batch in batches:
            truths, lists = batch.column(1).to_numpy(), batch.column(0).to_pylist()
            widths = np.array([len(x) for x in lists])
            for width in np.unique(widths):  # a fold may lack a language
                own = np.flatnonzero(widths == width)
                gaps = np.array([lists[i] for i in own])
                right = gaps[np.arange(len(own)), truths[own]]
                sums += [(-heat * right - np.log(np.exp(-heat * gaps).sum(axis=1))).sum() for heat in HEATS]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(HEATS)), pa.int32()), pa.array(sums)], ["i", "x"])

    rows = found.select("gaps", "truth").mapInArrow(likelihoods, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    model.heat = float(HEATS[max(rows, key=lambda r: (r["x"], r["i"]))["i"]])
    score = F.expr(f"1 / aggregate(gaps, 0d, (a, x) -> a + exp({-model.heat!r}d * x))")
    scored = found.groupBy(score.alias("score")).agg(F.count("*").alias("n"), F.sum(F.col("right").cast("long")).alias("good"))
    enough = _running(scored, [F.desc("score")], "n", "good").where(F.col("good_so_far") / F.col("n_so_far") >= WANTED)
    least = enough.agg(F.min("score")).first()[0]
    model.least_score = 1.0 if least is None else least


def entropy_limits(found: DataFrame) -> dict[str, float]:
    """The entropy of a right answer, far above the median, beyond which a text is like none of the language's."""
    own = stored(found.where("right").select("lang", F.col("own").alias("x")), "entropies")
    middle = _medians(own)
    spread = _medians(own.join(F.broadcast(middle), "lang").select("lang", F.abs(F.col("x") - F.col("middle")).alias("x")))
    both = middle.join(spread.withColumnRenamed("middle", "spread"), "lang").collect()  # a row for each language
    return {r["lang"]: r["middle"] + 10 * max(1.4826 * r["spread"], 0.05) for r in both}


def learn(
    docs: DataFrame, text_col: str, lang_col: str, learnt: Column, broadcast_grams: int = BROADCAST_GRAMS, broadcast_cells: int = BROADCAST_CELLS
) -> Model | StoredModel | None:
    """Counts over all rows that ``learnt`` selects, every n-gram kept. Heat and limits come from all these rows too, each
    measured by a model of the same kind that has not seen it: the texts are dealt by hash into ``FOLDS`` parts, so that
    copies go together, and each part has a model of the other parts' counts. The model is sent to the executors if it
    measures small, else it stays in tables. None without rows."""
    text, lang = F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    fold = F.floor(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) * FOLDS / (1 << 20)).cast("int")
    rows = _dealt(docs.where(learnt).select(text, lang).where("text is not null and lang is not null").select("*", F.md5("text").alias("digest"), fold.alias("fold")))
    parts = stored(gram_counts(rows), "grams")
    counts = stored(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # a row for each language
    if not langs:
        return None
    if counts.count() <= broadcast_grams and counts.select("gram").distinct().count() * len(langs) <= broadcast_cells:
        whole = counts.toPandas().astype({"lang": "category"}).sort_values(["lang", "gram"], ignore_index=True)
        apart, found = _apart_in_arrays(rows, parts, whole)
        model = fit(whole)
    else:
        model = fit_stored(counts.withColumn("f", F.lit(0)), langs)
        apart, found = _apart_in_tables(rows, parts, langs)
    if found is not None and not found.isEmpty():
        calibrate(apart, found)
        limits = entropy_limits(found)
        model.heat, model.least_score = apart.heat, apart.least_score
        model.most_entropy = [limits.get(x, np.inf) for x in model.langs]
    return model


FOUND = "lang string, digest string, truth int, right boolean, own double, gaps array<double>"


def _compared(entropies: np.ndarray, sizes: np.ndarray, langs: list[str], truths: list[str], digests: list[str]) -> pa.RecordBatch:
    """Rows of ``FOUND`` for texts of a language that was learnt and with an n-gram."""
    own = [i for i, lang in enumerate(truths) if lang in langs and sizes[i] > 0]
    truth = np.array([langs.index(truths[i]) for i in own], np.int32)
    entropies, sizes = entropies[own], sizes[own]
    gaps = (entropies - entropies.min(axis=1, keepdims=True)) * (sizes / (1 + sizes / LENGTH))[:, None]
    columns = [pa.array([x[i] for i in own], pa.string()) for x in (truths, digests)]
    columns += [pa.array(truth), pa.array(entropies.argmin(axis=1) == truth), pa.array(entropies[np.arange(len(own)), truth])]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(gaps), pa.list_(pa.float64()))], ["lang", "digest", "truth", "right", "own", "gaps"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows stored in a folder for each ``fold``, their last column, so that a fold is read without the others."""
    path = scratch_path(rows.sparkSession, "texts")
    rows.write.option("compression", "zstd").partitionBy("fold").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _less(whole: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """Counts, sorted by language and n-gram, without those of a part."""
    n = whole["n"].to_numpy().copy()
    for lang, rows in own.groupby("lang"):
        at = np.flatnonzero(whole["lang"] == lang)
        n[at[np.searchsorted(whole["gram"].to_numpy()[at], rows["gram"].to_numpy())]] -= rows["n"].to_numpy()
    return whole.assign(n=n)[n > 0]


def _apart_in_arrays(rows: DataFrame, parts: DataFrame, whole: pd.DataFrame) -> tuple[Model | None, DataFrame | None]:
    """A model of all folds but one, and every text measured by the model without its fold; copies of a text once.

    One model at a time is made and sent to the executors, which drop it before the next.
    """
    one, tables, context = None, [], rows.sparkSession.sparkContext
    for fold in range(FOLDS):
        others = _less(whole, parts.where(F.col("fold") == fold).select("lang", "gram", "n").toPandas())
        if len(others):
            model = fit(others)
            one, sent = one or model, context.broadcast(model)
            mine = rows.where(F.col("fold") == fold).select("text", "lang", "digest")
            tables.append(stored(mine.mapInArrow(_measured(sent), FOUND), "measured"))
            sent.destroy()
            del others, model
    if one is None:
        return None, None
    return one, stored(reduce(DataFrame.unionByName, tables).dropDuplicates(["lang", "digest"]), "measured")


def _apart_in_tables(rows: DataFrame, parts: DataFrame, langs: list[str]) -> tuple[StoredModel, DataFrame | None]:
    """:func:`_apart_in_arrays` with the models of all folds in the same tables."""
    others = parts.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where("f <> fold")
    others = stored(others.groupBy("f", "lang", "gram").agg(F.sum("n").alias("n")), "grams")
    known = {}  # columns of the languages that each fold's model has
    for f, lang in others.select("f", "lang").distinct().collect():  # a row for each fold and language
        known.setdefault(f, []).append(langs.index(lang))
    if not known:
        return None, None
    apart = fit_stored(others, langs)
    texts = stored(rows.where(F.col("fold").isin(list(known))).withColumn("row", F.monotonically_increasing_id()), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, len(langs))
            sizes, folds = (batch.column(i).to_numpy().astype(float) for i in (1, 2))
            truths, digests = (batch.column(i).to_pylist() for i in (3, 4))
            for fold in np.unique(folds):
                at, own = np.flatnonzero(folds == fold), sorted(known[int(fold)])
                mine = ([x[i] for i in at] for x in (truths, digests))
                yield _compared(found[np.ix_(at, own)], sizes[at], [langs[k] for k in own], *mine)

    measured = apart.entropies(texts.select("row", F.col("fold").alias("f"), "text"))
    found = texts.select("row", "fold", "lang", "digest").join(measured, "row")
    found = found.select("entropies", "size", "fold", "lang", "digest").mapInArrow(run, FOUND)
    return apart, stored(found.dropDuplicates(["lang", "digest"]), "measured")


def _measured(sent: Broadcast[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts, langs, digests = (batch.column(i).to_pylist() for i in range(3))
            found, sizes, _ = model.entropies(texts)
            yield _compared(found, sizes, model.langs, langs, digests)

    return run


def identified(docs: DataFrame, model: Model | StoredModel | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all) of every row, with ``lang_pred``, ``score`` (0 to 1), ``entropy``, ``accepted``.

    The language is that of the lowest cross-entropy per character; of equal ones, the first by name. ``score`` is its
    calibrated share. ``accepted`` is false if the score is below the calibrated least score or the entropy above the
    language's limit, that is, if the text is like none of the languages learnt. Null texts and texts without a letter,
    and all texts if there was nothing to learn, get ``und``, score 0, a null entropy and are not accepted. Input
    columns named like an added column keep their name; the added one is prefixed with "_".
    """
    carry = list(docs.columns) if carry is None else carry
    names = fresh(docs.select(*[F.col(f"`{c}`") for c in carry]), "lang_pred", "score", "entropy", "accepted")
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    fields += [T.StructField(n, T.StructType.fromDDL(f"x {k}")[0].dataType) for n, k in zip(("lang_pred", "score", "entropy", "accepted"), ("string", "double", "double", "boolean"))]

    if isinstance(model, StoredModel):
        return _identified_by_tables(docs, model, text_col, carry, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            lang, score, entropy, accepted = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts), np.zeros(len(texts), bool)
            if model is not None:
                found, sizes, letters = model.entropies(texts)
                least, best = found.min(axis=1), found.argmin(axis=1)
                shares = model.scores(found, sizes)
                for i in np.flatnonzero(letters > 0):
                    lang[i], score[i], entropy[i] = model.langs[best[i]], shares[i], float(least[i])
                    limit = model.most_entropy[best[i]] if model.most_entropy else np.inf
                    accepted[i] = shares[i] >= model.least_score and least[i] <= limit
            columns = [batch.column(i) for i in range(len(carry))]
            columns += [pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, pa.float64()), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col(f"`{text_col}`").alias("text to read"))
    return rows.mapInArrow(run, T.StructType(fields)).toDF(*carry, *names)


def _identified_by_tables(docs: DataFrame, model: StoredModel, text_col: str, carry: list[str], names: list[str]) -> DataFrame:
    """:func:`identified` by joins: each row has a stored key, so null and repeated ids do no harm."""
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = stored(docs.select(*kept, F.col(f"`{text_col}`").alias("text to read"), F.monotonically_increasing_id().alias("row")), "rows")
    langs, heat, least_score, limits = model.langs, model.heat, model.least_score, model.most_entropy
    judge = Model(langs, [], [], model.floor, heat, least_score, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(langs))
            sizes, letters = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            least, best, shares = found.min(axis=1), found.argmin(axis=1), judge.scores(found, sizes)
            limit = np.array(limits)[best] if limits else np.full(len(best), np.inf)
            known = letters > 0
            columns = [pa.array([langs[i] for i in best], pa.string()), pa.array(shares), pa.array(least), pa.array((shares >= least_score) & (least <= limit))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "l", "s", "e", "a"]).filter(pa.array(known))

    answers = model.entropies(rows.select("row", F.lit(0).alias("f"), F.col("text to read").alias("text"))).mapInArrow(run, "row long, l string, s double, e double, a boolean")
    out = rows.join(answers, "row", "left").select(
        *[F.col(f"c{i}") for i in range(len(carry))], F.coalesce("l", F.lit(UNKNOWN)), F.coalesce("s", F.lit(0.0)), F.col("e"), F.coalesce("a", F.lit(False))
    )
    return out.toDF(*carry, *names)
