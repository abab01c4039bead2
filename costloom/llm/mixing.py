"""Mixing: document rates whose expected token totals per domain match target weights, with soft membership."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from costloom.llm.storage import fresh, stored

DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.9, "poor": 0.08, "toxic": 0.02}
TRAIN_ROWS = 4000  # labelled documents that the classifier is fitted on, per domain
BUCKETS = 4096  # of hashed words
EVIDENCE = 200.0  # words at most that a text speaks for, so that long texts keep soft memberships
STEPS = 25
TOLERANCE = 1e-6  # of a domain's share of all tokens
_GRAIN = 1 << 20


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality == 1, "clean")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def word_weights(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> dict[str, tuple[float, list[float]]]:
    """Per domain: log of its prior and of each bucket's share of its words, with add-one smoothing.

    The fit takes about ``TRAIN_ROWS`` labelled documents per domain, chosen by a hash of the id; the priors are over
    all labelled documents, repeated labels once. What reaches the driver is one row per domain and bucket.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    marks = marks.where("id is not null and domain is not null").distinct()
    totals = {d: n for d, n in marks.groupBy("domain").count().collect()}
    if not totals:
        return {}
    limit = F.lit(0)
    for domain, n in totals.items():
        limit = F.when(F.col("domain") == domain, math.ceil(_GRAIN * TRAIN_ROWS / n)).otherwise(limit)
    chosen = marks.where(F.pmod(F.xxhash64("id"), F.lit(_GRAIN)) < limit)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    words = texts.join(F.broadcast(chosen), "id").select("domain", F.explode(_words(F.col("text"))).alias("word"))
    rows = words.groupBy("domain", _bucket(F.col("word")).alias("bucket")).count().collect()
    found = {}
    for domain in (d for d in DOMAINS if d in totals):
        counts = [1.0] * BUCKETS
        for row in rows:
            if row["domain"] == domain:
                counts[row["bucket"]] += row["count"]
        total = sum(counts)
        found[domain] = (math.log(totals[domain] / sum(totals.values())), [math.log(c / total) for c in counts])
    return found


def _posteriors(weights: dict[str, tuple[float, list[float]]], words: Column, n_words: Column) -> dict[str, Column]:
    """Domain probabilities: mean log odds of the words against the first domain, times the evidence of the text."""
    base, *others = weights
    share = EVIDENCE / (EVIDENCE + n_words)
    odds = {base: F.lit(0.0)}
    for domain in others:
        table = F.array(*(F.lit(a - b) for a, b in zip(weights[domain][1], weights[base][1])))
        total = F.aggregate(words, F.lit(0.0), lambda total, word: total + F.get(table, _bucket(word)))
        odds[domain] = F.greatest(F.lit(-300.0), F.least(F.lit(300.0), total * share + (weights[domain][0] - weights[base][0])))
    return odds


def with_memberships(docs: DataFrame, weights: dict, text_col: str, names: list[str]) -> DataFrame:
    """``docs`` with the number of words and a probability per domain, under ``names``. Narrow."""
    tokens, *shares = names
    split = docs.withColumn("words of text", _words(F.col(f"`{text_col}`")))
    counted = split.withColumn(tokens, F.size("words of text").cast("long"))
    odds = _posteriors(weights, F.col("words of text"), F.col(tokens)) if weights else {}
    kept = {name: f"odds of {domain}" for name, domain in zip(shares, DOMAINS) if domain in odds}
    measured = counted.withColumns({column: odds[column.removeprefix("odds of ")] for column in kept.values()}).drop("words of text")
    total = sum((F.exp(F.col(c)) for c in kept.values()), F.lit(0.0))
    given = {n: F.exp(F.col(kept[n])) / total if n in kept else F.lit(0.0) for n in shares}
    return measured.withColumns(given).drop(*kept.values())


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small symmetric system, with a trace of ridge against domains that always come together."""
    n = len(right)
    ridge = 1e-12 * sum(matrix[i][i] for i in range(n))
    rows = [[matrix[i][j] + (ridge if i == j else 0.0) for j in range(n)] + [right[i]] for i in range(n)]
    for i in range(n):
        pivot = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for k in range(n):
            if k != i and rows[i][i]:
                factor = rows[k][i] / rows[i][i]
                rows[k] = [x - factor * y for x, y in zip(rows[k], rows[i])]
    return [rows[i][n] / rows[i][i] if rows[i][i] else 0.0 for i in range(n)]


def fit_rates(members: DataFrame, tokens: str, shares: dict[str, str], targets: dict[str, float]) -> Column:
    """Rate of each row, as an expression of its memberships, by projected gradient descent from 1.

    Minimises, over rates r >= 0, the squares of the gaps between the expected share of tokens of each domain and its
    target. A gradient step is scaled by the inverse of the memberships' Gram matrix, so rare or overlapping domains
    converge as fast as others; without the bound r >= 0 one step would do. The matrix is that of the rows whose rate
    is not at the bound, as only these can move; a step that did not help is followed by one with the matrix of all
    rows, which is always safe. Each step is one aggregation of a few sums; its result enters the next as constants, so
    rates need no table of their own.
    """
    names = list(shares.values())
    pairs = [(a, b) for a in names for b in names]
    sums = members.agg(F.sum(tokens), *(F.sum(F.col(tokens) * F.col(a) * F.col(b)) for a, b in pairs)).first()
    total = sums[0]
    if not total:
        return F.lit(1.0)
    gram = {p: value / total for p, value in zip(pairs, sums[1:])}
    present = [d for d in shares if gram[shares[d], shares[d]]]
    goal = sum(targets.get(d, 0.0) for d in present)
    if not goal:
        return F.lit(1.0)
    whole = [[gram[shares[a], shares[b]] for b in present] for a in present]
    rate, least = F.lit(1.0), math.inf
    for _ in range(STEPS):
        free = F.col(tokens) * (F.col("rate") > 0).cast("int")
        reached = members.select(tokens, rate.alias("rate"), *(shares[d] for d in present)).agg(
            *(F.sum(F.col(tokens) * F.col("rate") * F.col(shares[d])) for d in present),
            *(F.sum(free * F.col(shares[a]) * F.col(shares[b])) for a in present for b in present),
        ).first()
        k = len(present)
        gaps = [value / total - targets.get(d, 0.0) / goal for d, value in zip(present, reached)]
        worst = max(map(abs, gaps))
        if worst < TOLERANCE:
            break
        matrix = [[value / total for value in reached[k + i * k : 2 * k + i * k]] for i in range(k)]
        moves = _solved(matrix if worst < least else whole, gaps)
        least = min(least, worst)
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(shares[d]) * move for d, move in zip(present, moves)), F.lit(0.0)))
    return rate


def mixed(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """``carry`` columns (default: all) of every row, ``n_tokens`` (words), ``p_clean``, ``p_poor``, ``p_toxic``,
    ``rate`` and ``copies``.

    ``rate`` is the expected number of times a document is taken; expected tokens of each domain, relative to the
    corpus, meet ``targets``. ``copies`` realises it: its whole part, and one more with the probability of the rest,
    drawn from a hash of id and text. Domains without labels get no probability, and the targets of the others are
    scaled to 1; without any labels all rates are 1.

    Null and empty texts have no tokens and the prior's memberships. Null ids are treated like others. Repeated rows
    are returned as often as they come. Labels that give no domain are ignored, repeated ones count once.
    Input columns named like an added column keep their name; the added one is prefixed with "_".
    """
    carry = list(docs.columns) if carry is None else carry
    names = fresh(docs.select(*[F.col(f"`{c}`") for c in carry]), "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies")
    weights = word_weights(docs, labels, id_col, text_col)
    inner = [f"carried{i}" for i in range(len(carry))]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, inner)), F.col(f"`{text_col}`").alias("text to weigh"),
        F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).alias("draw"),
    )
    added = ["tokens", *(f"share of {d}" for d in DOMAINS)]
    members = stored(with_memberships(rows, weights, "text to weigh", added).drop("text to weigh"), "members")
    rate = fit_rates(members, "tokens", dict(zip(DOMAINS, added[1:])), targets or TARGETS) if weights else F.lit(1.0)
    draw = F.pmod("draw", F.lit(_GRAIN)) / _GRAIN
    result = members.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + draw).cast("long"))
    return result.select(
        *(F.col(n).alias(c) for n, c in zip(inner, carry)), *(F.col(f"`{c}`").alias(n) for c, n in zip([*added, "rate", "copies"], names))
    )
