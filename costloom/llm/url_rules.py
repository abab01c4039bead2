"""URL filters: rules are indexed by their rarest literal token, and a URL tests only the rules its tokens fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEFAULT_VERDICT = "allow"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules written as (verdict, host and path), such as ``("block", "example.org/ads/")``."""
    rows = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules))
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def _tokens(host: Column, path: Column) -> Column:
    """Labels of the host and those path segments that a slash closes; every URL and rule also has the empty token."""
    parts = F.split(path, "/")
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host "), x))
    segments = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.lit("path "), x))
    return F.array_distinct(F.concat(labels, segments))


def _literal(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: ~x.isin("host ", "path ") & ~F.contains(x, F.lit("*")))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([^A-Za-z0-9*])", r"\\$1"), r"\*", ".*")


def url_verdicts(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, the ``rule`` that decided (or null) and its ``verdict``.

    A rule is a host and a path prefix; ``*`` in the path stands for any characters. It fits its host and all
    subdomains if the path starts with the prefix. The longest fitting rule wins; of equally long ones a blocking one,
    then the later in the alphabet. Without a fitting rule the verdict is ``default``.

    Rules without a literal token are fetched by every URL. Distinct (host, path) pairs are judged once, then joined to
    the rows. Null or malformed URLs have an empty host and path. Null rules or verdicts are ignored; without rules
    every row gets the default. Rows and repeated rows are all returned. Input columns named like an added column keep
    their name; the added one is prefixed with "_".
    """
    names = []
    for name in ("host", "path", "rule", "verdict"):
        while name.lower() in {c.lower() for c in [*pages.columns, *names]}:
            name = f"_{name}"
        names.append(name)
    plain = [f"c{i}" for i in range(len(pages.columns))]
    host, path = host_and_path(F.col(plain[pages.columns.index(url_col)]))
    rows = pages.toDF(*plain).withColumns({"host": host, "path": path})

    known = rules.where("rule is not null and verdict is not null").select("rule", "verdict").distinct()
    cut = F.instr("rule", "/")
    known = known.select(
        "rule", "verdict",
        lower_ascii(F.when(cut > 0, F.substring("rule", F.lit(1), cut - 1)).otherwise(F.col("rule"))).alias("rule_host"),
        F.when(cut > 0, F.substring("rule", cut, F.length("rule"))).otherwise(F.lit("")).alias("rule_path"),
    )
    domain = F.when(F.col("rule_host") == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), _quoted(F.col("rule_host"))))
    known = known.withColumn("pattern", F.concat(F.lit("(?s)^"), domain, _quoted(F.col("rule_path"))))
    literal = _literal(_tokens(F.col("rule_host"), F.col("rule_path")))
    offered = known.withColumn("token", F.explode(F.when(F.size(literal) > 0, literal).otherwise(F.array(F.lit("")))))

    pairs = rows.select("host", "path").distinct()
    tokens = pairs.withColumn("token", F.explode(F.array_append(_tokens(F.col("host"), F.col("path")), F.lit(""))))
    counts = tokens.join(offered.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    index = (
        offered.join(counts, "token", "left")
        .groupBy("rule", "verdict", "pattern")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("rarest"))
        .select("rule", "verdict", "pattern", F.col("rarest.token").alias("token"))
    )
    fetched = tokens.join(index, "token").where("concat(host, path) rlike pattern")
    order = F.struct(F.length("rule").alias("size"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    best = fetched.groupBy("host", "path").agg(F.max(order).alias("best"))
    judged = rows.join(best, ["host", "path"], "left")
    added = [F.col("host"), F.col("path"), F.col("best.rule"), F.coalesce("best.verdict", F.lit(default))]
    return judged.select(
        *(F.col(p).alias(c) for p, c in zip(plain, pages.columns)), *(c.alias(n) for c, n in zip(added, names))
    )
