"""Classification of price-feed descriptions, as native column expressions.

Two profiles exist. ``daily`` feeds the scheduled refresh; ``adhoc`` is the on-demand fetch, which knows fewer
machine families, has no network category and no tags, and takes the word "standard" alone for a disk.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from costloom import constants as K
from costloom.functions import cases

PROFILES = ("daily", "adhoc")

# White space as the feed's rules understand it: the ASCII blanks and the Unicode ones.
BLANK = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(or_, [text.contains(word) for word in words])


def found(text: Column, needle: str, pattern: str, group: int) -> Column:
    """The first match of a pattern; empty or null when there is none. ``needle`` is a plain part of any match,
    so that most rows skip the regular expression."""
    return F.when(text.contains(needle), F.regexp_extract(text, pattern, group))


def or_null(match: Column) -> Column:
    return F.nullif(match, F.lit(""))


def whole_number(text: Column) -> Column:
    """The integer at the start of a text; missing or empty is 0, text without a number is null."""
    plain = F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(text.try_cast("bigint"))
    return F.coalesce(plain, F.regexp_extract(text, rf"^{BLANK}*([+-]?[0-9]+)", 1).try_cast("bigint"))


def unit_price(price: Column) -> Column:
    """Price of one unit: nanos first, then whole units, so that the sum rounds the same way everywhere."""
    return whole_number(price["nanos"]) / F.lit(1e9) + whole_number(price["units"])


def currency(price: Column) -> Column:
    return F.coalesce(F.nullif(price["currencyCode"], F.lit("")), F.lit("USD"))


def tiered_rates(rates: Column) -> Column:
    """All tiers when there is more than one, else null."""
    tiers = F.transform(
        rates,
        lambda rate: F.struct(
            whole_number(rate["startUsageAmount"]).alias("start_usage_amount"),
            unit_price(rate["unitPrice"]).alias("price_per_unit"),
            currency(rate["unitPrice"]).alias("currency_code"),
        ),
    )
    return F.when(F.size(rates) > 1, tiers)


def is_relevant(description: Column) -> Column:
    # One search per word list: the lower-casing is the dear part, and a filter repeats it for every test.
    text = F.lower(description)
    return text.rlike("|".join(K.RELEVANT_WORDS)) & ~text.rlike("|".join(K.EXCLUDED_WORDS))


def is_fetched_adhoc(description: Column) -> Column:
    return F.lower(description).rlike("|".join(K.ADHOC_WORDS))


def machine_family(text: Column, profile: str) -> Column:
    return found(text, "-", rf"({_families(profile)})-", 1)


def machine_type(text: Column, profile: str) -> Column:
    return found(text, "-", rf"({_families(profile)})-[a-z0-9-]+", 0)


def vcpu_count(text: Column) -> Column:
    return found(text, "vcpu", rf"([0-9]+){BLANK}*vcpu", 1).try_cast("bigint")


def memory_gb(text: Column) -> Column:
    return found(text, "gb", rf"([0-9]+(?:\.[0-9]+)?){BLANK}*gb", 1).try_cast("double")


def disk_type(text: Column, profile: str) -> Column:
    standard = text.contains("standard")
    if profile == "daily":
        return (
            F.when(text.contains("ssd"), "pd-ssd")
            .when(text.contains("balanced"), "pd-balanced")
            .when(standard & has_any(text, ["disk", "storage"]), "pd-standard")
        )
    return (
        F.when(text.contains("ssd"), "pd-ssd")
        .when(standard, "pd-standard")
        .when(text.contains("balanced"), "pd-balanced")
    )


def is_gpu(text: Column) -> Column:
    return has_any(text, ["gpu", "nvidia", "tesla"])


def gpu_type(text: Column) -> Column:
    """Vendor word and the word after it, or "-". "nvidia tesla v100" therefore gives ``nvidia-tesla``."""
    pattern = rf"(nvidia|tesla)(?:-|{BLANK})([a-z0-9]+)"
    vendor, model = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(text.contains("nvidia") | text.contains("tesla"), F.concat_ws("-", vendor, model))


def commitment_term(text: Column) -> Column:
    return cases((has_any(text, spellings), name) for name, spellings, _ in K.COMMITMENT_TERMS)


def commitment_discount(term: Column) -> Column:
    return cases(((term == name, percent) for name, _, percent in K.COMMITMENT_TERMS), 0.0)


def is_preemptible(text: Column) -> Column:
    return has_any(text, ["preemptible", "spot"])


def usage_type(text: Column, term: Column) -> Column:
    return (
        F.when(term.isNotNull(), "Committed")
        .when(is_preemptible(text), "Preemptible")
        .otherwise("OnDemand")
    )


def network_tier(text: Column) -> Column:
    return F.when(text.contains("premium"), "premium").when(
        text.contains("standard") & has_any(text, ["network", "egress", "ip"]), "standard"
    )


def category(text: Column, disk: Column, tier: Column | None) -> Column:
    """The last rule that applies wins: network over GPU over storage over compute."""
    rules = [] if tier is None else [(tier.isNotNull(), "network")]
    return cases([*rules, (is_gpu(text), "gpu"), (disk.isNotNull(), "storage")], "compute")


def tags(text: Column, family: Column, disk: Column, gpu: Column, term: Column, tier: Column) -> Column:
    parts = [
        F.concat(F.lit("family:"), family),
        F.concat(F.lit("storage:"), F.replace(disk, F.lit("pd-"), F.lit(""))),
        F.concat(F.lit("gpu:"), gpu),
        F.when(is_preemptible(text), "usage:preemptible"),
        F.concat(F.lit("commitment:"), term),
        F.concat(F.lit("network:"), tier),
        F.when(text.contains("regional"), "scope:regional").when(text.contains("global"), "scope:global"),
    ]
    return F.array_remove(F.array(*[F.coalesce(part, F.lit("")) for part in parts]), "")


def _families(profile: str) -> str:
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}, not {profile!r}")
    return "|".join(K.DAILY_FAMILIES if profile == "daily" else K.ADHOC_FAMILIES)
