"""Odd price-feed records."""

import pytest

from costloom.operators import catalog as catalogs
from costloom.sources import feed as feeds
from samples import NOW, TODAY, feed_of, sku


def prices(spark, *rows, profile="daily", **options):
    built = catalogs.build_catalog(feed_of(spark, *rows), TODAY, NOW, profile, **options)
    return {row["sku_id"]: row for row in built.collect()}


def unit(units="1", nanos="0", currency=None):
    return {"currencyCode": currency, "units": units, "nanos": nanos}


def test_price_is_nanos_plus_units(spark):
    rows = prices(
        spark,
        sku("both", nanos="250000000", units="2"),
        sku("no units", nanos="5", units=None),
        sku("no nanos", nanos=None, units="3"),
        sku("empty", nanos="", units="4"),
        sku("fraction", nanos="1.9", units="0"),
        sku("trailing", nanos="0", units="7 dollars"),
        sku("wide blank", nanos="0", units="　8"),
    )
    assert {name: row["price_per_unit"] for name, row in rows.items()} == {
        "both": 2.25, "no units": 5e-9, "no nanos": 3.0, "empty": 4.0, "fraction": 1e-9, "trailing": 7.0,
        "wide blank": 8.0,
    }


def test_free_first_tier_drops_the_record_in_the_daily_profile_only(spark):
    free = sku("free", tiers=[("0", unit("0")), ("100", unit("5"))])
    assert prices(spark, free) == {}
    assert prices(spark, free, profile="adhoc")["free"]["price_per_unit"] == 0.0


def test_bad_records_drop_alone(spark):
    no_info = ("no info", "n1-x instance", [], None)
    empty_info = ("empty info", "n1-x instance", [], [])
    no_tiers = ("no tiers", "n1-x instance", [], [(("h", None),)])
    empty_tiers = ("empty tiers", "n1-x instance", [], [(("h", []),)])
    no_text = sku("no text", None)
    unreadable = sku("unreadable", nanos="x")
    no_price = sku("no price", tiers=[("0", None)])
    no_regions = sku("no regions", regions=None)
    good = sku("good")
    rows = (no_info, empty_info, no_tiers, empty_tiers, no_text, unreadable, no_price, no_regions, good)
    for profile in ("daily", "adhoc"):
        kept = prices(spark, *rows, profile=profile)
        assert set(kept) == {"good", "no regions"}, profile
        assert kept["no regions"]["region"] is None


def test_a_broken_later_tier_drops_the_daily_record(spark):
    row = sku("late", tiers=[("0", unit("1")), ("5", None)])
    assert prices(spark, row) == {}
    assert set(prices(spark, row, profile="adhoc")) == {"late"}


def test_tiers_only_when_there_are_several(spark):
    rows = prices(
        spark,
        sku("one"),
        sku("two", tiers=[(None, unit("1", currency="EUR")), ("100", unit("0", "500000000", ""))]),
    )
    assert rows["one"]["tiered_rates"] is None
    assert [tuple(t) for t in rows["two"]["tiered_rates"]] == [(0, 1.0, "EUR"), (100, 0.5, "USD")]
    assert rows["two"]["currency_code"] == "EUR" and rows["one"]["currency_code"] == "USD"


def test_adhoc_region_may_be_any_of_the_list(spark):
    rows = prices(
        spark, sku("in", regions=["a", "b"]), sku("out", regions=["a"]), sku("none"), profile="adhoc", region="b"
    )
    assert set(rows) == {"in"} and rows["in"]["region"] == "a"


def test_arguments(spark):
    with pytest.raises(ValueError):
        prices(spark, sku(), profile="weekly")
    with pytest.raises(ValueError):
        prices(spark, sku(), region="b")


def test_read_feed_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(
        '{"skuId":"a","description":"n1-x vm","serviceRegions":["r"],"pricingInfo":[{"pricingExpression":'
        '{"usageUnit":"h","tieredRates":[{"startUsageAmount":0,"unitPrice":{"units":"1","nanos":500000000}}]}}]}\n'
        "{not json}\n"
    )
    built = catalogs.build_catalog(feeds.read_feed(spark, str(tmp_path)), TODAY, NOW).collect()
    assert [(row["sku_id"], row["price_per_unit"], row["region"]) for row in built] == [("a", 1.5, "r")]
