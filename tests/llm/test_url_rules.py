import random
import re

from costloom.llm.url_rules import rules_table, url_verdicts


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host = re.match(r"[^/?#]*", url.split("://", 1)[1]).group()
    rest = url.split("://", 1)[1][len(host) :]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest).group()


def brute_force(url, rules):
    host, path = parts(url)
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        if (not name or host == name or host.endswith("." + name)) and re.match(
            ".*".join(map(re.escape, (slash + rest).split("*"))), path, re.S
        ):
            fits.append((len(rule), verdict == "block", rule, verdict))
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_like_brute_force(spark):
    rng = random.Random(9)
    hosts = ["a.org", "www.a.org", "xa.org", "org", "b.com", "ads.b.com", "É.com", "A.ORG", "a.org.", "1.2.3.4"]
    paths = ["", "/", "/en/1", "/en/12", "/en/x/ads/y.gif", "/es/", "/es", "/a+b(c)/", "/a+b(c)", "/ads\n/x", "//en/1"]
    urls = [f"{s}://{h}{p}{q}" for s in ("http", "", "x") for h in hosts for p in paths for q in ("", "?u=http://c.net/", "#f")]
    urls += [None, "", "no scheme", "http://", "://", "http:///en/", "http://a.org/en/1://x", "http://a.org/" + "p/" * 30000]
    urls += urls[:5]
    rng.shuffle(urls)
    rules = [
        ("allow", "org/"), ("block", "a.org/en/1"), ("block", "a.org/es/"), ("allow", "a.org/en/12"), ("block", "/en/*/ads/"), ("block", "com"),
        ("allow", "b.com/"), ("block", "b.com/a+b(c)/"), ("allow", "b.com/a+b(c)/"), ("block", "a.org/en/*.gif"), ("block", "4/"), ("allow", "zz.net/"),
    ]
    table = rules_table(spark, rules + rules[:2]).unionByName(spark.sql("select 'block' as verdict, cast(null as string) as rule"))
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = url_verdicts(pages, table)
    assert found.columns == ["page_id", "url", "host", "_host", "path", "rule", "verdict"]
    got = {r["page_id"]: tuple(r)[3:] for r in found.collect()}
    assert got == {i: brute_force(u, rules) for i, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = rules_table(spark, [("block", "org/")]).limit(0)
    assert [(r["rule"], r["verdict"]) for r in url_verdicts(pages, none).collect()] == [(None, "allow")]
    assert url_verdicts(pages.limit(0), rules_table(spark, [("block", "org/")])).count() == 0


def test_main_path_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string").select("url")
    text = url_verdicts(pages, rules_table(spark, [("block", "org/")]))._jdf.queryExecution().toString()
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
