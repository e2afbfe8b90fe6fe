import re
from itertools import product

from pyspark.sql import functions as F

from tidewash.llm.urls import RULES, Tree, host_and_path, judge, matched_rule

URLS = [
    "http://Foo.Example.COM/en/1?x=/a", "https://www.example.com/en/", "http://m.www.example.com/en/7", "http://example.com/en", "http://x.net/fr/1#top",
    "http://xnet/fr/", "ftp://net/es/?q", "http://a.com", "http://a.com?x=1", "http://a.com#y", "no scheme", "", None, "a://b://c/d", "http:///path", "http://a.net/ES/1", "http://É.net/fr/é",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_hosts_paths_and_rules(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    host, path = host_and_path(F.col("url"))
    text, verdict = matched_rule(F.col("host"), F.col("path"))
    got = {r.page_id: (r.host, r.path, r.t, r.v) for r in rows.select("page_id", host.alias("host"), path.alias("path")).select("*", text.alias("t"), verdict.alias("v")).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)}
    judged = {r.id: (r.host, r.path, r.rule) for r in judge(rows).collect()}
    assert judged == {i: plain(u)[:3] for i, u in enumerate(URLS)}


def test_templates_reject_by_purity(spark):
    from tidewash.llm.urls import UrlRule

    rules = (UrlRule("block", "shop.org", "/ads/a"), UrlRule("allow", "shop.org", "/news/a"))
    slugs = ["".join(x) for x in product("pqrstu", "vwxyz", "k")]
    urls = [f"http://shop.org/ads/a{s}/{i}.html" for i, s in enumerate(slugs)] + [f"http://shop.org/ads/b{s}/{i}.html" for i, s in enumerate(slugs[:5])]
    urls += [f"http://shop.org/news/a{s}/{i}" for i, s in enumerate(slugs)] + [f"http://shop.org/news/c{s}/{i}" for i, s in enumerate(slugs[:5])] + ["http://shop.org/other/1", "http://else.org/ads/bpvk/1.html"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {urls[r.id]: r for r in judge(rows, rules, Tree(fan=20)).collect()}
    assert all(r.verdict == "block" for u, r in got.items() if "shop.org/ads" in u)
    assert all(r.verdict == "allow" for u, r in got.items() if "shop.org/ads" not in u)
    assert got["http://shop.org/ads/bpvk/0.html"].template == "/ads/{var}/{n}.html" and got["http://shop.org/ads/bpvk/0.html"].rule is None
    assert got["http://shop.org/other/1"].purity is None


def test_like_branches_merge_and_unlike_do_not(spark):
    from tidewash.llm.urls import UrlRule

    rules = (UrlRule("block", "h.org", "/x/a"), UrlRule("block", "h.org", "/y/a"), UrlRule("allow", "h.org", "/z/a"))
    urls = [f"http://h.org/{s}/a/{i}" for s in "xyz" for i in range(50)]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert {(r.template, r.verdict) for r in judge(rows, rules).collect()} == {("/x/a/{n}", "block"), ("/y/a/{n}", "block"), ("/z/a/{n}", "allow")}
    rows = rows.where("url NOT LIKE '%/z/%'")
    assert {(r.template, r.verdict) for r in judge(rows, rules).collect()} == {("/{*}/a/{n}", "block")}


def test_repeated_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "http://x.net/fr/1"), (1, "http://x.net/fr/1"), (None, None)], "page_id long, url string")
    assert sorted((str(r.id), r.verdict) for r in judge(rows).collect()) == [("1", "block"), ("1", "block"), ("None", "allow")]
    assert judge(rows.limit(0)).count() == 0


def test_deep_paths_keep_their_templates(spark):
    from tidewash.llm.urls import UrlRule

    deep = "/a/b/c/d/e/f/g"
    rules = (UrlRule("block", "h.org", deep + "/x"), UrlRule("allow", "h.org", deep + "/y"))
    urls = [f"http://h.org{deep}/{s}/{i}" for s in "xyz" for i in range(30)] + ["http://i.org/q/1/r/s/t/u/v/w"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {(r.template, r.verdict, r.purity is None) for r in judge(rows, rules).collect()}
    assert got == {(deep + "/x/{n}", "block", False), (deep + "/y/{n}", "allow", False), (deep + "/z/{n}", "allow", True), ("/q/{n}/r/s/t/u/v/w", "allow", True)}
