"""URL filters against a plain loop over the rules."""

import random
import re

from siltstone.llm import urlfilter as U


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    n, _, v, rule = max(fits, default=(0, 0, "allow", None))
    return host, path, rule, v


def test_matches_brute_force(spark):
    r = random.Random(4)
    rules = U.RULES + [("a.com", "/x", "block"), ("com", "/en", "block"), ("b.org", "", "block"), ("b.org", "", "allow"), ("com:80", "/", "block")]
    hosts = ["a.com", "A.Com", "x.a.com", "xa.com", "b.org", "www.example.com", "example.com", "w.www.example.com", "n.net", "net", "com", "", "u@a.com:80", ".com", "é.net"]
    urls = [f"{s}{h}{p}{q}" for h in hosts for s in ("http://", "https://", "") for p in ("", "/", "/en/1", "/en", "/xy", "/es/", "/fr/a/b", "/EN/") for q in ("", "?q=/en/", "#/es/")]
    urls += [None, "://", "http:/a.com/", "a://b://c.com/en/", "http://a.com\n/x"]
    pages = [(i, u, "html", 1) for i, u in enumerate(urls)] + [(7, urls[7], "", 1), (None, "http://a.com/x", "", 1)]
    r.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, host string, rule int")
    rs = spark.createDataFrame(rules + [(None, "/", "block"), ("q.com", None, "allow")], "host string, path string, verdict string")
    got = sorted(((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in U.filter_urls(df, rs).collect()), key=str)
    assert got == sorted(((i, *brute(u, rules)) for i, u, *_ in pages), key=str)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert U.filter_urls(pages, none).first()["verdict"] == "allow"
    assert U.filter_urls(pages.limit(0), spark.createDataFrame(U.RULES, none.schema)).collect() == []
