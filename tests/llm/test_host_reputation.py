import re

import pytest
from pyspark.sql import functions as F

from pairwright.llm import host_reputation as hr
from pairwright.llm.queries import RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    hits = [r for r in RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith(r[0][r[0].index("/"):])]
    return max(hits, key=lambda r: len(r[0]), default=(None, None))


URLS = [
    "http://A.Example.NET/en/x?y#z", "https://example.net/de/", "http://example.net", "http://example.net?q=/en/", "http://net/", "http://xnet/", "http://example.com/de/a", "http://example.com/den", "ftp://u:p@h.org:80/fr/1",
    "http://a.org/fr", "no scheme", None, "", "://", "http:///path", "x://y://z/en", "http://ÉX.net/a b", "http://a.b.example.com/de/?x", "HTTP://EXAMPLE.COM/DE/", "http://example.net/en/http://q/", "http://h\n.net/\nx",
]


def test_hosts_paths_rules(spark):
    pages = spark.createDataFrame([(k, u, "x", "x") for k, u in enumerate(URLS)] + [(None, "http://a.net/", "x", "x"), (0, URLS[0], "x", "x")], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([(1, None), (None, True)], "page_id long, bad boolean")
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in hr.filter_urls(pages, none, RULES).collect())
    want = []
    for k, u in [*enumerate(URLS), (None, "http://a.net/"), (0, URLS[0])]:
        host, path = parts(u)
        r, says = rule(host, path)
        want.append((str(k), host, path, r, says or "allow"))
    assert got == sorted(want, key=lambda x: x) and len(got) == len(URLS) + 2


def test_shrinkage(spark):
    """Few bad pages do not block a host; many do, and an unknown host of the same domain goes along."""
    pages, labels, k = [], [], 0
    for host, n, bad in [("spam.bad.com", 200, 195), ("one.good.com", 1, 1), ("new.bad.com", 0, 0), ("fine.good.com", 300, 3), ("x.co.uk", 60, 2), ("shop.x.co.uk", 5, 5), ("y.co.uk", 40, 1), ("z.org", 50, 30), ("w.org", 50, 0)]:
        for i in range(max(1, n)):
            pages.append((k, f"http://{host}/{i}"))
            if n:
                labels.append((k, i < bad))
            k += 1
    out = hr.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"), [])
    by = {r["host"]: r for r in out.dropDuplicates(["host"]).collect()}
    assert {h for h, r in by.items() if r["verdict"] == "block"} == {"spam.bad.com", "new.bad.com"}
    assert by["new.bad.com"]["lower_bound"] < by["spam.bad.com"]["lower_bound"]
    assert by["one.good.com"]["bad_rate"] < 1 and by["one.good.com"]["lower_bound"] < 0.5
    assert by["new.bad.com"]["bad_rate"] > by["w.org"]["bad_rate"]
    assert by["spam.bad.com"]["lower_bound"] < by["spam.bad.com"]["bad_rate"] < 0.975


def test_suffixes(spark):
    hosts = ["a.b.co.uk", "co.uk", "b.com", "com", "", "a.b.com"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select(hr.domain_of(F.col("h")), hr.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", ""), ("b.com", "com")]


def test_names_of_hosts(spark):
    """Ports and user names do not count, addresses stand for themselves, the longest suffix wins."""
    hosts = ["u:p@a.example.com:8080", "10.0.0.1:80", "[::1]:443", "b.github.io", "x.foo.co.in", "a.b.c.kobe.jp", "c.kobe.jp", "a.com:"]
    own = ["github.io", "co.in", "c.kobe.jp", "kobe.jp"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select(hr.domain_of(F.col("h"), own), hr.suffix_of(F.col("h"), own)).collect()
    assert [tuple(r) for r in rows] == [
        ("example.com", "com"), ("10.0.0.1", ""), ("[::1]", ""), ("b.github.io", "github.io"), ("foo.co.in", "co.in"), ("b.c.kobe.jp", "c.kobe.jp"), ("c.kobe.jp", "c.kobe.jp"), ("a.com", "com"),
    ]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert hr.filter_urls(pages, spark.createDataFrame([], "page_id long, bad boolean"), RULES).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_repeated_rows_and_labels(spark, same):
    pages = spark.createDataFrame([(1, "http://a.com/")] * 3 + [(2, "http://a.com/b")], "page_id long, url string")
    labels = spark.createDataFrame([(1, True), (1, same)], "page_id long, bad boolean")
    assert [r["bad_rate"] > 0.9 for r in hr.filter_urls(pages, labels, []).collect()] == [True] * 4
