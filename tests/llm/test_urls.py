import pytest

from shelfspark.llm import urls

URLS = ["http://www.Example.COM/en/x?q#f", "https://example.com/en/", "http://example.com", "http://example.com/", "ftp://a.b.example.com/en/y", "http://notexample.com/en/z",
        "http://x.net/es/1", "http://x.net/fr", "http://net/fr/", "http://x.org/en/", "no scheme", "", None, "http://", "http://?q=http://a.com/", "a://b://c.com/en/",
        "http://com/", "http://user@x.com:80/", "http://x.com:80/", "HTTP://É.COM/\n/x", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://a.com//", "http://.com/"]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


@pytest.mark.parametrize("rules", [urls.RULES, [("com", "", "block"), ("example.com", "/e", "allow"), ("a.b.example.com", "/en/y", "block"), ("com", "/", "allow")]])
def test_equals_plain_rules(spark, rules):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(1, URLS[1], "y"), (None, URLS[0], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    listed = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((tuple(r) for r in urls.judge_urls(df, listed).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted(((i, *plain(u, rules)) for i, u, _ in rows), key=str)
    assert urls.judge_urls(df.filter("false"), listed).count() == 0
    none = urls.judge_urls(df, listed.filter("false"), default="block")
    assert {(r["rule"], r["verdict"]) for r in none.collect()} == {(None, "block")}


def test_query_equals_sql(spark):
    from oracle_check import compare, connect
    from shelfspark.llm.registered import ORACLES, QUERIES
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op5_url_filters"](spark, sf), connect(sf), ORACLES["op5_url_filters"]) == ""
