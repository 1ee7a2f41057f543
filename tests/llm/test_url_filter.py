import pytest

from tallyframe.llm import url_filter as U

URLS = [
    "http://A.example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/de/1", "http://x.com/fr/", "http://com/fr/", "http://org", "http://org/", "http://notorg/", "http://a.b.c.d.e.example.org/es/",
    "no scheme", "", None, "http://", "http:///path", "ftp://example.org/en/1", "http://example.org?x=/es/", "http://example.org./es/", "http://EXAMPLE.org/ES/", "http://u@x.com:80/de/", "x://y://org/", "http://com/de/#://",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([k for k in (path.find(c) for c in "?#") if k >= 0], default=len(path))]
    fits = [(len(h) + len(p), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("limit", [U.BROADCAST_RULES, 0])
def test_equals_brute_force(spark, limit):
    rules = [*U.RULES, ("block", "d.e.example.org", "/es/"), ("allow", "e.example.org", "/es/"), ("block", "y:", "//org/"), ("block", "org", "")]
    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, U.rules_table(spark, rules), broadcast_rules=limit).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate([*URLS, URLS[0]])}


def test_no_rules_no_pages(spark):
    pages = spark.createDataFrame([(1, URLS[0]), (None, None), (1, URLS[0])], "page_id long, url string")
    rules = U.rules_table(spark)
    assert {r.verdict for r in U.filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert U.filter_urls(pages, rules).count() == 3 and U.filter_urls(pages.limit(0), rules).count() == 0


def test_many_lengths_of_rules(spark):
    rules = [("block", "x.com", "/" + "a" * k) for k in range(U.MAX_LENGTHS + 5)]
    pages = spark.createDataFrame([(1, "http://x.com/" + "a" * 100 + "b")], "page_id long, url string")
    assert U.filter_urls(pages, U.rules_table(spark, rules)).first().rule == "x.com/" + "a" * 100


def test_very_long_urls(spark):
    rules = [*U.RULES, ("block", ".".join(["a"] * 300), "/"), *[("block", ".".join(["b"] * k) + ".net", "/x") for k in range(1, U.MAX_LENGTHS + 9)]]
    urls = ["http://" + "a." * 60_000 + "example.org/es/" + "p/" * 60_000, "http://" + ".".join(["a"] * 400) + "/y", "http://b.b.b.net/x" + "y" * 100_000, "http://" + "c" * 200_000, "http://x.com/fr/" + "%20" * 50_000]
    for own in (U.RULES, rules):
        pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, U.rules_table(spark, own)).collect()}
        assert got == {k: brute(u, own) for k, u in enumerate(urls)}
