import pytest
from pyspark.sql import functions as F

from tallybook.llm import urls
from tallybook.llm.queries import URL_RULES

URLS = [
    "http://a.org/x", "HTTP://EXAMPLE.ORG/es/1", "https://b.example.org/es/", "http://example.org/es",
    "http://example.org/en/17?x=1", "http://c.d.example.org/en/1", "http://notexample.org/es/1",
    "http://x.com/fr/#f", "http://x.com/de/", "http://com/fr/a", "http://x.com", "http://org", "http://org/",
    "no scheme", None, "", "://", "http:///path", "http://ÄÖ.org/ü/é", "http://user@x.org:80/",
    "a://b://c.org/d", "http://x.org\n/es/", "http://.org/", "http://example.org./es/",
    "http://x.com/fr/" + "a/" * 5000,
]
RULES = [
    *URL_RULES,
    ("x.com", "/", "block"), ("x.com", "/fr/a", "allow"), ("x.com", "/fr/a/a/", "block"),
    ("c.d.example.org", "", "allow"), ("org", "/", "block"),
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = {}
    for h, p, v in sorted(rules, key=lambda r: r[2], reverse=True):
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best[h + p] = v
    rule = max(best, key=lambda r: (len(r), r), default=None)
    return host, path, rule, best.get(rule, default)


@pytest.mark.parametrize("rules", [URL_RULES, RULES])
def test_as_by_brute_force(spark, rules):
    rows = [(n, u, "clash", "clash") for n, u in enumerate(URLS)] + [(0, URLS[0], "c", "d")]
    rows.append((None, URLS[1], None, None))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, _host string")
    given = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    found = urls.filter_urls(pages, given).collect()
    got = sorted(((r.url, r.host, r.path, r.rule, r.verdict) for r in found), key=str)
    assert got == sorted(((r[1], *brute(r[1], rules)) for r in rows), key=str)


def test_paths_beyond_every_letter(spark):
    """An interval takes in the largest code point there is, however often it comes."""
    paths = ["a", "a\U0010ffff", "a\U0010ffff\U0010ffffz", "a\U0010ffffz", "b", "a\x7f", "a\uffff", "`", "\U0010ffff"]
    pages = spark.createDataFrame([(n, f"http://x.org/{p}") for n, p in enumerate(paths)], "page_id bigint, url string")
    rules = [("org", "/a", "block"), ("org", "/a\U0010ffff", "allow"), ("x.org", "/\U0010ffff", "block")]
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((r.url, r.rule, r.verdict) for r in urls.filter_urls(pages, given, "none").collect())
    want = sorted((f"http://x.org/{p}", *brute(f"http://x.org/{p}", rules, "none")[2:]) for p in paths)
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]


def test_sweep_is_dealt_by_host_and_share(spark):
    pages = spark.range(5_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.com/fr/"), "id").alias("url"))
    given = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    rows = urls.filter_urls(pages, given).select("host", "path").distinct()
    plan = urls.match_urls(rows, given)._jdf.queryExecution().executedPlan().toString()
    window = next(n for n, line in enumerate(plan.splitlines()) if "Window" in line)
    dealt = next(line for line in plan.splitlines()[window:] if "hashpartitioning" in line)
    assert "_host" in dealt and "_share" in dealt


def test_busy_host_is_shared_out(spark):
    pages = spark.range(20_000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://hot.com/fr/"), "id").alias("url")
    )
    given = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    found = urls.filter_urls(pages, given)
    assert {tuple(r) for r in found.groupBy("rule").count().collect()} == {("com/fr/", 20_000)}


def test_empty_tables(spark):
    given = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.filter_urls(none, given).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert urls.filter_urls(one, given.limit(0)).first().verdict == "allow"
