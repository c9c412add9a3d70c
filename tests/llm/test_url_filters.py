import datetime as dt
import random

from columnaut.llm import url_filters as U

DAY = dt.date(2024, 1, 1)


def brute(url, when, entries):
    """(blocked, pattern) of one capture."""
    rest = (url or "").partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:cut].rpartition("@")[2].partition(":")[0].lower().rstrip(".")
    path = rest[cut:].split("?")[0].split("#")[0]
    found = []
    for p in {e[0] for e in entries if e[0]}:
        hit = host == p or host.endswith("." + p) or "/" in p and (host + path + "/").startswith(p + "/")
        past = [e for e in entries if e[0] == p and e[3] and when and e[3] <= when]
        if host and hit and past:
            last = max(e[3] for e in past)
            action = max((e[1] for e in past if e[3] == last), key=["remove", "allow", "block"].index)
            if action != "remove":
                found.append((len(p), p, action == "block"))
    return (max(found)[2], max(found)[1]) if found else (False, None)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.b.example", "b.example", "c.example", "x.c.example"]
    entries = [(rng.choice(hosts) + rng.choice(["", "", "/ads", "/ads/x"]), rng.choice(["block", "allow", "remove"]), "c", DAY + dt.timedelta(rng.randrange(20))) for _ in range(60)]
    entries += [entries[0], (None, "block", "c", DAY), ("c.example", "block", "c", None)]
    urls = ["http://A.b.example/ads/x?q#f", "https://u:p@b.example:80/ads", "http://c.example", "http://x.c.example./adsx", "http://b.example/ads/", "nonsense", "", None, "http://zb.example/", "http://b.example?x=/ads"]
    rows = [(i, rng.choice(urls), DAY + dt.timedelta(rng.randrange(-2, 24)) if i % 17 else None) for i in range(400)] + [(3, urls[0], DAY)] * 2
    captures = spark.createDataFrame(rows, "cid int, url string, t date").selectExpr("*", "'k' as key", "1 as uid", "'h' as host")
    listed = spark.createDataFrame(entries, "pattern string, action string, category string, at date")
    want = sorted((i, *brute(u, t, entries)) for i, u, t in rows)
    key = lambda r: (r[0], r[1], r[2] or "")
    for most in (1000, 0):
        got = [(r.cid, r.blocked, r.entry) for r in U.filter_urls(captures, listed, "cid", "url", "t", broadcast_rows=most).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert U.filter_urls(captures.limit(0), listed, "cid", "url", "t").count() == 0
    assert not U.filter_urls(captures, listed.limit(0), "cid", "url", "t").where("blocked").count()


def test_patterns_with_capitals_and_slashes(spark):
    patterns = ["Example.com/Ads", "b.example/ads/", "C.Example/", "d.example/ads"]
    listed = spark.createDataFrame([(p, "block", "c", DAY) for p in patterns], "pattern string, action string, category string, at date")
    urls = {"http://EXAMPLE.com/Ads/x": "example.com/Ads", "http://example.com/ads/x": None, "http://b.example/ads": "b.example/ads", "http://b.example/ads/y": "b.example/ads", "http://www.c.example/z": "c.example", "http://d.example/ADS": None}
    captures = spark.createDataFrame([(u, DAY) for u in urls], "url string, t date")
    assert {r.url: r.entry for r in U.filter_urls(captures.selectExpr("url as cid", "url", "t"), listed, "cid", "url", "t").withColumnRenamed("cid", "url").collect()} == urls


def test_urls_deeper_than_the_list(spark):
    """A URL of 20,000 steps asks for no more keys than the list is deep."""
    long = "http://www.a.example/" + "x/" * 20_000
    rows = [(1, long, "2024-01-01"), (2, "http://" + "b." * 3000 + "a.example/x/x", "2024-01-01"), (3, "http://a.example/x", "2024-01-01"), (4, "http://a.example/xy/x", "2024-01-01")]
    captures = spark.createDataFrame(rows, "id long, url string, at string").selectExpr("id", "url", "cast(at as date) as at")
    entries = spark.createDataFrame([("a.example", "allow", "c", "2023-01-01"), ("a.example/x/x/", "block", "c", "2023-01-01"), ("www.a.example/x/x/x", "block", "d", "2023-01-01")], "pattern string, action string, category string, at string").selectExpr("pattern", "action", "category", "cast(at as date) as at")
    for limit in (1000, 0):
        got = {r.id: (r.blocked, r.entry) for r in U.filter_urls(captures, entries, "id", "url", "at", broadcast_rows=limit).collect()}
        assert got == {1: (True, "www.a.example/x/x/x"), 2: (False, "a.example"), 3: (False, "a.example"), 4: (False, "a.example")}
    none = U.filter_urls(captures, entries.limit(0), "id", "url", "at").collect()
    assert len(none) == 4 and not any(r.blocked for r in none)
