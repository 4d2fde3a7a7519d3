from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from habitus.llm import urlfilter

START = datetime(2024, 1, 1)
ENTRIES = [
    ("block", "host", "a.example.com", 10, "add"), ("block", "host", "a.example.com", 20, "remove"),
    ("block", "host", "a.example.com", 200, "add"), ("block", "host", "a.example.com", 200, "remove"),
    ("block", "host", "A.example.com", 300, "add"), ("block", "host", "a.example.com", 310, "add"),
    ("spam", "domain", "example.com", 50, "add"), ("spam", "domain", "example.com", 60, "remove"),
    ("spam", "domain", "example.com", 55, "remove"), ("spam", "domain", "com", 0, "add"),
    ("allow-urls", "url", "http://a.example.com/ok", 0, "add"), ("block", "host", "b.example.com", 5, "remove"),
    ("block", "host", None, 5, "add"), (None, "host", "b.example.com", 5, "add"), ("spam", "domain", "org", 5, "block"),
    ("block", "host", "future.net", 900, "add"),
]
URLS = [
    "http://a.example.com/x", "https://user@A.EXAMPLE.COM.:8080/", "http://a.example.com/ok", "ftp://b.a.example.com", "http://b.example.com/y",
    "no url", None, "http://example.com", "http://com/", "http://x.org?q", "http://future.net",
]
DAYS = [0, 9, 10, 19, 20, 52, 55, 58, 199, 200, 300, 305, 400, None]


@pytest.fixture(scope="module")
def case(spark):
    def at(day):
        return None if day is None else START + timedelta(days=day)

    entries = spark.createDataFrame(
        [(n, s, v, at(d), a) for n, s, v, d, a in ENTRIES], "list string, scope string, value string, at timestamp, action string"
    ).selectExpr("*", "1 as since", "2 as url")
    pages = [(k * 100 + d, u, at(day)) for k, u in enumerate(URLS) for d, day in enumerate(DAYS)]
    captures = spark.createDataFrame(pages, "page_id long, url string, at timestamp").selectExpr("*", "'x' as value", "'y' as list", "0 as period")
    return captures, entries


def test_each_fetch_meets_the_entries_of_its_time(case):
    captures, entries = case
    rows = {r.page_id: r for r in urlfilter.judged(captures, entries).collect()}
    assert len(rows) == len(URLS) * len(DAYS)

    def on(name, scope, value, day):
        held = False
        known = [e for e in ENTRIES if None not in e and (e[0], e[1], e[2].lower()) == (name, scope, value)]
        for d in sorted({e[3] for e in known}):
            if d <= day:
                held = any(e[3] == d and e[4] == "add" for e in known)
        return held

    hosts = {0: "a.example.com", 1: "a.example.com", 2: "a.example.com", 3: "b.a.example.com", 4: "b.example.com", 7: "example.com", 8: "com", 9: "x.org", 10: "future.net"}
    kinds = {(e[0], e[1], e[2].lower()) for e in ENTRIES if None not in e}
    for k, url in enumerate(URLS):
        for d, day in enumerate(DAYS):
            r, host = rows[k * 100 + d], hosts.get(k)
            want = set()
            for name, scope, value in kinds:
                parts = (host or "").split(".")
                parents = {".".join(parts[i:]) for i in range(max(1, len(parts) - 1))}
                named = {"host": value == host, "domain": value in parents, "url": value == (url or "").lower()}[scope]
                if day is not None and url and named and on(name, scope, value, day):
                    want.add((name, scope, value))
            assert r.entries == len(want), (url, day, r, want)
            assert r.lists == ",".join(sorted({w[0] for w in want}))
            names = {w[0] for w in want}
            assert r.verdict == ("allow" if "allow-urls" in names else "block" if names else "pass")


def test_every_row_is_judged(spark):
    """Repeated captures stay, and a URL without a host is met by an entry for it."""
    at = lambda d: START + timedelta(days=d)
    entries = spark.createDataFrame(
        [("block-urls", "url", "example.com/x", at(1), "add")], "list string, scope string, value string, at timestamp, action string"
    )
    rows = [(1, "example.com/x", at(5)), (1, "example.com/x", at(5)), (None, None, None), (None, None, None), (2, "example.com/x", at(0))]
    captures = spark.createDataFrame(rows, "page_id long, url string, at timestamp")
    got = sorted((str(r.page_id), r.verdict, r.entries) for r in urlfilter.judged(captures, entries).collect())
    assert got == [("1", "block", 1), ("1", "block", 1), ("2", "pass", 0), ("None", "pass", 0), ("None", "pass", 0)]


def test_intervals(case):
    rows = urlfilter.intervals(case[1]).where("value = 'a.example.com'").orderBy("since").collect()
    days = [((r.since - START).days, r.until and (r.until - START).days) for r in rows]
    assert days == [(10, 20), (200, None)]


def test_empty_tables(case):
    captures, entries = case
    assert urlfilter.judged(captures.where("false"), entries).count() == 0
    rows = urlfilter.judged(captures, entries.where("false")).collect()
    assert len(rows) == captures.count() and {r.verdict for r in rows} == {"pass"}


def test_host(spark):
    urls = [("http://A.b/c", "a.b"), ("//a.b", None), ("https://u:p@h.i:9/", "h.i"), ("x", None), ("http://", None), ("http://a.b.?q", "a.b")]
    df = spark.createDataFrame([(u,) for u, _ in urls], "url string")
    assert [r[0] for r in df.select(urlfilter.host_of(F.col("url"))).collect()] == [h for _, h in urls]
