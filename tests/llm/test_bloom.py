import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from editloom.llm import bloom

URLS = [
    None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://a.Example.ORG/es/1?x#y", "http://example.org/en/1234", "http://example.org/en/2", "http://notexample.org/es/",
    "ftp://x.com/fr/a?b://c", "http://x.com/de/", "http://x.com?/de/", "http://www.casino-win.example.net/", "http://casino-win.example.net", "http://casino-win.example.com/fr/1", "http://x-casino-win.example.net/a",
    "http://a.com:80/fr/", "http://x.com/d\n/de/", "http://é.net/ü", "://com/fr/", "http://com#/fr/",
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(h + p, v) for v, h, p in bloom.RULES if under(h) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda f: len(f[0]))
    return host, path, None, "block" if any(map(under, bloom.LISTED_HOSTS)) else "allow"


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, keys int")


def test_urls(spark):
    urls = URLS + [f"http://h{k}.example.{t}/{p}/{k}" for k in range(60) for t in ("org", "com", "net") for p in ("es", "de", "fr", "en")]
    got = {x.page_id: tuple(x)[1:] for x in bloom.filter_urls(pages(spark, urls)).collect()}
    assert got == {k: judged(u) for k, u in enumerate(urls)}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(urls)), "url": urls}))
    assert {r[0]: r[1:] for r in con.sql(bloom.op9_sql()).fetchall()} == got


def test_edges(spark):
    some = pages(spark, URLS)
    assert bloom.filter_urls(some.limit(0)).count() == 0
    assert bloom.filter_urls(some.unionAll(some)).count() == 2 * len(URLS)
    assert {x.verdict for x in bloom.filter_urls(some, rules=(("block", "com", "/fr/"),), listed_hosts=()).where("rule is null").collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    r = random.Random(9)
    keys = [f"key{k}" for k in range(6000)]
    listed = set(r.sample(keys, 700))
    df = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean").select("key", F.xxhash64("key").alias("h"), "listed").cache()
    (cascade,) = bloom.build_cascades(df.select("h", "listed"))
    assert len(cascade.levels) > 2
    rows = df.collect()
    got = cascade.contains(np.array([x.h for x in rows]).view(np.uint64))
    assert got.tolist() == [x.listed for x in rows]
    assert sum(len(b) for b, _ in cascade.levels) < 6000
    for chosen in (set(), set(keys)):
        flagged = df.select("h", F.lit(bool(chosen)).alias("listed"))
        assert bloom.build_cascades(flagged)[0].contains(np.array([x.h for x in rows]).view(np.uint64)).all() == bool(chosen)
    h = np.array([x.h for x in rows])
    parts = bloom.build_cascades(df.select("h", "listed"), most_bytes=400)  # a list that is too long for one broadcast
    assert len(parts) > 1
    for p, one in enumerate(parts):
        own = h % len(parts) == p
        assert one.contains(h[own].view(np.uint64)).tolist() == [x.listed for x, o in zip(rows, own, strict=True) if o]


def test_lists_in_parts_and_as_a_table(spark):
    urls = URLS + [f"http://h{k}.net/{k}" for k in range(300)]
    listed = [f"h{k}.net" for k in range(0, 300, 2)]
    some = pages(spark, urls)
    want = bloom.filter_urls(some, listed_hosts=tuple(listed)).collect()
    table = spark.createDataFrame([(h.upper(),) for h in listed] * 2, "host string")
    for most in (bloom.CASCADE_BYTES, 100):
        assert bloom.filter_urls(some, listed_hosts=table, most_bytes=most).collect() == want
    assert sum(x.verdict == "block" for x in want if (x.host or "").startswith("h")) == 150


def test_a_shared_hash_is_told(spark):
    with pytest.raises(bloom.SameHash):
        bloom.small_cascade(np.array([5], np.uint64), np.array([5, 6], np.uint64))
    long = "http://a.com/" + "x" * 3_000_000
    assert bloom.filter_urls(pages(spark, [long, "http://" + "a." * 300 + "net/"])).where("length(path) > 2000000").count() == 1
