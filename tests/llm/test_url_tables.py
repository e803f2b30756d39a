"""URL rules as a table of any size, over many ranges, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.urlrules")

from tidemark.llm import urlrules  # noqa: E402


def brute(host, path, rules):
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    best = max(fits) if fits else None
    return (best[2], best[3]) if best else (None, "allow")


@pytest.mark.parametrize("size", [7, 10**6])
def test_ranges_carry_open_rules(spark, monkeypatch, size):
    monkeypatch.setattr(urlrules, "RANGE", size)
    rng = random.Random(4)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "example.net", "net", "exam.ple.com", "org", "x" * 150 + ".com", "é.org", ""]
    paths = ["", "/", "/en", "/en/", "/en/7", "/de/8/x", "/" + "p" * 90]
    rules = [(rng.choice(["block", "allow"]), rng.choice(hosts[:-1]), rng.choice(paths)) for _ in range(40)]
    rows = [(i, f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=1', '#f', '1'])}") for i in range(300)] + [(None, None), (5, "no scheme"), (5, "no scheme"), (None, "ftp://hot.example.com/en/9")] + [(7, "https://hot.example.com/en/7")] * 60
    df = spark.createDataFrame(rows, "page_id int, url string").select("*", F.lit("mine").alias("Host"), F.lit(1).alias("rule"), F.lit(2).alias("key"), F.lit(3).alias("place")).repartition(3)
    got = urlrules.judge(df, rules, ident=["page_id", "url", "Host", "rule"])
    assert got.columns == ["page_id", "url", "_Host", "_rule", "host", "path", "rule", "verdict"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.rule, r.verdict) == brute(r.host, r.path, rules) and (r._Host, r._rule) == ("mine", 1), r
    many = len(urlrules.borders(df.select(F.coalesce("url", F.lit("")).alias("place"), F.xxhash64("url", "page_id").alias("h"))))
    assert (many > 5) == (size == 7)
    assert urlrules.judge(df.limit(0), rules).count() == 0
    assert {(r.rule, r.verdict) for r in urlrules.judge(df, []).collect()} == {(None, "allow")}


def test_three_hundred_thousand_rules(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "RANGE", 40)
    some = [("block" if i % 3 else "allow", f"h{i % 50_000}.example{i % 7}.org", f"/p{i % 11}/") for i in range(250_000)] + [("block", "big.net", f"/{i}/") for i in range(50_000)] + [("allow", "org", ""), (None, "x.org", ""), ("block", "null.org", None)]
    table = spark.createDataFrame(some, "verdict string, host string, path string").repartition(4)
    rows = [(i, f"http://w.h{i * 13 % 50_000}.example{i % 7}.org/p{i % 12}/x") for i in range(400)] + [(i, f"http://big.net/{i * 7}/y") for i in range(400, 600)] + [(600, "http://a.null.org/z"), (601, "http://x.org/")]
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judge(spark.createDataFrame(rows, "page_id int, url string").repartition(5), table).collect()}
    by = {}
    for v, h, p in some:
        if v:
            by.setdefault(h, []).append((v, h, p or ""))
    for i, url in rows:
        host, _, path = url.removeprefix("http://").partition("/")
        labels = host.split(".")
        near = [r for k in range(len(labels)) for r in by.get(".".join(labels[k:]), [])]
        assert got[i] == brute(host, "/" + path, near), url
