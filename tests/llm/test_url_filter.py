"""Rules against plain string tests, features against plain counts, trees against held-out URLs."""

import math
import random
from collections import Counter

import pytest

from tidewatch.llm import url_filter
from tidewatch.llm.queries import URL_RULES

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    return rest[:at].translate(_LOWER), rest[at:max(at, end)]


def plain_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


URLS = [
    "http://a.example.org/en/1", "http://A.EXAMPLE.ORG/en/12?x=1", "http://example.org/es/", "http://example.org/es", "http://org/x",
    "http://xorg/", "http://notexample.org/es/", "http://a.com/fr/1#t", "http://a.com/FR/1", "http://com/de/", "http://a.com", "http://a.org",
    "http://a.org?x=/", "a.org/x", "//a.org/x", "x://y://a.org/", "http://u:p@a.org:80/x", "http://a.org#/x", None, "", "://", "http://",
    "http://É.org/É", "http://a.org/\n/x", "http://a.net/" + "x1/" * 20000, "http://a.org./x", "http://.org/x",
]


@pytest.fixture(scope="module")
def simple(spark):
    rows = spark.createDataFrame([(u, i % 2) for i, u in enumerate(URLS)], "url string, blocked int")
    return url_filter.train(rows, trees=2, depth=2)


def test_rules_and_parts(spark, simple):
    rows = [(i, u, "h", 5) for i, u in enumerate(URLS)] + [(0, URLS[0], "h", 5), (None, URLS[2], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    found = simple.judge(pages, URL_RULES)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "p_block"]
    got = sorted((tuple(r)[:4] for r in found.collect()), key=repr)
    expected = []
    for key, url, *_ in rows:
        host, path = plain_parts(url)
        expected.append((key, host, path, plain_rule(host, path, URL_RULES)[0]))
    assert got == sorted(expected, key=repr)
    for row in found.collect():
        verdict = plain_rule(row["host"], row["path"], URL_RULES)[1]
        assert row["verdict"] == (verdict or ("block" if row["p_block"] >= 0.5 else "allow"))
    assert {r["rule"] for r in simple.judge(pages).collect()} == {None}


def test_lexical_features(spark):
    rows = spark.createDataFrame([(u, 1) for u in URLS if u], "url string, length int")
    found = url_filter.described(rows.select("url"), "url")
    for row in found.collect():
        url = row["url"]
        host, path = plain_parts(url)
        n = Counter(url)
        query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
        assert row["length"] == len(url) and row["host_length"] == len(host)
        assert row["depth"] == sum(1 for p in path.split("/") if p)
        assert row["digits"] == pytest.approx(sum(n[d] for d in "0123456789") / len(url))
        assert row["entropy"] == pytest.approx(-sum(c / len(url) * math.log2(c / len(url)) for c in n.values()))
        assert row["parameters"] == sum(1 for p in query.split("&") if p)
        assert row["hyphens"] == host.count("-") and row["labels"] == len(host.split("."))


def labelled(seed, rows):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    out = []
    for _ in range(rows):
        bad = rng.random() < 0.4
        if bad:
            host = f"{word(4)}-{rng.randint(100, 99999)}-{word(3)}.{rng.choice(['xyz', 'top', 'com'])}"
            url = f"http://{host}/{word(3)}{rng.randint(1000, 10**9)}?" + "&".join(f"{word(2)}={rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 6)))
        else:
            url = f"https://www.{word(8)}.{rng.choice(['com', 'org', 'de'])}/" + "/".join(word(6) for _ in range(rng.randint(1, 4)))
        out.append((url, int(bad)))
    return out


def test_held_out_accuracy(spark):
    kind = "url string, blocked int"
    fitted = url_filter.train(spark.createDataFrame(labelled(1, 1500), kind))
    rows = fitted.score(spark.createDataFrame(labelled(2, 500), kind)).collect()
    assert len(rows) == 500
    assert sum((r["p_block"] >= 0.5) == bool(r["blocked"]) for r in rows) >= 475


def test_sample_is_bounded_and_repeatable(spark, monkeypatch):
    rows = spark.createDataFrame(labelled(3, 400), "url string, blocked int")
    seen = []
    real = url_filter._suffixes
    monkeypatch.setattr(url_filter, "_suffixes", lambda rows, rate: seen.append(rows.count()) or real(rows, rate))
    first = url_filter.train(rows, sample=100, trees=3)
    second = url_filter.train(rows.repartition(7).union(rows), sample=100, trees=3)
    assert seen[url_filter.FOLDS] == 100 and max(seen) == 100
    a, b = (sorted(tuple(r) for r in f.score(rows).collect()) for f in (first, second))
    assert a == b


def test_every_labelled_url_counts(spark, monkeypatch):
    rows = spark.range(20500).selectExpr("concat('http://h', id, IF(id % 3 = 0, '.bad/', '.good/')) AS url", "CAST(id % 3 = 0 AS INT) AS blocked")
    seen, bins = [], []
    suffixes, learner = url_filter._suffixes, url_filter.GBTClassifier
    monkeypatch.setattr(url_filter, "_suffixes", lambda rows, rate: seen.append(rows.count()) or suffixes(rows, rate))
    monkeypatch.setattr(url_filter, "GBTClassifier", lambda **kw: bins.append(kw["maxBins"]) or learner(**kw))
    fitted = url_filter.train(rows, trees=1, depth=1)
    assert seen[url_filter.FOLDS] == 20500
    assert bins[0] ** 2 >= 20500  # thresholds from all rows too
    assert fitted.rate == pytest.approx(6834 / 20500)


def test_one_class_and_empty(spark):
    kind = "url string, blocked int"
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    for rows, verdict in (([], "allow"), ([("http://b.com/", 1), ("http://b.com/", 0)], "block"), ([("x", 0), (None, 1), ("y", 7)], "allow")):
        fitted = url_filter.train(spark.createDataFrame(rows, kind))
        assert fitted.model is None
        assert {r["verdict"] for r in fitted.judge(pages).collect()} == {verdict}
    assert fitted.judge(pages.limit(0), URL_RULES).collect() == []


def test_whole_table(spark, folder, duck):
    from tidewatch.llm.queries import QUERIES

    found = {r["page_id"]: r for r in QUERIES["op12_url_filter"](spark, folder).collect()}
    pages = duck.execute("SELECT page_id, url FROM pages").fetchall()
    assert len(found) == len(pages)
    for key, url in pages:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path, URL_RULES)
        row = found[key]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or ("block" if row["p_block"] >= 0.5 else "allow"))
