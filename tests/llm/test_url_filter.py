from collections import Counter

import numpy as np
import pytest

from changetree.llm import url_filter as uf


def brute(ruled, texts):
    """The mean log ratios of texts after training on ruled, pairs of (text, accepted), with exact counts in dictionaries."""
    counts = Counter()
    for text, accepted in ruled:
        symbols = ["start"] * uf.ORDER + [*text.encode(), "end"]
        for i in range(uf.ORDER, len(symbols)):
            for k in range(uf.ORDER + 1):
                context = tuple(symbols[i - k : i])
                counts[accepted, context, symbols[i]] += 1
                counts[accepted, context] += 1
    out = []
    for text in texts:
        symbols, logs = ["start"] * uf.ORDER + [*text.encode(), "end"], []
        for i in range(uf.ORDER, len(symbols)):
            p = [1 / 257, 1 / 257]
            for k in range(uf.ORDER + 1):
                context = tuple(symbols[i - k : i])
                p = [(counts[c, context, symbols[i]] + uf.WEIGHT * p[c]) / (counts[c, context] + uf.WEIGHT) for c in (0, 1)]
            logs.append(np.log(p[1]) - np.log(p[0]))
        out.append(np.mean(logs))
    return out


def many_urls(n=3000):
    """URLs with far more contexts than a table of 65,536 cells holds apart."""
    rng = np.random.default_rng(3)
    ends = ["example.net/en/", "a.org/fr/", "b.net/x/", "example.com/de/", "other.example/"]
    return [f"https://{ends[k % 5]}{bytes(rng.integers(97, 123, 40).astype(np.uint8)).decode()}" for k in range(n)]


@pytest.mark.parametrize("chunk", [1 << 18, 500])
def test_scores_equal_exact_counts(spark, monkeypatch, chunk):
    monkeypatch.setattr(uf, "CHUNK", chunk)
    urls = many_urls()
    got = uf.url_filter(spark.createDataFrame([(u, "x") for u in urls], "url string, row string")).collect()
    assert sorted(r.url for r in got) == sorted(urls)
    want = brute([(r.url, r.verdict == "allow") for r in got if r.rule], [r.url for r in got])
    assert np.allclose([r.score for r in got], want, atol=1e-9)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None,), ("",), ("no scheme",), ("http://x.example/é",)], "url string")
    assert {(r.url, r.host, r.verdict) for r in uf.url_filter(df).collect()} == {(None, "", "allow"), ("", "", "allow"), ("no scheme", "", "allow"), ("http://x.example/é", "x.example", "allow")}
    assert uf.url_filter(df.where("false")).collect() == []


def test_the_whole_url_is_judged(spark):
    """Good and bad URLs that differ in query or fragment only teach the models so much."""
    ruled = [f"https://example.net/en/{k}?page=good#top" for k in range(40)] + [f"https://b.net/en/{k}?click=spam#ad" for k in range(40)]
    asked = ["https://z.test/en/1?page=good#top", "https://z.test/en/1?click=spam#ad", "page=good#top", "click=spam#ad"]
    got = {r.url: r for r in uf.url_filter(spark.createDataFrame([(u,) for u in ruled + asked], "url string")).collect()}
    good, bad, bare_good, bare_bad = (got[u] for u in asked)
    assert (good.host, good.path) == (bad.host, bad.path) == ("z.test", "/en/1") and bare_good.host == bare_bad.host == ""
    assert good.score > 0 > bad.score and bare_good.score > 0 > bare_bad.score


def test_a_class_of_one_hot_url_is_learnt(spark):
    """All rejected rows have one URL, of the fold that training used to leave out."""
    one = spark.range(100).selectExpr("concat('https://b.net/casino/', id) AS url").where(f"pmod(xxhash64(cast(url as binary)), {uf.FOLDS}) = 0").first()[0]
    good = [f"https://example.net/en/article-{k}" for k in range(40)]
    asked = ["https://z.test/casino/7", "https://z.test/en/article-7"]
    rows = uf.url_filter(spark.createDataFrame([(u,) for u in [one] * 60 + good + asked], "url string")).collect()
    got = {r.url: r for r in rows}
    assert len(rows) == 102 and [got[u].verdict for u in asked] == ["block", "allow"]
    want = brute([(one, False)] * 60 + [(u, True) for u in good], asked)
    assert np.allclose([got[u].score for u in asked], want, atol=1e-9)
