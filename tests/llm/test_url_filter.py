"""URL verdicts against a brute-force reading of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm.queries import URL_RULES
from quern.llm.url_filter import Rule, build_cascade, filter_urls


def brute(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best and best.key, best.verdict if best else default


def test_rules(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme.org/x", "://", "http://", "http://ORG/", "http://xorg/", "http://a.org", "http://a.org?x=://b.com/de/", "http://É.Example.ORG/es/1#a", "http://a..org//", "http://user@example.org:80/en/1", "http://" + "a." * 300 + "org/" + "p" * 5000]
    urls += [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'A.b.'])}{rng.choice(['example.org', 'x.com', 'org', 'q.net', 'notexample.org'])}/{rng.choice(['es', 'en', 'fr', 'de', ''])}{rng.choice(['/', '', '/1', '/12?q', '#x'])}" for _ in range(300)]
    rows = [(i, u, "r") for i, u in enumerate(urls)] + [(3, urls[5], "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = sorted(map(tuple, filter_urls(pages, URL_RULES).collect()), key=repr)
    assert got == sorted(((i, *brute(u, URL_RULES)) for i, u, _ in rows), key=repr)
    assert {r.verdict for r in filter_urls(pages, [], default="block").collect()} == {"block"}
    assert filter_urls(pages.limit(0), URL_RULES).collect() == []
    with pytest.raises(ValueError):
        filter_urls(pages, [Rule("a", "/", "allow"), Rule("a", "/", "block")])


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 20_000, 23).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = build_cascade(listed, universe, 20_000)
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.has(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 23 == 0))
    assert wrong.count() == 0
