import re

import pytest

from pingtrail.llm import url_filter
from pingtrail.llm.queries import URL_RULES, op7_url_filter

SF = "/root/testdata/sf0.001"
URLS = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.COM/en/1", "http://www.example.com/en/1?x=1", "http://xwww.example.com/en/",
        "http://b.www.example.com/en/", "http://example.com/en", "http://example.com", "http://com/", "http://example.com:80/en/",
        "https://a.net/es/?p=1&q=2#f", "https://a.net/fr/#f", "https://a.net/de/", "https://net/fr/x", "https://xnet/fr/x",
        "https://É.NET/fr/x", "http://a.org/com/", "http://a.net?/es/", "a://b://c.net/es/", "http://a.net/es", "x" * 5000 + "://q.com/"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "host", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, host int")


def test_hosts_paths_and_rules(spark):
    urls = URLS + URLS[:6]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, urls), URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule = brute(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name), url
        assert got[i].verdict == rule.verdict if rule else got[i].verdict in ("allow", "block")


@pytest.mark.parametrize("urls, verdict", [(["http://a.org/", None], "allow"), (["http://a.net/fr/", "http://b.org/"], "block"),
                                           (["http://a.com/", "http://b.org/"], "allow")])
def test_one_verdict_or_none_to_learn_from(spark, urls, verdict):
    got = {r.page_id: r.verdict for r in url_filter.judge(pages(spark, urls), URL_RULES).collect()}
    assert got == {0: verdict, 1: verdict}


def test_empty_table(spark):
    assert url_filter.judge(pages(spark, []), URL_RULES).count() == 0


def test_entropy_and_counts(spark):
    frame = spark.createDataFrame([("https://ab.c.de/x/1?a=1&b=2;c#z", "ab.c.de", "/x/1"), (None, "", "")], "url string, host string, path string")
    row, none = url_filter._lexical(frame).collect()
    from collections import Counter
    from math import log2
    n = len(row.url)
    assert abs(row.entropy + sum(c / n * log2(c / n) for c in Counter(row.url).values())) < 1e-9
    assert (row.depth, row.labels, row.n_params, row.has_fragment, row.secure, row.top, row.site) == (2, 3, 3, 1, 1, "de", "c.de")
    assert none.entropy == 0.0 and none.n_params == 0


def test_trees_recover_what_the_rules_block(spark):
    """Held-out accuracy: the trees, fitted on some ruled URLs, judge others as the rules would."""
    urls = [f"http://h{i}.example.{'net' if i % 2 else 'com'}/{'es' if i % 3 else 'de'}/{i}" for i in range(400)]
    block_net = [url_filter.Rule("block", f"h{i}.example.net", "/") for i in range(1, 200, 2)]
    allow_com = [url_filter.Rule("allow", f"h{i}.example.com", "/") for i in range(0, 200, 2)]
    got = url_filter.judge(pages(spark, urls), block_net + allow_com).where("rule is null").collect()
    right = sum((r.verdict == "block") == r.host.endswith("net") for r in got)
    assert len(got) == 200 and right >= 190


def test_query(spark):
    got = op7_url_filter(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_a_row_does_not_see_its_own_label(spark):
    """Sites ruled at random teach nothing: sites without a rule score the overall block rate."""
    import random
    rng = random.Random(1)
    urls = [f"http://s{i}.org/p" for i in range(600)]
    rules = [url_filter.Rule(rng.choice(["block", "allow"]), f"s{i}.org", "/") for i in range(300)]
    blocked = sum(r.verdict == "block" for r in rules) / 300
    got = url_filter.judge(pages(spark, urls), rules).where("rule is null").collect()
    scores = [r.block_score for r in got]
    assert len(scores) == 300 and abs(sum(scores) / 300 - blocked) < 0.2
