"""URL filter: parsing and rules against plain Python, and the classifier on held-out urls."""

import re

from tickwise.llm import url_filter
from tickwise.llm.queries import ALLOWED, BLOCKED, RULES

URLS = ["http://a.example.com/en/1?x=://y", "https://WWW.Example.com/en/9#top", "ftp://example.com", "https://b.net/es/3",
        "https://net/fr/", "http://x.net?q=/es/", "example.com/en/", "", None, "://", "http://user@h.org:80/p//q?r",
        "http://notexample.com/en/1", "https://É.example.COM/en/", "http://example.com/EN/1", "a://b://c/d",
        "https://" + "x" * 5000 + ".net/es/" + "y" * 9000, "http://m.example.com/\n/en/", "http:///path", "http://com/"]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", "", None
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1])
    best = None
    for rule, verdict in RULES:
        at, path = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and m[2].startswith("/" + path):
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    return host, m[2], best and best[1:]


def labelled(spark, urls=None):
    rows = [("https://" + u, 1) for u in BLOCKED] + [("https://" + u, 0) for u in ALLOWED]
    return spark.createDataFrame([r for r in rows if urls is None or r[0] in urls], "url string, blocked int")


def test_matches_plain_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "x"), (3, URLS[3], "x"), (3, URLS[3], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, score string")
    got = url_filter.judge(pages, url_filter.rule_table(spark, RULES), labelled(spark)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *plain(u)[:2], str(plain(u)[2] and plain(u)[2][0])) for i, u, _ in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == want
    verdicts = dict(RULES)
    assert all(r.verdict == (verdicts[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow") for r in got)


def test_classifier_generalises(spark):
    urls = [r.url for r in labelled(spark).collect()]
    train = {u for i, u in enumerate(urls) if i % 4}
    model = url_filter.train(labelled(spark, train).select(
        *(c.alias(n) for c, n in zip(url_filter.host_and_path(url_filter.F.col("url")), ("host", "path"), strict=True)),
        "blocked"))
    host, path = url_filter.host_and_path(url_filter.F.col("url"))
    rest = labelled(spark, set(urls) - train).select(host.alias("host"), path.alias("path"), "blocked")
    scored = url_filter.blocked_score(rest, model).collect()
    assert sum((r.score >= 0.5) == (r.blocked == 1) for r in scored) >= 0.7 * len(scored)


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "url string, blocked int")
    pages = spark.createDataFrame([(1, "http://q.org/")], "page_id long, url string")
    rules = url_filter.rule_table(spark, RULES)
    assert url_filter.judge(pages, rules, none).first().verdict == "allow"
    assert url_filter.judge(pages.limit(0), rules, labelled(spark)).count() == 0
