"""URL rules against a plain loop, templates on hosts whose trees are known."""

import re

from emberline.llm.queries import URL_RULES
from emberline.llm.urls import judge


def plainly(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fitting = [(len(r), r) for r, _ in URL_RULES if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fitting)[1] if fitting else None


HARD = [
    None, "", "no scheme", "://", "http://", "http://A.COM", "http://a.com/", "HTTP://Www.Example.COM/en/x", "http://www.example.com/EN/x", "http://b.example.com/en/", "http://example.com/en", "http://notexample.com/en/1",
    "http://com/", "http://net/es/1", "http://a.net/es", "http://a.net/es/2?x=/fr/", "http://a.net/fr/#y", "http://a.net?/es/", "http://É.net/fr/é", "a://b://c.com/d", "http://a.org/" + "x/" * 50_000, "http://a.org/" + "7" * 100_000, "http://h.org\n/en/\nx", "http://a.net/es/1", "http://a.net/es/1",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", None) for i, u in enumerate(HARD)] + [(None, "http://a.net/es/9", "x", None)], "page_id bigint, url string, host string, verdict string")
    got = judge(pages, URL_RULES).collect()
    assert len(got) == len(HARD) + 1
    for r in got:
        host, path = plainly(HARD[r.page_id] if r.page_id is not None else "http://a.net/es/9")
        assert (r.host, r.path, r.rule) == (host, path, rule_of(host, path)), r
        assert r.verdict == (dict(URL_RULES)[r.rule] if r.rule else r.verdict) and r.verdict in ("allow", "block")


def verdicts(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    return {urls[r.page_id]: r for r in judge(pages, rules).collect()}


def test_rare_segments_become_a_wildcard_that_labels_reach(spark):
    rules = [("s.org/user/a", "block"), ("t.org/", "allow")]
    bad = [f"http://s.org/user/a{chr(98 + i)}/post" for i in range(20)]
    new = ["http://s.org/user/zed/post"]
    good = [f"http://s.org/about/{x}" for x in ("team", "jobs")] + [f"http://t.org/{i}" for i in range(30)]
    got = verdicts(spark, bad + new + good, rules)
    assert got[new[0]].template == "/user/*/post" and got[new[0]].rule is None and got[new[0]].verdict == "block"
    assert all(got[u].verdict == "allow" for u in good)


def test_like_branches_merge_and_unlike_ones_stay_apart(spark):
    rules = [("s.org/es/", "block"), ("s.org/fr/", "block"), ("s.org/en/", "allow"), ("t.org/", "allow")]
    es, fr, en = ([f"http://s.org/{x}/{i}" for i in range(40)] for x in ("es", "fr", "en"))
    odd = [f"http://s.org/img/{i}/large/{j}.png" for i in range(5) for j in range(8)]
    few = [f"http://s.org/pt/{i}" for i in range(6)]
    got = verdicts(spark, es + fr + en + odd + few, rules)
    assert got[en[0]].template == "/en/{n}"
    assert got[odd[0]].template.startswith("/img/") and got[odd[0]].verdict == "allow"
    assert got[few[0]].verdict == "allow"


def test_a_template_with_few_labels_is_allowed(spark):
    got = verdicts(spark, ["http://s.net/es/1"] + [f"http://s.net/en/{i}" for i in range(200)] + [f"http://g.com/{i}" for i in range(50)], URL_RULES)
    assert got["http://s.net/es/1"].verdict == "block" and got["http://s.net/en/1"].verdict == "allow"


def test_all_ways_of_joining_agree(spark, monkeypatch):
    from emberline.llm import common

    urls = [f"http://h{i % 3}.net/{x}/{i}" for i in range(60) for x in ("es", "en", f"u{chr(97 + i % 26)}")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    first = sorted(map(tuple, judge(pages, URL_RULES).collect()))
    monkeypatch.setattr(common, "bounded", lambda df, max_bytes=0: df)
    for most in (50_000, 7):
        monkeypatch.setattr(common, "AT_MOST", most)
        assert sorted(map(tuple, judge(pages, URL_RULES).collect())) == first


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], "page_id bigint, url string"), URL_RULES).count() == 0
