import re

from vellum.llm import url_filter

SCHEMA = "page_id bigint, url string, html string"


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = [(len(r), v == "allow", r, v) for r, v in url_filter.RULES
            if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0]))
            and path.startswith("/" + r.partition("/")[2])]
    best = max(fits, default=None)
    return host, path, best and best[2], best and best[3]


URLS = ["http://a.net/x", "https://example.net/en/1", "HTTP://EXAMPLE.NET/en", "http://b.example.com/de/?q#f", None, "", "nohost",
        "http://net", "http://org.net/", "http://xnet/", "https://fr.org/fr/a?x=1", "ftp://org/fr", "http://h?x://y", "://a.net/",
        "http://é.net/", "http://a.b.c.org/fr//", "http://example.com#/de/", "a://b://c.net/"]


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], SCHEMA)
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.rule_table(spark)).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_blocks_reach_aliases_and_allow_has_precedence(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [(1, "http://a.io/1", link.format("http://b.io/x")), (2, "http://b.io/x", '<meta http-equiv="refresh" content="0;url=/y">'),
            (3, "https://b.io/y/", link.format("http://bad.net/z")), (4, "http://bad.net/z", ""),
            (5, "http://c.io/1", link.format("http://other.net/q")), (6, "http://other.net/q", None),
            (7, "http://www.org/fr/p", link.format("http://c.io/1")), (8, "http://a.io/1#top", ""), (9, "http://d.io/", None),
            (9, "http://d.io/", None), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.page_id), r.verdict) for r in url_filter.judge(df, url_filter.rule_table(spark)).collect())
    assert got == [("1", "block"), ("2", "block"), ("3", "block"), ("4", "block"), ("5", "allow"), ("6", "block"),
                   ("7", "allow"), ("8", "block"), ("9", "allow"), ("9", "allow"), ("None", "allow")]
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark)).collect() == []


def test_targets_that_are_no_rows_are_judged(spark):
    link, meta = '<link rel="canonical" href="{}">', '<meta http-equiv=refresh content="0; url={}">'
    rows = [(1, "http://a.io/1", meta.format("http://bad.net/z")),
            (2, "http://b.io/1", link.format("http://same.net/q")), (3, "http://c.io/1", meta.format("http://same.net/q/")),
            (4, "http://d.io/1", link.format("http://bad.net/") + link.format("http://org/fr/x")),      # allow wins
            (5, "http://e.io/1", link.format("http://f.io/x") + link.format("http://bad.net/y")),       # the second link
            (6, "http://example.com/en/a/b", link.format("../../de/x")), (7, "http://example.com/en/c", meta.format("x")),
            (8, "http://g.io/1", '<base href="http://example.com/de/">' + link.format("y")),
            (9, "http://h.io/1", "<link rel='nofollow canonical' href='//bad.net/w'>"),
            (10, "http://k.io/1", link.format("mailto:x@bad.net") + link.format("?q=1&amp;r=2")),
            (11, "http://m.io/1", link.format("http://example.net/en/")), (12, None, link.format("http://bad.net/")),
            (13, "http://example.org/de/p", link.format("./q/../../../de/r?s#t"))]
    df = spark.createDataFrame(rows, SCHEMA)
    rules = url_filter.rule_table(spark, url_filter.RULES + [("example.org/de/r", "block")])
    got = {r.page_id: r for r in url_filter.judge(df, rules).collect()}
    assert {i: r.verdict for i, r in got.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "block",
        10: "allow", 11: "allow", 12: "allow", 13: "block"}
    assert got[2].component == got[3].component and got[10].component == "k.io/1"


def test_components_equal_union_find(spark):
    import random

    from vellum.llm.common import components
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {(r.node, r.component) for r in got} == {(x, find(x)) for x in linked} and len(got) == len(linked)
