import random
from collections import deque
from urllib import robotparser

import pytest
from pyspark.sql import functions as F

from pagemill.operators import classify, crawl, links
from pagemill.operators.joins import salted_join
from pagemill.session import discard, stored

PAGE = "page_id bigint, url string, html string"


def page_rows(spark, htmls, url="https://h/"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], PAGE)


def by_id(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("page_id").collect()]


def test_platforms(spark):
    htmls = [
        '<SCRIPT SRC="HTTPS://CDN.SHOPIFY.COM/X.JS"></SCRIPT>', '<link href="/wp-content/themes/x.css">',
        '<link href="/wp-content/plugins/woocommerce/a.css">', "<p>hello", "<a href=image/x>", "prestashop ps_", "x-wix- sqs-block-",
    ]
    assert by_id(classify.detect_cms(page_rows(spark, htmls)), "preset", "score") == [
        ("shopify", 5), ("wordpress", 3), ("woocommerce", 5), ("generic", 0), ("magento", 5), ("generic", 0), ("wix", 5),
    ]


def test_block_and_thin(spark):
    long = "<p>" + "word " * 60
    late = "<p>" + "word " * 1000 + "access denied"
    htmls = ["<title>Just a moment...</title>" + long, long + "Captcha", long, "<p>short", "<a><a><a><a><input>", late, "<div>" * 900 + "<title>403 Forbidden</title>" + long]
    got = by_id(classify.page_flags(page_rows(spark, htmls)), "blocked", "thin")
    assert got == [(True, False), (True, False), (False, False), (False, True), (False, False), (True, False), (True, False)]
    near_start = page_rows(spark, htmls).select("page_id", classify.is_blocked(F.col("html"), within=4000).alias("blocked"))
    assert [b for b, in by_id(near_start, "blocked")] == [True, True, False, False, False, False, True]


def test_link_status(spark):
    rows = [("a", 200, ""), ("b", 404, None), ("c", 403, ""), ("d", None, "Timeout"), ("e", 399, ""), ("f", 999, ""), ("g", 500, "")]
    responses = spark.createDataFrame(rows, "href string, code int, error string")
    got = {r.href: (r.status, r.detail) for r in links.link_results(responses).collect()}
    assert got == {
        "a": ("OK", "200"), "b": ("BROKEN", "404"), "c": ("RESTRICTED", "403"), "d": ("ERROR", "Timeout"),
        "e": ("OK", "399"), "f": ("RESTRICTED", "999"), "g": ("BROKEN", "500"),
    }
    issues = {(r["where"], r.severity, r.check, r.detail, r.page_id) for r in links.broken_links(responses).collect()}
    assert ("d", "Medium", "Link check failed", "ERROR (Timeout)", None) in issues and len(issues) == 3


def test_check_links_with_a_hot_link(spark):
    found = spark.range(5000).select(
        F.col("id").alias("page_id"), F.lit(1).alias("pos"), F.lit("t").alias("text"),
        F.when(F.col("id") % 3 > 0, "home").otherwise(F.concat(F.lit("u"), "id")).alias("href"), F.lit("internal").alias("type"),
    )
    responses = spark.createDataFrame([("home", 404, ""), ("u3", 200, "")], "href string, code int, error string")
    counts = {r.status: r["count"] for r in links.check_links(found, responses).groupBy("status").count().collect()}
    assert counts == {"BROKEN": 3333, "OK": 1, "": 1666}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    left = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k bigint, v string")
    plain = left.join(right, "k", how)
    for heavy_rows in (10, 1_000):
        joined = salted_join(left, right, "k", how, heavy_rows)
        assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_salted_join_deals_a_hot_key(spark):
    """One key in most rows: no task of the join gets more than its part of them."""
    left = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("0", 2)], "k string, v int").hint("shuffle_hash")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        joined = salted_join(left, right, "k", "left", heavy_rows=1_000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 6_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_robots_like_the_standard_parser(spark):
    bodies = [
        "", "User-agent: *\nDisallow: /", "User-agent: *\nDisallow:", "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow: /a\nAllow: /",
        "user-agent: bot\nUser-Agent: *\n# note\nDISALLOW: /b # tail\nAllow: /b/c\n", "Disallow: /\nUser-agent: *\n\nDisallow: /a",
        "User-agent: *\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /", "User-agent: *\r\nAllow: /b/c\r\nDisallow: /b\r\n",
        "User-agent: *\nDisallow: /a%20b\nDisallow: /q?x=", "User-agent: *\nDisallow: *", "User-agent: *\nDisallow: /a\nUser-agent: other\nDisallow: /",
    ]
    paths = ["/", "", "/a", "/abc", "/b", "/b/c/d", "/a b", "/a%20b", "/q?x=1", "/z#frag"]
    rows = [(n, f"http://h{n}.example.com{p}") for n in range(len(bodies)) for p in paths]
    urls = spark.createDataFrame(rows + [(0, "ftp://h1.example.com/"), (0, "http://none.example.com/")], "n int, url string")
    robots = spark.createDataFrame(
        [(f"http://h{n}.example.com", 200, b) for n, b in enumerate(bodies)], "site string, status int, body string"
    )
    for r in classify.robots_allows(urls, robots).collect():
        parser = robotparser.RobotFileParser()
        parser.parse(bodies[r.n].splitlines() if f"h{r.n}.example.com" in r.url else [])
        assert r.allowed == parser.can_fetch("*", r.url), (bodies[r.n], r.url)
    refused = robots.withColumn("status", F.lit(404))
    assert classify.robots_allows(urls, refused).where("not allowed").count() == 0


def test_known_hard(spark):
    urls = ["https://www.Amazon.com/x", "https://netflix.com", "https://shop.example.org"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r.r for r in df.select(classify.known_hard(F.col("url")).alias("r")).collect()]
    assert got == ["known anti-bot site (amazon)", "known anti-bot site (x.com)", ""]


def test_signals_and_verdicts(spark):
    card = '<article class="card"><a href="/i">Item number one</a></article>'
    htmls = [
        f"<html><body><div>{card * 12}</div><a href='/2'> Next </a></body></html>",
        "<html><body>" + "".join(f'<div class="x-item i{n}">t{n}</div>' for n in range(11)) + "<a rel='next' href=2>2</a></body></html>",
        "<html><body><input type='password'></body></html>",
        f"<html><body><div class='g-Captcha'></div><div>{card * 12}</div><form action='/LOGIN'></form></body></html>",
        "<html><body><a><img>next</a></body></html>",
    ]
    signals = classify.page_signals(page_rows(spark, htmls)).cache()
    assert by_id(signals, "auto_items", "fallback_items", "fallback_selector", "has_next", "has_login", "has_captcha") == [
        (12, 12, "article.card", True, False, False), (0, 11, "div[class*='item']", True, False, False),
        (0, 0, "", False, True, False), (12, 12, "article.card", False, True, True), (0, 0, "", False, False, False),
    ]
    assert signals.where("page_id = 0").first().auto_selector == "html > body > div > article.card"
    labels = by_id(classify.verdict(signals.withColumn("allowed", F.lit(True))), "verdict")
    assert [x for (x,) in labels] == ["EASY", "MEDIUM", "HARD", "DECLINE", "HARD"]
    barred = classify.verdict(signals.withColumn("allowed", F.lit(False)))
    assert {r.verdict for r in barred.collect()} == {"DECLINE"}


def test_fetch_verdict(spark):
    long = "<p>" + "word " * 60
    rows = [(200, long, "auto"), (200, "<p>x", "auto"), (200, "<p>x", "static"), (404, long, "static"), (200, long, "headless"), (503, long, "headless")]
    df = spark.createDataFrame(rows, "status int, html string, mode string")
    assert [r.next_step for r in classify.fetch_verdict(df).collect()] == ["use", "render", "use", "fail", "use", "visible"]


def walk(seed, edges, live, barred, cap, host):
    seen, queue, out = set(), deque([seed]), []
    while queue and len(out) < cap:
        url = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        if url in barred or url not in live:
            continue
        out.append(url)
        queue.extend(v for v in edges.get(url, []) if v.startswith(host))
    return out


@pytest.mark.parametrize("cap", [1000, 9])
def test_crawl_like_a_queue(spark, cap):
    rng = random.Random(5)
    nodes = [f"http://h/{n}" for n in range(40)]
    edges = {u: [rng.choice(nodes + ["http://else/1"]) for _ in range(3)] for u in nodes}
    live, barred = set(nodes) - {nodes[3], nodes[11]}, {nodes[7], nodes[20]}
    rows = [(u, v + ("#f" if i else "/"), i) for u, vs in edges.items() for i, v in enumerate(vs)]
    got = crawl.crawl(
        nodes[0] + "/#top",
        spark.createDataFrame(rows, "src_url string, dst_url string, pos int"),
        spark.createDataFrame([(u,) for u in live], "url string"),
        max_pages=cap,
        disallowed=spark.createDataFrame([(u,) for u in barred], "url string"),
    )
    order = [r.url for r in got.orderBy("visit_no").collect()]
    assert order == walk(nodes[0], edges, live, barred, cap, "http://h/")


def test_crawl_of_nothing(spark):
    none = spark.createDataFrame([], "url string")
    edges = spark.createDataFrame([("http://h/a", "http://h/b", 0)], "src_url string, dst_url string, pos int")
    assert crawl.crawl("http://h/a", edges, none).count() == 0


def test_paginate(spark):
    def urls(*paths):
        return spark.createDataFrame([(p,) for p in paths], "url string")

    rows = [("http://h/1", "http://h/2"), ("http://h/2", "http://h/3"), ("http://h/3", "http://h/1"), ("http://h/x.html", "http://h/2"), ("http://h/9", "")]
    chain = spark.createDataFrame(rows, "url string, next_url string")

    def run(starts, **kw):
        return [(r.page_no, r.url[-1]) for r in crawl.paginate(starts, chain, **kw).orderBy("start", "page_no").collect()]

    assert run(urls("http://h/1"), max_pages=9) == [(1, "1"), (2, "2"), (3, "3")]
    assert run(urls("http://h/1"), max_pages=2) == [(1, "1"), (2, "2")]
    assert run(urls("http://h/x.html", "http://h/9"), max_pages=5) == [(1, "9"), (1, "l")]
    barred = urls("http://h/1", "http://h/3")
    assert run(urls("http://h/1"), max_pages=9, disallowed=barred) == [(1, "1"), (2, "2")]
    assert len(run(urls("http://h/1"), max_pages=9, disallowed=barred, ignore_robots=True)) == 3


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """10,000 pages in a row, a loop behind a tail, and many starts on one page."""
    rounds = []
    monkeypatch.setattr(crawl, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    links = spark.range(1, 10_000).selectExpr("concat('c', id) as url", "concat('c', id + 1) as next_url")
    loop = spark.createDataFrame([("t1", "t2"), ("t2", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), ("t1", "t3")], "url string, next_url string")
    hub = spark.range(300).selectExpr("concat('h', id) as url", "'t1' as next_url")
    starts = spark.createDataFrame([("c1",), ("t1",), ("x",), ("c1",)], "url string").union(hub.select("url"))
    named = [df.select(*[F.concat(F.lit("s://"), c).alias(c) for c in df.columns]) for df in (starts, links.union(loop).union(hub))]
    got = crawl.paginate(*named)
    per_start = {r.start: (r.n, r.last) for r in got.groupBy("start").agg(F.count("*").alias("n"), F.max("page_no").alias("last")).collect()}
    assert per_start["s://c1"] == (10_000, 10_000) and per_start["s://t1"] == (5, 5) and per_start["s://x"] == (1, 1)
    assert all(per_start[f"s://h{n}"] == (6, 6) for n in range(300))
    assert [r.url for r in got.where("start = 's://t1'").orderBy("page_no").collect()] == [f"s://{u}" for u in ("t1", "t2", "a", "b", "c")]
    assert got.where("start = 's://c1' and url = concat('s://c', page_no)").count() == 10_000
    assert rounds.count("pages") < 20


def test_links_lie_where_they_are(spark):
    """A round of the crawl shuffles its frontier, not the links or the pages that answer; heavy sources in parts too."""
    rows = [("hub", f"u{n}", n) for n in range(40)] + [(f"u{n}", "hub", 0) for n in range(40)]
    links = spark.createDataFrame(rows, "src_url string, url string, pos int")
    parents = spark.createDataFrame([("hub", 1), ("u3", 2)], "src_url string, parent bigint")
    graph = crawl.LinkGraph(links, heavy_rows=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = graph.targets(parents)
        assert joined.count() == 41 and joined.select("url").distinct().count() == 41
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the frontier's
    assert graph.links.select("part").distinct().count() == 4
    discard(*graph.tables)
    assert not spark.catalog.listTables(pattern="crawl_links*")


def test_candidates(spark):
    rows = [(2, 1, "http://h/a", "internal"), (1, 2, "http://h/b", "internal"), (1, 1, "http://o/", "external"), (1, 3, "#", "anchor"), (3, 1, "http://h/b", "internal"), (1, 4, "ftp://h/", "internal")]
    found = spark.createDataFrame([(p, n, "", h, t) for p, n, h, t in rows], "page_id bigint, pos int, text string, href string, type string")
    assert [r.href for r in links.link_candidates(found, n=5).orderBy("page_id", "pos").collect()] == ["http://h/b", "http://h/a"]
    assert links.link_candidates(found, external=True).count() == 3
    assert links.link_candidates(found, external=True, n=1).first().href == "http://o/"
    assert links.crawlable_links(found, "h").count() == 3


def test_crawl_from_pages_with_a_redirect(spark):
    rows = [
        ("http://h/a", "http://h/a", '<a href="/old">1</a><a href="b">2</a><a href="#x">3</a>'),
        ("http://h/old", "http://h/new/", '<a href="c">4</a><a href="mailto:x@y.z">5</a>'),
        ("http://h/new/c", None, '<a href="/a">6</a>'),
        ("http://h/b", None, "no links"),
    ]
    pages = spark.createDataFrame(rows, "url string, final_url string, html string")
    edges = crawl.page_edges(pages)
    assert sorted((r.src_url, r.dst_url) for r in edges.collect()) == [
        ("http://h/a", "http://h/b"), ("http://h/a", "http://h/old"), ("http://h/new/c", "http://h/a"), ("http://h/old", "http://h/new/c"),
    ]
    walked = crawl.crawl("http://h/a", edges, pages.select("url")).orderBy("visit_no").collect()
    assert [(r.url, r.depth) for r in walked] == [("http://h/a", 0), ("http://h/old", 1), ("http://h/b", 1), ("http://h/new/c", 2)]
