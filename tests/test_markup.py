from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagemill.functions.markup import VOID_TAGS, with_tokens
from pagemill.operators import records, rows
from pagemill.operators.records import css_path, html_nodes, select_nodes

SF = "/root/testdata/sf0.001"


class Starts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.found.append((tag, first))


def tree(nodes):
    return {r.node_id: r for r in nodes.collect()}


def test_start_tags_like_the_standard_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {}
    for r in html_nodes(pages).orderBy("page_id", "node_id").collect():
        got.setdefault(r.page_id, []).append((r.tag, r.attrs))
    for page in pages.collect():
        parser = Starts()
        parser.feed(page.html)
        assert got[page.page_id] == parser.found


def test_attributes(page):
    html = """<a href='x"y' data-src=/p/q title="a > b &amp; c" HREF=z checked class=" k1  k2 "
        onclick="f('<b>')">t</a><img alt=don't src=i.png/>"""
    nodes = {r.tag: r for r in html_nodes(page(html)).collect()}
    assert nodes["a"].attrs == {
        "href": 'x"y', "data-src": "/p/q", "title": "a > b & c", "checked": "", "class": " k1  k2 ",
        "onclick": "f('<b>')",
    }
    assert nodes["a"].classes == ["k1", "k2"]
    assert nodes["img"].attrs["src"] == "i.png/"


def test_hidden_parts_are_not_text(page):
    html = "<p>a < b<!-- <i>no</i> -->c<script>var t='<u>';</script><style>p{}</style> d&nbsp;e</p><!-- open <q>"
    nodes = html_nodes(page(html)).collect()
    assert [r.tag for r in nodes] == ["p", "script", "style"]
    assert select_nodes(page(html), "p").first().text == "a < b c d e"


def test_implied_ends(page):
    html = (
        "<html><body><p><b>one<br><p>two<ul><li>x<li>y<ul><li>z</ul></ul>"
        "<table><tr><td>1<td>2<tr><th>3</table><div><span>open</div><em>last"
    )
    nodes = tree(html_nodes(page(html)))
    shape = [(r.tag, r.depth, nodes[r.parent_id].tag if r.parent_id >= 0 else "") for r in nodes.values()]
    assert shape == [
        ("html", 1, ""), ("body", 2, "html"), ("p", 3, "body"), ("b", 4, "p"), ("br", 5, "b"),
        ("p", 3, "body"), ("ul", 3, "body"), ("li", 4, "ul"), ("li", 4, "ul"), ("ul", 5, "li"), ("li", 6, "ul"),
        ("table", 3, "body"), ("tr", 4, "table"), ("td", 5, "tr"), ("td", 5, "tr"), ("tr", 4, "table"),
        ("th", 5, "tr"), ("div", 3, "body"), ("span", 4, "div"), ("em", 3, "body"),
    ]


def test_elements_nest(spark):
    """Every element lies inside its parent, and void elements hold nothing."""
    nodes = html_nodes(spark.read.parquet(f"{SF}/pages.parquet")).cache()
    kids = nodes.alias("k").join(
        nodes.alias("p"),
        (F.col("k.page_id") == F.col("p.page_id")) & (F.col("k.parent_id") == F.col("p.node_id")),
    )
    wrong = kids.where("k.node_id <= p.node_id or k.end_pos > p.end_pos or k.depth != p.depth + 1")
    assert wrong.count() == 0
    assert nodes.where(F.col("tag").isin(VOID_TAGS) & (F.col("end_pos") != F.col("node_id"))).count() == 0
    assert nodes.where("parent_id < 0 and tag != 'html'").count() == 0


def test_selectors(page):
    html = """<ul class="products x"><li class="product" data-product-id="7"><a href="/Products/1" rel="a next">A</a>
      <h3 id="t1">H</h3></li></ul><li class="product">out</li><p class="Price-big">£1</p>"""
    p = page(html)
    cases = {
        "li": 2, ".product": 2, "ul.products li.product": 1, "ul li a, #t1": 2, "[data-product-id]": 1,
        "[data-product-id='7']": 1, 'a[rel~="next"]': 1, "a[href*='/products/' i]": 1, "a[href*='/products/']": 0,
        '[class*="price" i]': 1, "li h3, h3, .products h3": 1, "*": 6, "a[href^='/Pro'][href$='1']": 1,
    }
    for selector, n in cases.items():
        assert select_nodes(p, selector).count() == n, selector
    for bad in ["li >", "a[", "p::first", "", "a,"]:
        with pytest.raises(ValueError):
            select_nodes(p, bad)


def test_css_path(page):
    html = '<html><body><div></div><div><ul id="m"><li></li><li><b></b></li></ul><p></p></div></body></html>'
    tokens = with_tokens(page(html))
    paths = tokens.select(F.explode("tokens").alias("t"), "tokens").where("t.tag in ('b', 'p')")
    got = [r.p for r in paths.select(css_path(F.col("tokens"), F.col("t")).alias("p")).collect()]
    assert got == ["ul#m > li:nth-of-type(2) > b", "html > body > div:nth-of-type(2) > p"]


def test_a_very_long_page(page):
    """Work grows with the page, not with its square: 60,000 elements."""
    html = "<html><body>" + "".join(f"<p class='c'>some text {i}<b>x" for i in range(30000)) + "</body></html>"
    assert html_nodes(page(html)).where("tag = 'p' and depth = 3").count() == 30000


def test_unclosed_links_and_headings_as_in_the_tree(page):
    html = (
        '<div><p><a href="/x">hi</p><p>lots of <a href="/y">two</a> other text</p><ul><li><a href="/z">three<li>four</ul>'
        "<h2>Head<p>para one<h3>Next</h3><p>end</div><table><tr><td><a href='/t'>cell<td>next</table>"
    )
    links = [r.text for r in rows.extract_links(page(html)).orderBy("pos").collect()]
    assert links == [r.text for r in records.select_nodes(page(html), "a[href]").collect()]
    assert links[0] == "hi"
    headings = [(r.level, r.text) for r in rows.extract_headings(page(html)).orderBy("pos").collect()]
    assert headings == [(2, "Head para one"), (3, "Next")]
    assert [r.text for r in records.select_nodes(page(html), "h2, h3").collect()] == ["Head para one", "Next"]
