import pytest
from pyspark.sql import functions as F

from pagemill.operators import pages as whole
from pagemill.operators import records, rows
from pagemill.operators.presets import PRESETS, selector_of

BOOKS = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>All
 books &amp; more</title><meta NAME="Description" content=" A demo "></head><body>
<header><ul><li><a href="/one-entry">First entry</a><li><a href="/two-entry">Second entry</a><li><a href="/x-entry">Third entry</a></ul></header>
<h1>All books</h1><h2> </h2>
<section>
<article class="product_pod"><h3><a href="p1" title="Book One">Book One Title</a></h3>
  <p class="price_color">£10.00</p><img src="/img/1.jpg" alt="Book One"></article>
<article class="product_pod"><h3><a href="/p2?x=1">Book Two</a></h3>
  <p class="price_color">£20.00</p><img data-src="../2.jpg" alt=""></article>
<article class="product_pod"><h3><a href="#">Read more</a></h3><strong>Book Three</strong>
  <p class="price_color">£30.00</p><img srcset="/3.jpg 1x, /4.jpg 2x"></article>
</section><a href="mailto:a@b">mail</a><a href="http://else.example.org/"><img alt="Else"></a><a aria-label="Name" href=" /n ">*</a>
<a name="none">no href</a><li class="next"><a rel="next" href="page-2.html">next</a></li></body></html>"""
URL = "https://books.example.com/cat/list"


@pytest.fixture
def books(page):
    return page(BOOKS, URL)


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()]


def test_header(books, page):
    assert tuples(rows.page_header(books), "title", "description", "lang") == [("All books & more", "A demo", "en")]
    assert tuples(rows.page_header(page("<p>x")), "title", "description", "lang") == [("", "", "")]


def test_links(books):
    got = tuples(rows.extract_links(books), "text", "href", "type")
    site = "https://books.example.com"
    assert got == [
        ("First entry", f"{site}/one-entry", "internal"), ("Second entry", f"{site}/two-entry", "internal"),
        ("Third entry", f"{site}/x-entry", "internal"), ("Book One Title", f"{site}/cat/p1", "internal"),
        ("Book Two", f"{site}/p2?x=1", "internal"), ("Read more", "#", "anchor"), ("mail", "mailto:a@b", "mailto"),
        ("Else", "http://else.example.org/", "external"), ("Name", f"{site}/n", "internal"),
        ("next", f"{site}/cat/page-2.html", "internal"),
    ]


def test_images(books, page):
    assert tuples(rows.extract_images(books), "src", "alt", "alt_state") == [
        ("https://books.example.com/img/1.jpg", "Book One", "ok"), ("https://books.example.com/2.jpg", "", "empty"),
        ("", "", "missing"), ("", "Else", "ok"),
    ]
    long = page('<img src="data:image/png;base64,' + "A" * 100 + '" width=3>')
    assert [len(x[0]) for x in tuples(rows.extract_images(long), "src")] == [122]


def test_headings(books):
    assert tuples(rows.extract_headings(books), "level", "text")[:2] == [(1, "All books"), (3, "Book One Title")]


def test_groups(books):
    got = tuples(records.find_item_groups(books), "rank", "count", "selector")
    assert got == [(1, 3, "html > body > section > article.product_pod"), (2, 3, "html > body > header > ul > li")]
    scores = [r.score for r in records.find_item_groups(books).collect()]
    med = len("Book One Title £10.00")
    assert scores[0] == round(3 * med**0.5 * 5, 1)
    assert scores[1] == round(3 * len("Third entry") ** 0.5 * 2 * 0.15, 1)
    assert records.find_item_groups(books, min_items=4).count() == 0
    assert records.best_item_group(books).count() == 1


def test_items_by_group_and_selector(books):
    site = "https://books.example.com"
    expected = [
        (1, "Book One Title", "£10.00", f"{site}/cat/p1", f"{site}/img/1.jpg"),
        (2, "Book Two", "£20.00", f"{site}/p2?x=1", f"{site}/2.jpg"),
        (3, "Book Three", "£30.00", "", f"{site}/3.jpg"),
    ]
    columns = ("index", "title", "price", "link", "image")
    assert tuples(records.extract_items(books), *columns) == expected
    chosen = records.extract_items(books, item_selector="section article")
    assert tuples(chosen, *columns) == expected
    assert tuples(records.extract_items(books), "text")[0] == ("Book One Title | £10.00",)
    with pytest.raises(ValueError):
        records.extract_items(books, item_selector="article[")


def test_selector_notes(books):
    def note(**kw):
        return records.item_selectors(books, **kw).first()

    assert note(preset="books").selector == "article.product_pod  (preset:books)"
    assert note(preset="shopify").selector == "html > body > section > article.product_pod  [auto-fallback]"
    assert note(item_selector=".nothing").selector.endswith("[auto-fallback]")
    assert note(item_selector="h1").n_items == 1
    assert note(preset="auto").selector == "html > body > section > article.product_pod"


def test_presets():
    assert len(PRESETS) == 8
    assert selector_of("books", "item_selector") == "article.product_pod"
    with pytest.raises(ValueError, match="nope"):
        selector_of("nope", "item_selector")


def test_book_cards_and_product(books, page):
    cards = tuples(records.extract_book_cards(books), "title", "price", "link", "image")
    assert cards[0] == ("Book One", "£10.00", "https://books.example.com/cat/p1", "https://books.example.com/img/1.jpg")
    assert cards[1][3] == ""
    html = """<h1>Fancy Widget</h1><p class="price">$49.99</p><div class="description">A very fine widget.</div>
      <img src="data:x"><img src="/img/w.jpg">"""
    url = "https://shop.example.com/p/1"
    got = tuples(records.extract_product(page(html, url)), "title", "price", "link", "image", "text")
    assert got == [("Fancy Widget", "$49.99", url, "https://shop.example.com/img/w.jpg", "A very fine widget.")]
    assert tuples(records.extract_product(page("<p>", url)), "title", "price", "link") == [("", "", url)]


def test_next(spark):
    base = "https://s.example.com/a/"
    cases = [
        ('<a rel="prev next" href="b">x</a>', base + "b"),
        ('<link rel=next href="/c">', "https://s.example.com/c"),
        ('<a href="d">Older posts</a>', base + "d"),
        ('<a href="e" aria-label="Go to NEXT">2</a>', base + "e"),
        ('<a href="f" class="btn Next">2</a>', base + "f"),
        ('<li class="is-disabled"><a rel="next" href="g">n</a></li>', ""),
        ('<a rel="next" aria-disabled="true" href="g">n</a>', ""),
        ('<a rel="next" href="javascript:go()">n</a>', ""),
        ("<a href='h'>nothing</a>", ""),
    ]
    df = spark.createDataFrame(
        [(i, base, h) for i, (h, _) in enumerate(cases)], "page_id bigint, url string, html string"
    )
    got = {r.page_id: r.next_url for r in records.find_next(df).collect()}
    assert [got[i] for i in range(len(cases))] == [u for _, u in cases]
    shop = spark.createDataFrame(
        [(1, base, '<div class="pagination__item--next"><a href="p2">2</a></div>')],
        "page_id bigint, url string, html string",
    )
    assert records.find_next(shop, "shopify").first().next_url == base + "p2"
    assert records.find_next(shop).first().next_url == ""


def test_tables(page):
    html = """<table><caption>C</caption><tr><th>A</th><th> </th></tr><tr><td>1</td></tr><tr></tr>
      <tr><td><table><tr><td>in</td><td>ner</td></tr><tr><td>2</td></tr></table></td><td>x</td></tr></table>
      <table><tr><td>1</td><td>2</td></tr></table><table><tr><td>1</td></tr><tr><td>2</td></tr></table>"""
    tables = records.extract_tables(page(html))
    got = tuples(tables, "table_no", "caption", "header", "rows")
    assert got[0][:2] == (1, "C")
    assert got[0][2] == ["A", "", "", "", ""]
    assert got[0][3][0] == ["1", "", "", "", ""]
    assert got[1] == (2, "", ["col_1", "col_2"], [["in", "ner"], ["2", ""]])
    cells = tuples(records.table_cells(tables).where("table_no = 1 and row_no = 1"), "col_name", "cell")
    assert cells == [("A", "1"), ("col_2", ""), ("col_3", ""), ("col_4", ""), ("col_5", "")]


def test_whole_page_equals_the_single_operators(books):
    run = whole.extract_pages(books).cache()
    assert tuples(whole.family(run, "links"), "text", "href", "type", "status", "detail") == tuples(
        rows.extract_links(books), "text", "href", "type", "status", "detail"
    )
    assert whole.family(run, "items").collect() == records.extract_items(books).collect()
    assert whole.family(run, "images").collect() == rows.extract_images(books).collect()
    assert whole.family(run, "headings").collect() == rows.extract_headings(books).collect()
    assert run.first().next_url == "https://books.example.com/cat/page-2.html"
    with pytest.raises(KeyError):
        whole.family(run, "nothing")
    with pytest.raises(KeyError):
        whole.extract_pages(books, kind="nothing")
    for kind, n in [("product", 1), ("books", 3)]:
        assert whole.family(whole.extract_pages(books, kind=kind), "items").count() == n


def test_partitioning_does_not_matter(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one = records.extract_items(pages.coalesce(1)).collect()
    many = records.extract_items(pages.repartition(7)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def plain_groups(html):
    """Groups of a page without voids and implied ends, by the standard library."""
    from html.parser import HTMLParser

    stack, groups = [["", [], ""]], {}

    class Tree(HTMLParser):
        def handle_starttag(self, tag, attrs):
            node = {"tag": tag, "text": "", "link": tag == "a", "cls": dict(attrs).get("class"), "nav": tag == "nav", "path": ""}
            above = stack[-1] if isinstance(stack[-1], dict) else None
            node["path"] = f"{above['path']} > {tag}" if above else tag
            node["nav"] |= bool(above and above["nav"])
            if above:
                own = f"{above['path']} > {tag}" + (f".{node['cls']}" if node["cls"] else "")
                groups.setdefault((id(above), own), (above, []))[1].append(node)
                for up in stack[1:]:
                    up["link"] |= tag == "a"
            stack.append(node)

        def handle_endtag(self, tag):
            stack.pop()

        def handle_data(self, data):
            for up in stack[1:]:
                up["text"] += data

    Tree().feed(html)
    out = []
    for (_, own), (above, members) in groups.items():
        lens = sorted(len(m["text"]) for m in members)
        if len(members) >= 3 and lens[len(lens) // 2] >= 8:
            links = sum(m["link"] for m in members) / len(members)
            score = len(members) * min(lens[len(lens) // 2], 300) ** 0.5 * (1 + links) * (0.15 if above["nav"] else 1)
            out.append((len(members), round(score, 1), own))
    return sorted(out, key=lambda g: -g[1])


def test_query_returns_all_groups(spark, tmp_path):
    from pagemill.plans.registry import QUERIES

    menu = "".join(f'<li><a href="/{n}">Menu entry {n}</a></li>' for n in range(4))
    cards = "".join(f'<article class="card"><p>Text of card number {n}</p></article>' for n in range(5))
    words = "".join(f"<span>a longer span {n}</span>" for n in range(3)) + "<b>one</b><b>two</b><b>six</b>"
    html = f"<html><body><nav><ul>{menu}</ul></nav><main>{cards}</main><section>{words}</section></body></html>"
    spark.createDataFrame([(1, "https://a.example.com/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["count"], float(r.score), r.selector) for r in QUERIES["item_groups"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == plain_groups(html) and len(got) == 3
