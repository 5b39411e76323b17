"""Pages, payloads and graphs that Spark derives from the given tables.

The tables hold no shop pages, forms or JSON responses, so the record, rule and JSON operators run
on markup written from their rows: what must come out again is known.  Each page holds a fixed
number of rows, so pages stay small and their number grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_netloc, url_scheme
from ..operators.links import link_candidates
from ..operators.rows import extract_links
from ..sources.readers import read_pages, spread

SHOP = "https://shop.example.com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For work on the processor: a table of fewer splits than cores is dealt over them."""
    return spread(table(spark, sf_dir, name))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def text(*parts) -> Column:
    """Concatenation; plain strings are themselves."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def money(c: str) -> Column:
    return F.concat(F.lit("£"), F.col(c).cast("decimal(12,2)").cast("string"))


def gathered(rows: DataFrame, page_id: Column, order: str, piece: Column) -> DataFrame:
    """``page_id, body``: the pieces of each page in order.  The callers put at most 40 rows on a
    page.  One shuffle, whose partitions are kept for the work on the pages."""
    spark = rows.sparkSession
    width = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    cut = rows.select(
        page_id.cast("bigint").alias("page_id"), F.struct(F.col(order).alias("k"), piece.alias("s")).alias("r")
    )
    pieces = F.array_sort(F.collect_list("r"))
    return (
        cut.repartition(width, "page_id")
        .groupBy("page_id")
        .agg(F.array_join(F.transform(pieces, lambda r: r.s), "").alias("body"))
    )


def document(body: DataFrame, url: Column, html: Column) -> DataFrame:
    return body.select("page_id", url.alias("url"), html.alias("html"))


# ---------------------------------------------------------------- catalog


def _card(link: Column) -> Column:
    return text(
        '<article class="product_pod"><h3><a href="', link, '">', F.col("p_name"), " ",
        F.col("p_brand"), " no. ", F.col("p_partkey"), '</a></h3><p class="price_color">',
        money("p_retailprice"), '</p><img src="/img/', F.col("p_partkey"), '.jpg" alt="',
        F.col("p_name"), '"></article>',
    )


def _listing(body: DataFrame) -> DataFrame:
    n = F.col("page_id")
    html = text(
        '<!doctype html><html lang="en"><head><title>Shop page ', n,
        '</title><meta name="description" content="Parts of page ', n,
        '"></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><h1>Parts page ', n,
        "</h1><section>", F.col("body"), '</section><a rel="next" href="/list/', n + 1,
        '">next</a></body></html>',
    )
    return document(body, text(SHOP, "/list/", n), html)


def catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty cards per page, one per part."""
    k = F.col("p_partkey")
    return _listing(
        gathered(
            table(spark, sf_dir, "part"), F.floor(k / 20), "p_partkey", _card(text("/item/", k))
        )
    )


def catalog_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, and every fifth part once more on a later page with another query string."""
    k = F.col("p_partkey")
    again = gathered(
        table(spark, sf_dir, "part").where(k % 5 == 0),
        1000000 + F.floor(k / 100),
        "p_partkey",
        _card(text("/item/", k, "?ref=again")),
    )
    return catalog_pages(spark, sf_dir).unionByName(_listing(again))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per part; every seventh has no price, and the first picture is inline data."""
    k = F.col("p_partkey")
    html = text(
        '<html lang="en"><head><title>', F.col("p_name"), "</title></head><body><h1>",
        F.col("p_name"), " ", k, "</h1>",
        F.when(k % 7 == 0, "").otherwise(text('<p class="Price-now">', money("p_retailprice"), "</p>")),
        '<img src="data:image/png;base64,AAAA"><img data-src="/img/', k,
        '.jpg" alt="x"><div class="item-description">', F.col("p_type"), " part by ",
        F.col("p_brand"), "</div></body></html>",
    )
    return spread_table(spark, sf_dir, "part").select(
        k.alias("page_id"), text(SHOP, "/p/", k).alias("url"), html.alias("html")
    )


def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per part; the way to the next page is marked in eight ways."""
    k = F.col("p_partkey")
    href = text('href="../n/', k + 1, '"')
    kind = k % 8
    mark = (
        F.when(kind == 0, text('<a rel="nofollow next" ', href, ">go</a>"))
        .when(kind == 1, text('<link rel="next" ', href, ">"))
        .when(kind == 2, text("<a ", href, ">Next »</a>"))
        .when(kind == 3, text('<a aria-label="Next page" ', href, ">2</a>"))
        .when(kind == 4, text('<a class="btn next" ', href, ">2</a>"))
        .when(kind == 5, text('<li class="disabled"><a rel="next" ', href, ">next</a></li>"))
        .when(kind == 6, '<a rel="next" href="mailto:a@b.example">next</a>')
        .otherwise("<a href='/other'>other</a>")
    )
    return spread_table(spark, sf_dir, "part").select(
        k.alias("page_id"),
        text(SHOP, "/list/", k).alias("url"),
        text("<html><head></head><body><ul>", mark, "</ul></body></html>").alias("html"),
    )


# ---------------------------------------------------------------- pages with faults


def faulty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty blocks per page with faults by the part's number."""
    k = F.col("p_partkey")
    alt = F.when(k % 2 == 0, "").when(k % 4 == 1, ' alt=" "').otherwise(text(' alt="', F.col("p_name"), '"'))
    link = F.when(k % 2 == 1, text('<a href="/x/', k, '"> </a>')).otherwise(
        text('<a href="#">jump ', k, "</a>")
    )
    button = (
        F.when(k % 5 == 0, '<button class="b"></button>')
        .when(k % 5 == 1, '<button title="t"></button>')
        .otherwise("<button>Go</button>")
    )
    field = (
        F.when(k % 6 == 0, text('<input name="f', k, '">'))
        .when(k % 6 == 1, text('<input placeholder="p" name="f', k, '">'))
        .when(k % 6 == 2, text('<label for="f', k, '">L</label><input id="f', k, '">'))
        .when(k % 6 == 3, text('<label>in <input name="f', k, '"></label>'))
        .when(k % 6 == 4, '<input type="hidden">')
        .otherwise('<select aria-label="s"></select>')
    )
    block = text(
        '<div id="c', k % 37, '"><img src="/img/', k, '.jpg"', alt, ' width="10">', link, button, field, "</div>"
    )
    n = F.col("page_id")
    body = gathered(table(spark, sf_dir, "part"), F.floor(k / 40), "p_partkey", block)
    title = (
        F.when(n % 3 == 0, "")
        .when(n % 3 == 1, text("<title>", F.repeat(F.lit("long title "), 8), n, "</title>"))
        .otherwise("<title>short</title>")
    )
    html = text(
        "<html", F.when(n % 4 == 0, "").otherwise(' lang="en"'), "><head>", title,
        F.when(n % 2 == 0, "").otherwise('<meta name="Description" content=" d ">'),
        "</head><body>",
        F.when(n % 3 == 1, "<h1>one</h1>").when(n % 3 == 2, "<h1>one</h1><h1>two</h1>").otherwise(""),
        F.col("body"), "</body></html>",
    )
    return document(body, text(SHOP, "/faults/", n), html)


def faulty_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty cards per page: pairs share a link, every fourth has no title, odd pages no prices."""
    k = F.col("p_partkey")
    page = F.floor(k / 20)
    card = text(
        '<li class="card"><a href="/p/', F.floor(k / 2), '">',
        F.when(k % 4 == 0, "").otherwise(text(F.col("p_name"), " ", k)), "</a><em>",
        F.when(page % 2 == 1, "on request").otherwise(money("p_retailprice")), "</em></li>",
    )
    body = gathered(table(spark, sf_dir, "part"), page, "p_partkey", card)
    n = F.col("page_id")
    html = text("<html><head></head><body><ul>", F.col("body"), "</ul></body></html>")
    return document(body, text(SHOP, "/cards/", n), html)


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten customers per page in an HTML table; even pages have a header row, and every page a row
    that is too short."""
    k = F.col("c_custkey")
    row = text(
        "<tr><td>", k, "</td><td>", F.col("c_name"), "<td> ", F.col("c_mktsegment"), "\n</td></tr>"
    )
    body = gathered(table(spark, sf_dir, "customer"), F.floor(k / 10), "c_custkey", row)
    n = F.col("page_id")
    html = text(
        "<html><body><table><caption>Customers <b>", n, "</b></caption>",
        F.when(n % 2 == 0, "<tr><th>key</th><th>name</th><th></th></tr>").otherwise(""),
        F.col("body"), "<tr><td>end</td></tr></table><table><tr><td>alone</td></tr></table></body></html>",
    )
    return document(body, text(SHOP, "/customers/", n), html)


def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty parts per page, marked up in a way an audit finds easy, medium or hard."""
    k = F.col("p_partkey")
    page = F.floor(k / 20)
    card = (
        F.when(page % 4 == 2, "")
        .when(page % 4 == 1, text('<div class="item-box v', k % 20, '">', F.col("p_name"), " for sale</div>"))
        .otherwise(text('<article class="card">', F.col("p_name"), " for sale</article>"))
    )
    body = gathered(table(spark, sf_dir, "part"), page, "p_partkey", card)
    n = F.col("page_id")
    html = text(
        "<html><body><main>", F.col("body"), "</main>",
        F.when(n % 4 == 2, '<form action="/Login"><input name="u"></form>')
        .when(n % 4 == 3, '<iframe src="https://www.google.example/reCAPTCHA/api"></iframe>')
        .otherwise(""),
        F.when(n % 3 == 0, "<a href='/2'> <b>Next</b></a>").when(n % 3 == 1, "<a href='/2'> More </a>").otherwise(""),
        "</body></html>",
    )
    host = F.when(n % 11 == 10, "https://www.amazon.example/s/").otherwise(SHOP + "/a/")
    return document(body, text(host, n), html)


def platform_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per part with marks of platforms, ties and platforms without preset included."""
    k = F.col("p_partkey")
    kind = k % 8
    mark = (
        F.when(kind == 0, '<script src="https://CDN.Shopify.com/x.js"></script>')
        .when(kind == 1, '<link href="/wp-content/plugins/woocommerce/a.css">')
        .when(kind == 2, '<link href="/wp-content/themes/a.css"><link href="/wp-includes/b.js">')
        .when(kind == 3, '<i data-mage="Magento_X"></i><img src="/static/version12/frontend/a.png">')
        .when(kind == 4, '<div class="sqs-block-x x-wix-y"></div>')
        .when(kind == 5, '<link href="https://cdn3.bigcommerce.com/s-1/a.css">')
        .when(kind == 6, '<a href="image/a.png">i</a>')
        .otherwise("")
    )
    return spread_table(spark, sf_dir, "part").select(
        k.alias("page_id"),
        text(SHOP, "/c/", k).alias("url"),
        text("<html><head>", mark, "</head><body>", F.col("p_name"), "</body></html>").alias("html"),
    )


def preset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cards per page in the markup of the page's platform."""
    k = F.col("p_partkey")
    page = F.floor(k / 3)
    name = text(F.col("p_name"), " ", k)
    cost = money("p_retailprice")
    shopify = text(
        '<div class="product-card"><a href="/x">more</a><a class="product-card__link" href="/products/', k,
        '"></a><h3 class="product-card__title">', name, '</h3><b class="price">', cost, "</b></div>",
    )
    woo = text(
        '<li class="product"><a href="/products/', k, '"><h2>', name, "</h2></a><bdi>", cost, "</bdi></li>"
    )
    other = text(
        '<p class="box"><a href="/products/', k, '"><strong>', name, "</strong></a> now <i>", cost, "</i></p>"
    )
    card = F.when(page % 3 == 0, shopify).when(page % 3 == 1, woo).otherwise(other)
    body = gathered(table(spark, sf_dir, "part"), page, "p_partkey", card)
    n = F.col("page_id")
    head = F.when(n % 3 == 0, '<script src="//cdn.shopify.com/a.js"></script>').when(
        n % 3 == 1, '<link href="/wp-content/plugins/woocommerce/a.css">'
    ).otherwise("")
    html = text(
        "<html><head>", head, "</head><body><h1>List</h1>",
        F.when(n % 3 == 1, '<ul class="products">').otherwise("<div>"), F.col("body"),
        F.when(n % 3 == 1, "</ul>").otherwise("</div>"), "</body></html>",
    )
    return document(body, text(SHOP, "/m/", n), html)


# ---------------------------------------------------------------- JSON


def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with 25 orders each under data.items, and a text among the objects."""
    k = F.col("o_orderkey")
    one = F.to_json(
        F.struct(
            text("order ", k).alias("Name"),
            money("o_totalprice").alias("cost"),
            text("/o/", k).alias("url"),
            F.struct(F.col("o_orderpriority").alias("level"), k.alias("n")).alias("meta"),
            F.col("o_orderstatus").alias("summary"),
        )
    )
    body = gathered(table(spark, sf_dir, "orders"), F.floor(k / 25), "o_orderkey", text(one, ","))
    return body.select(
        F.col("page_id").alias("payload_id"), text('{"data":{"items":["head",', F.col("body"), "null]}}").alias("body")
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies listing ten parts each, in fences; every tenth is not JSON."""
    k = F.col("p_partkey")
    one = F.to_json(
        F.struct(
            F.col("p_name").alias("title"), money("p_retailprice").alias("price"), text("/p/", k).alias("link")
        )
    )
    body = gathered(table(spark, sf_dir, "part"), F.floor(k / 10), "p_partkey", text(",", one))
    n = F.col("page_id")
    listed = text("[", F.substring("body", 2, 1 << 30), "]")
    reply = (
        F.when(n % 10 == 9, text("Sorry: ", listed))
        .when(n % 3 == 0, text("```json\n", listed, "\n```"))
        .when(n % 3 == 1, text('```\n{"items":', listed, "}\n```"))
        .otherwise(text('{"items":[],"data":', listed, "}"))
    )
    return body.select(n.alias("reply_id"), reply.alias("text"))


# ---------------------------------------------------------------- links, sites, graphs


def link_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for every link of the pages, by the length of its URL."""
    return answers(link_candidates(extract_links(pages(spark, sf_dir))).select("href"))


def answers(hrefs: DataFrame) -> DataFrame:
    """An answer for every ``href``, by its length."""
    kind = F.length("href") % 5
    return hrefs.select(
        "href",
        F.when(kind == 0, 200).when(kind == 1, 301).when(kind == 2, 404).when(kind == 3, 403).alias("code"),
        F.when(kind == 4, "Timeout").otherwise("").alias("error"),
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt of the pages' sites, by the length of the site's name; a quarter has none."""
    url = F.col("url")
    sites = table(spark, sf_dir, "pages").select(
        F.concat(url_scheme(url), F.lit("://"), url_netloc(url)).alias("site")
    ).distinct()
    kind = F.length("site") % 4
    plain = "User-agent: *\nDisallow: /en/ # english\n"
    rich = (
        "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /de/\nDisallow: /d\nDisallow: /e\n\n"
        "User-agent: *\nDisallow: /\n"
    )
    return sites.where(kind != 0).select(
        "site",
        F.when(kind == 1, 404).otherwise(200).alias("status"),
        F.when(kind == 2, plain).otherwise(rich).alias("body"),
    )


SITE = "https://site.example.com/n/"


def site_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges and answering URLs of a site with one page per order: k links to 2k+1 and 2k+2, back
    to its parent, and to another host.  Every eleventh page does not answer."""
    k = F.col("o_orderkey")
    nodes = table(spark, sf_dir, "orders").select(k)
    targets = F.array(
        text(SITE, 2 * k + 1, "/"), text(SITE, 2 * k + 2, "#part"), text(SITE, F.floor((k - 1) / 2)),
        text("https://else.example.org/", k),
    )
    edges = nodes.select(
        text(SITE, k).alias("src_url"), F.posexplode(targets).alias("pos", "dst_url")
    )
    return edges, nodes.where(k % 11 != 5).select(text(SITE, k).alias("url"))


CHAIN = "https://chain.example.com/p/"


def next_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, next_url``: k goes on to k+1, every ninth back to k-1, the last to nothing."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey")
    to = F.when(k % 9 == 4, k - 1).otherwise(k + 1)
    known = part.select(k.alias("to"), F.lit(True).alias("known"))
    return (
        part.select("p_partkey", to.alias("to"))
        .join(known, "to", "left")
        .select(
            text(CHAIN, k).alias("url"),
            F.when(F.col("known"), text(CHAIN, F.col("to"))).otherwise("").alias("next_url"),
        )
    )
