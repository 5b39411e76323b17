import html
from html.entities import html5
from urllib.parse import urldefrag, urljoin, urlparse

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import urls as ur


def values(spark, rows, column, schema="v string"):
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def numbered(items):
    return [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items)]


def python_clean(t):
    t = " ".join(t.split())
    return "".join(c for c in t if c.isprintable()).strip()


def test_clean_like_python(spark):
    texts = [
        "  hello\n\tworld  ", "a  b", "zero​width", "a ​ b", "\x1cx\x1f", "", " 　 ",
        "line sep", "tab\tend\x85", "café  olé", "soft­hyphen", "\U0001f600 ok", "ctl\x07bell",
    ]
    assert values(spark, numbered(texts), tx.clean(F.col("v"))) == [python_clean(t) for t in texts]
    joined = F.trim(F.array_join(F.transform(F.split("v", "[|]"), tx.clean_string), " "))
    pieces = ["a|​|b", " | \n|x", "a |​ c|", "||"]
    expected = [python_clean(" ".join(p.split("|"))) for p in pieces]
    assert values(spark, numbered(pieces), joined) == expected


def test_prices(spark):
    cases = {
        "now £10.50 only": "£10.50", "USD 1,200.00": "USD 1,200.00", "12 € net": "12 €", "no price": "",
        "rs. 50": "rs. 50", "7": "", "99RM": "99RM", "PURSD5": "",
    }
    assert values(spark, numbered(cases), tx.price(F.col("v"))) == list(cases.values())
    amounts = {"£1,234.50": 1234.5, "-3": -3.0, "USD 12": 12.0, "about 5 or 6": None, "": None}
    assert values(spark, numbered(amounts), tx.price_amount(F.col("v"))) == list(amounts.values())


def test_labels_and_fences(spark):
    labels = {"Add to Cart": True, "view details": True, "Sign up": True, "More": True, "More books": False}
    assert values(spark, numbered(labels), tx.is_generic_label(F.col("v"))) == list(labels.values())
    fences = {"```json\n[1]\n```": "[1]", "```\n{}\n```": "\n{}\n", " [2] ": "[2]", "```JSON [3]```": "[3]"}
    assert [v.strip() for v in values(spark, numbered(fences), tx.strip_json_fences(F.col("v")))] == [
        v.strip() for v in fences.values()
    ]


def test_entities_like_python(spark):
    texts = ["a &amp; b", "&pound;5 &euro;", "&#233;&#xe9;", "&#128512;", "no & entity", "&unknown; &", "&lt;b&gt;&amp;lt;"]
    assert values(spark, numbered(texts), tx.html_unescape(F.col("v"))) == [html.unescape(t) for t in texts]


def test_severity_and_classes(spark):
    ranks = {"High": 0, "Medium": 1, "Low": 2, "other": 3}
    assert values(spark, numbered(ranks), tx.severity_rank(F.col("v"))) == list(ranks.values())
    suffix = tx.selector_class_suffix(F.split("v", " "))
    assert values(spark, numbered(["a b-c 9x _d x:y"]), suffix) == [".a.b-c._d"]


def test_url_join_like_urllib(spark):
    base = "http://a/b/c/d;p?q"
    refs = (
        "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g "
        "/./g /../g g. ..g ./../g ./g/. g/./h g/../h http:g http://x/../y mailto:a@b"
    ).split() + ["", "x y/é"]
    pairs = [(base, r) for r in refs] + [
        ("http://a", "x"), ("https://h/", "/En"), ("http://a/b//c", "d"), ("file:///x/y.html", "z"),
        ("", "q"), ("http://a/b?x#f", "#"), ("HTTP://A/b", "c"),
    ]
    got = values(spark, numbered(pairs), ur.url_join(F.col("b"), F.col("r")), "b string, r string")
    assert got == [urljoin(b, r) for b, r in pairs]


def test_url_parts_like_urllib(spark):
    urls = [
        "http://User@Host.com:80/a;b/c;d?x=1#f", "//h/p", "/only/path?q", "mailto:a@b", "", "https://h",
        "http://h/p#x#y", "HTTPS://H/P/", "no scheme/x:y", "http://sp ace/x y",
    ]
    for column, part in [
        (ur.url_scheme, lambda u: urlparse(u).scheme),
        (ur.url_netloc, lambda u: urlparse(u).netloc),
        (ur.url_path, lambda u: urlparse(u).path),
    ]:
        assert values(spark, numbered(urls), column(F.col("v"))) == [part(u) for u in urls]
    plain = [u for u in urls if not u.startswith("HTTP")]
    assert values(spark, numbered(plain), ur.url_norm(F.col("v"))) == [
        urldefrag(u)[0].rstrip("/") for u in plain
    ]


def test_link_types(spark):
    cases = {
        "#top": "anchor", "JavaScript:void(0)": "javascript", "mailto:a@b": "mailto", "TEL:1": "tel",
        " /x ": "internal", "http://other/": "external", "//shop.example.com/y": "internal", "": "internal",
    }
    kind = ur.link_type(F.col("v"), F.lit("https://shop.example.com/list"))
    assert values(spark, numbered(cases), kind) == list(cases.values())


def test_single_documents_and_hosts(spark):
    cases = {"http://h/a.html": True, "x.htm": True, "http://h/a": False, "local/file": True}
    assert values(spark, numbered(cases), ur.is_single_document(F.col("v"))) == list(cases.values())
    hosts = {"http://a_b.c:80/": "a_b.c_80", "file:///x": "local"}
    assert values(spark, numbered(hosts), ur.host_label(F.col("v"))) == list(hosts.values())


def test_references_of_any_length(spark):
    texts = ["Levi&apos;s", "&#0000000000000065;", "&#x000000000000041;", "&#99999999999999999999;", "&#0;", "&#x110000;"]
    table = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, v string")
    got = [r.v for r in table.orderBy("n").select(tx.html_unescape(F.col("v")).alias("v")).collect()]
    assert got == ["Levi's", "A", "A", "\ufffd", "\ufffd", "\ufffd"]


def test_all_html_5_references(spark):
    names = sorted(html5)
    texts = [f"a&{n} b" for n in names] + [f"&{n}x&{n.rstrip(';')[:-1]}=1" for n in names]
    texts += [f"&#{n};" for n in [*range(300), 0xFDD0, 0xFDEF, 0xFDF0, 0xD800, 0x110000, 10**11, *(16**4 * k - 2 for k in range(1, 18))]]
    texts += [f"&#x{n:x}" for n in range(300)] + ["&", "&&amp;", "&notit;", "&;", "&#", "&#x;", "&ampamp;", "&a b", "&" + "x" * 40 + ";", "&lt<p>"]
    assert values(spark, numbered(texts), tx.html_unescape(F.col("v"))) == [html.unescape(t) for t in texts]
