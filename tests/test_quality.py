import random

import pytest

from pyspark.sql import functions as F

from pagemill.operators import pages as whole
from pagemill.operators.classify import strict_gate
from pagemill.operators.quality import repeats, unmatched
from pagemill.operators.summary import sort_issues

CLEAN = (
    '<html lang="en"><head><title>T</title><meta name="description" content="d"></head><body><h1>H</h1>%s</body></html>'
)


def issues(df):
    return {(r.check, r.severity, r.detail, r["where"]) for r in df.collect()}


@pytest.mark.parametrize(
    "operator, markup, expected",
    [
        (whole.qa_header, "", set()),
        (whole.qa_header, "<h1>Two</h1>", {("Multiple <h1>", "Low", "2 h1s found.", "H; Two")}),
        (
            whole.qa_rows,
            '<img src="a.png"><a href="/x"><i></i></a><a href="#"> go</a><a href="javascript:;">j</a>',
            {
                ("Image without alt", "Medium", "<img> has no alt.", "https://shop.example.com/list/a.png"),
                ("Link without accessible name", "Medium", "No text / aria-label / img alt.", "https://shop.example.com/x"),
                ("Placeholder links", "Low", "2 placeholder links.", ""),
            },
        ),
        (
            whole.qa_elements,
            '<button class="b"><i></i></button><button value="v"></button><button><img></button>',
            {("Button without accessible name", "Medium", "No text/aria-label/title.", '<button class="b"><i></i></button>')},
        ),
        (
            whole.qa_elements,
            '<p id="a"></p><p id="b"></p><b id="a"></b><i id="a"></i><i id="b"></i><i id="c"></i>',
            {
                ("Duplicate id", "Medium", 'id="a" used 3 times.', "#a"),
                ("Duplicate id", "Medium", 'id="b" used 2 times.', "#b"),
            },
        ),
        (
            whole.qa_elements,
            '<input name="n"><textarea placeholder="p"></textarea><input type="SUBMIT"><input type="hidden">'
            '<label for="q">Q</label><input id="q"><label>in <select></select></label><input aria-label="x"><input id="">',
            {
                ("Form field without label", "Medium", "No <label>/aria-label.", '<input name="n"/>'),
                ("Form field without label", "Medium", "No <label>/aria-label.", '<input id=""/>'),
                ("Form field without label", "Low", "Only placeholder.", '<textarea placeholder="p"></textarea>'),
            },
        ),
        (
            whole.qa_items,
            "".join(f'<div class="c"><a href="/{n // 2}">{"" if n == 0 else "title %d" % n}</a> and more</div>' for n in range(3)),
            {
                ("Duplicate item link", "Medium", "2 items → same URL.", "https://shop.example.com/0"),
                ("Items without title", "Medium", "1/3 items have no title.", ""),
                ("No prices detected", "Low", "No price pattern in any item.", ""),
            },
        ),
    ],
)
def test_rule(page, operator, markup, expected):
    assert issues(operator(page(CLEAN % markup))) == expected


def test_header_rules(page):
    empty = issues(whole.qa_header(page("<p>x</p>")))
    assert {i[0] for i in empty} == {"Missing <title>", "Missing meta description", "Missing lang attribute", "No <h1>"}
    long = issues(whole.qa_header(page(f"<title>{'t' * 130}</title>")))
    assert ("Long <title>", "Low", "130 chars.", "t" * 130) in long  # texts are not cut


def test_overflow_row(page):
    """All rows, or as many of a kind as asked for and one that counts the rest."""
    pages = page("<img src=x>" * 15 + '<a href="/n"></a>' * 20)
    assert whole.qa_rows(pages).where("check = 'Link without accessible name'").count() == 20
    found = whole.qa_rows(pages, shown=15).collect()
    assert sum(r.check == "Image without alt" for r in found) == 15
    nameless = [r.detail for r in found if r.check == "Link without accessible name"]
    assert len(nameless) == 16 and nameless[-1] == "... +5 more."


def test_gate_and_order(page):
    found = whole.qa_issues(page("<p>x</p>"))
    assert strict_gate(found).first().asDict() == {"high": 1, "failed": True, "exit_code": 3}
    order = [r.severity for r in sort_issues(found).collect()]
    assert order == sorted(order, key=["High", "Medium", "Low"].index)
    assert not strict_gate(whole.qa_header(page(CLEAN % ""))).first().failed


def test_unmatched_and_repeats(spark):
    rng = random.Random(3)
    rows = [
        (n, [rng.choice("abcdef") for _ in range(rng.randrange(9))], [rng.choice("abcxyz") for _ in range(rng.randrange(5))])
        for n in range(60)
    ]
    df = spark.createDataFrame(rows, "n int, v array<string>, k array<string>")
    got = df.select("n", unmatched(F.col("v"), F.col("k")).alias("free"), repeats(F.col("v")).alias("twice"))
    for r in got.collect():
        _, v, k = rows[r.n]
        assert r.free == [i for i, x in enumerate(v) if x not in k]
        assert [(t.value, t.n) for t in r.twice] == [(x, v.count(x)) for x in dict.fromkeys(v) if v.count(x) > 1]


def test_rules_on_a_long_page(page):
    """4,000 fields and as many labels on one page."""
    html = "".join(f'<input id="f{i}"><label for="f{i + i % 2}">l</label>' for i in range(4000))
    found = whole.qa_elements(page(html)).collect()
    assert len(found) == 2000 and {r.check for r in found} == {"Form field without label"}
