"""Accessibility and data-quality rules.

All rules run inside the page's row and give one array of issues, so checking a page costs one
read of it: no rule scans the pages again, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.markup import VOID_TAGS, inside, non_empty, text_of
from ..functions.selectors import matcher
from ..functions.text import clean, let
from .records import by_tag

# Fixed values.
PLACEHOLDERS = ["#", "javascript:void(0)", "javascript:;"]
UNLABELLED_TYPES = ["hidden", "submit", "button", "reset", "image"]
ISSUE_TYPE = "array<struct<severity:string,`check`:string,detail:string,`where`:string>>"


def issue(severity, check, detail, where="") -> Column:
    def col(x) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    return F.struct(
        col(severity).alias("severity"),
        col(check).alias("check"),
        col(detail).alias("detail"),
        F.coalesce(col(where), F.lit("")).alias("where"),
    )


def no_issues() -> Column:
    return F.array().cast(ISSUE_TYPE)


def when_issue(condition: Column, *args) -> Column:
    return F.when(condition, F.array(issue(*args))).otherwise(no_issues())


def one_each(rows: Column, to_issue) -> Column:
    return F.coalesce(F.transform(rows, to_issue), no_issues())


# ---------------------------------------------------------------- header, headings


def header_issues(title: Column, description: Column, lang: Column) -> list[Column]:
    return [
        when_issue(title == "", "High", "Missing <title>", "Page has no title."),
        when_issue(
            F.length(title) > 70, "Low", "Long <title>", F.format_string("%d chars.", F.length(title)), title
        ),
        when_issue(description == "", "Medium", "Missing meta description", "No <meta name=description>."),
        when_issue(lang == "", "Low", "Missing lang attribute", "<html> has no lang."),
    ]


def heading_issues(headings: Column) -> Column:
    def check(h1: Column) -> Column:
        n = F.size(h1)
        return (
            F.when(n == 0, F.array(issue("Medium", "No <h1>", "Page has no top-level heading.")))
            .when(
                n > 1,
                F.array(
                    issue(
                        "Low",
                        "Multiple <h1>",
                        F.format_string("%d h1s found.", n),
                        F.array_join(F.transform(h1, lambda h: h.text), "; "),
                    )
                ),
            )
            .otherwise(no_issues())
        )

    return let(F.filter(headings, lambda h: h.level == 1), check)


# ---------------------------------------------------------------- images, links


def _shown_with_rest(rows: Column, shown: int | None, severity: str, check: str, detail: str, where) -> Column:
    """All of them, or the first ``shown`` and one row that counts the others."""
    if shown is None:
        return one_each(rows, lambda r: issue(severity, check, detail, where(r)))

    def listed(found: Column) -> Column:
        more = F.size(found) - shown
        return F.concat(
            F.transform(F.slice(found, 1, shown), lambda r: issue(severity, check, detail, where(r))),
            when_issue(more > 0, severity, check, F.format_string("... +%d more.", more)),
        )

    return let(rows, listed)


def image_issues(images: Column, shown: int | None = None) -> Column:
    return _shown_with_rest(
        F.filter(images, lambda i: i.alt_state == "missing"), shown,
        "Medium", "Image without alt", "<img> has no alt.", lambda i: i.src,
    )


def link_issues(links: Column, shown: int | None = None) -> list[Column]:
    nameless = _shown_with_rest(
        F.filter(links, lambda a: a.text == ""), shown,
        "Medium", "Link without accessible name", "No text / aria-label / img alt.", lambda a: a.href,
    )
    held = F.size(
        F.filter(
            links, lambda a: a.type.isin("anchor", "javascript") & a.href.isin(PLACEHOLDERS)
        )
    )
    placeholders = let(
        held,
        lambda n: when_issue(
            n > 0, "Low", "Placeholder links", F.format_string("%d placeholder links.", n)
        ),
    )
    return [nameless, placeholders]


# ---------------------------------------------------------------- elements


def snippet(tokens: Column, t: Column) -> Column:
    """The element's markup."""

    def shown(c: Column) -> Column:
        attrs = F.transform(
            F.map_entries(c.attrs),
            lambda e: F.concat(
                F.lit(" "), e.key, F.lit('="'), F.replace(e.value, F.lit("&"), F.lit("&amp;")), F.lit('"')
            ),
        )
        close = F.when(c.tag.isin(VOID_TAGS), "/>").otherwise(">")
        return (
            F.when(c.tag == "", F.replace(c.raw, F.lit("&"), F.lit("&amp;")))
            .when(c.tag.startswith("/"), F.concat(F.lit("<"), c.tag, F.lit(">")))
            .when(c.tag == "!", "")
            .otherwise(F.concat(F.lit("<"), c.tag, F.array_join(attrs, ""), close))
        )

    part = F.slice(tokens, t.pos + 1, t.end - t.pos + 1)
    return clean(F.array_join(F.transform(part, shown), ""))


def _given(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def button_issues(tokens: Column) -> Column:
    def named(b: Column) -> Column:
        sub = inside(tokens, b)
        return (
            _given(b.attrs["aria-label"])
            | _given(b.attrs["title"])
            | _given(b.attrs["value"])
            | F.exists(sub, lambda c: c.tag == "img")
            | (text_of(sub) != "")
        )

    bad = F.filter(by_tag(tokens, "button"), lambda b: ~named(b))
    return one_each(
        bad,
        lambda b: issue(
            "Medium", "Button without accessible name", "No text/aria-label/title.", snippet(tokens, b)
        ),
    )


def repeats(values: Column) -> Column:
    """``array<struct<first, value, n>>`` of the values that occur more than once, in order of
    first use.

    Sorting puts equal values side by side; each is counted by the distance between the places
    where a new value starts, so the work is that of a sort.
    """

    def starts(s: Column) -> Column:
        numbered = F.transform(
            s, lambda r, i: F.struct(r["first"].alias("first"), r.value.alias("value"), i.alias("i"))
        )
        return F.struct(
            F.filter(
                numbered, lambda r: (r.i == 0) | (F.get(s, r.i - 1).value != r.value)
            ).alias("starts"),
            F.size(s).alias("total"),
        )

    def counted(p: Column) -> Column:
        runs = F.transform(
            p.starts,
            lambda r, k: F.struct(
                r["first"].alias("first"),
                r.value.alias("value"),
                (F.coalesce(F.get(p.starts, k + 1).i, p.total) - r.i).alias("n"),
            ),
        )
        return F.array_sort(F.filter(runs, lambda r: r.n > 1))

    placed = F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("first")))
    return let(let(F.array_sort(placed), starts), counted)


def repeat_issues(values: Column, to_issue) -> Column:
    """Issues for values given more than once; most pages end at the comparison of two sizes."""

    def check(v: Column) -> Column:
        found = one_each(repeats(v), to_issue)
        return F.when(F.size(F.array_distinct(v)) < F.size(v), found).otherwise(no_issues())

    return let(values, check)


def id_issues(tokens: Column) -> Column:
    ids = F.filter(F.transform(tokens, lambda t: t.attrs["id"]), lambda v: v.isNotNull())
    return repeat_issues(
        ids,
        lambda r: issue(
            "Medium",
            "Duplicate id",
            F.format_string('id="%s" used %d times.', r.value, r.n),
            F.concat(F.lit("#"), r.value),
        ),
    )


def unmatched(values: Column, keys: Column) -> Column:
    """Indexes of the values that are not among the keys, in order; the work is that of a sort.

    Sorted together, a key comes before the values equal to it, so a run of equal values is
    matched if it starts with a key.
    """
    marked = F.concat(
        F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("value"), F.lit(-1).alias("i"))),
        F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("i"))),
    )

    def first_of_run(s: Column) -> Column:
        return F.filter(
            F.transform(s, lambda r, i: i),
            lambda i: (i == 0) | (F.get(s, i - 1).value != F.get(s, i).value),
        )

    def free_runs(s: Column, starts: Column) -> Column:
        runs = F.transform(
            starts, lambda b, k: F.slice(s, b + 1, F.coalesce(F.get(starts, k + 1), F.size(s)) - b)
        )
        return F.filter(runs, lambda r: F.get(r, F.lit(0)).i >= 0)

    def free(s: Column) -> Column:
        runs = let(first_of_run(s), lambda starts: free_runs(s, starts))
        return F.array_sort(F.flatten(F.transform(runs, lambda r: F.transform(r, lambda x: x.i))))

    return let(F.array_sort(marked), free)


def form_issues(tokens: Column) -> Column:
    inside_label = matcher("label input, label select, label textarea")

    def unnamed(f: Column) -> Column:
        kind = F.lower(F.coalesce(non_empty(f.attrs["type"]), F.lit("text")))
        named = (
            _given(f.attrs["aria-label"]) | _given(f.attrs["aria-labelledby"]) | _given(f.attrs["title"])
        )
        return ~kind.isin(UNLABELLED_TYPES) & ~named & ~inside_label(tokens, f)

    def found(f: Column) -> Column:
        hint = _given(f.attrs["placeholder"])
        return issue(
            F.when(hint, "Low").otherwise("Medium"),
            "Form field without label",
            F.when(hint, "Only placeholder.").otherwise("No <label>/aria-label."),
            snippet(tokens, f),
        )

    def check(fields: Column) -> Column:
        ids = F.transform(fields, lambda f: F.coalesce(f.attrs["id"], F.lit("")))
        targets = F.filter(
            F.transform(by_tag(tokens, "label"), lambda t: t.attrs["for"]), lambda v: v != ""
        )
        return one_each(unmatched(ids, targets), lambda i: found(F.get(fields, i)))

    fields = F.filter(by_tag(tokens, "input", "select", "textarea"), unnamed)
    return let(fields, check)


# ---------------------------------------------------------------- items


def item_issues(items: Column) -> list[Column]:
    n = F.size(items)
    links = F.filter(F.transform(items, lambda i: i.link), lambda u: u != "")
    untitled = F.size(F.filter(items, lambda i: i.title == ""))
    unpriced = F.forall(items, lambda i: i.price == "")
    return [
        repeat_issues(
            links,
            lambda r: issue(
                "Medium", "Duplicate item link", F.format_string("%d items → same URL.", r.n), r.value
            ),
        ),
        let(
            untitled,
            lambda k: when_issue(
                k > 0, "Medium", "Items without title", F.format_string("%d/%d items have no title.", k, n)
            ),
        ),
        when_issue((n > 0) & unpriced, "Low", "No prices detected", "No price pattern in any item."),
    ]
