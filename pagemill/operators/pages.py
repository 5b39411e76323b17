"""A whole run over a table of pages: one pass, one row per page, six row families."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import once, visible
from ..session import reused
from .quality import (
    button_issues,
    form_issues,
    header_issues,
    heading_issues,
    id_issues,
    image_issues,
    item_issues,
    link_issues,
)
from .records import (
    book_cards_column,
    found_columns,
    found_document,
    next_column,
    product_column,
    tables_column,
    with_document,
)
from .rows import header_columns, headings_column, images_column, links_column, with_visible

FAMILIES = ["items", "links", "images", "headings", "tables", "issues"]
KINDS = ["listing", "product", "books"]


NO_CANDIDATES = "array<struct<selector:string,count:int,score:double>>"


def _with_kind(
    pages: DataFrame, kind: str, preset: str, item_selector: str, min_items: int
) -> DataFrame:
    """Tokens, ``body`` and ``found``: items, selector and candidates by the kind of page."""
    body = visible(F.col("html"))
    if kind == "listing":
        doc = found_document(pages, preset, item_selector, min_items, body=body)
        found = found_columns(preset, item_selector, ("items", "selector", "candidates"))
    elif kind in KINDS:
        doc = with_document(pages, min_items, body=body)
        product = kind == "product"
        found = F.struct(
            (product_column() if product else book_cards_column()).alias("items"),
            F.lit("h1 (hand-written)" if product else "article.product_pod").alias("selector"),
            F.array().cast(NO_CANDIDATES).alias("candidates"),
        )
    else:
        raise KeyError(f"Unknown page kind '{kind}'. Available: {', '.join(sorted(KINDS))}")
    return once(doc, [c for c in doc.columns if c != "groups"], found=found)


# Rules by what they need: columns of the page's row.
@reused
def text_rules() -> list[Column]:
    return [
        *header_issues(F.col("title"), F.col("description"), F.col("lang")),
        heading_issues(F.col("headings")),
    ]


@reused
def row_rules(shown: int | None = None) -> list[Column]:
    return [image_issues(F.col("images"), shown), *link_issues(F.col("links"), shown)]


@reused
def element_rules() -> list[Column]:
    tokens = F.col("tokens")
    return [button_issues(tokens), id_issues(tokens), form_issues(tokens)]


@reused
def item_rules() -> list[Column]:
    return item_issues(F.col("items"))


def numbered(rules: list[Column]) -> Column:
    """One array of issues, with their place on the page."""
    return F.transform(
        F.concat(*rules),
        lambda r, i: F.struct(
            (i + 1).cast("int").alias("pos"), r.severity, r.check, r.detail, r["where"]
        ),
    )


def extract_pages(
    pages: DataFrame,
    kind: str = "listing",
    preset: str = "",
    item_selector: str = "",
    min_items: int = 3,
    families: Collection[str] = tuple(FAMILIES),
) -> DataFrame:
    """Header, links, images, headings, tables, items, next page and issues of every page.

    The page is cut into tokens once and all families are arrays in its row; ``family`` turns one
    of them into rows.  Store the result before reading several families from it.  Only the
    ``families`` asked for are worked out; issues need all others but tables.
    """
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise KeyError(f"Unknown families: {', '.join(sorted(unknown))}. Available: {', '.join(FAMILIES)}")
    doc = _with_kind(pages, kind, preset, item_selector, min_items)
    with_issues = "issues" in families
    makers = {"links": links_column, "images": images_column, "headings": headings_column, "tables": tables_column}
    made = {n: make() for n, make in makers.items() if n in families or with_issues and n != "tables"}
    found = [c for c in ("items", "selector", "candidates") if c != "items" or c in families or with_issues]
    rows = once(
        doc,
        ["page_id", "url", "tokens"],
        **{c: F.col(f"found.{c}") for c in found},
        **header_columns(),
        **made,
        next_url=F.coalesce(next_column(preset), F.lit("")),
    )
    kept = ["page_id", "url", "title", "description", "lang", "selector", "candidates", "next_url"]
    kept += [f for f in FAMILIES if f != "issues" and f in families]
    if not with_issues:
        return rows.select(*kept)
    rules = [*text_rules(), *row_rules(), *element_rules(), *item_rules()]
    # behind a generator too: the optimizer tests the size of an array before it explodes it, and
    # would work out the issues a second time for that
    return once(rows, kept, issues=numbered(rules))


def family(extracted: DataFrame, name: str) -> DataFrame:
    """Rows of one family of ``extract_pages``, keyed by ``page_id``."""
    if name not in FAMILIES:
        raise KeyError(f"Unknown family '{name}'. Available: {', '.join(FAMILIES)}")
    rows = extracted.select("page_id", F.inline(name))
    if name == "links":
        return rows.select("*", F.lit("").alias("status"), F.lit("").alias("detail"))
    return rows


def qa_issues(
    pages: DataFrame, kind: str = "listing", preset: str = "", item_selector: str = ""
) -> DataFrame:
    """Issues of every page by all page rules, before any removal of duplicates."""
    return family(extract_pages(pages, kind, preset, item_selector), "issues")


def qa_header(pages: DataFrame) -> DataFrame:
    """Only the header and heading rules: no element tree, no Python."""
    doc = once(with_visible(pages), ["page_id"], headings=headings_column(), **header_columns())
    return doc.select("page_id", F.inline(numbered(text_rules())))


def qa_rows(pages: DataFrame, shown: int | None = None) -> DataFrame:
    """Only the image and link rules: no element tree, no Python.

    With ``shown``, that many of a kind for each page and one row that counts the others.
    """
    doc = once(with_visible(pages), ["page_id"], images=images_column(), links=links_column())
    return doc.select("page_id", F.inline(numbered(row_rules(shown))))


def qa_elements(pages: DataFrame) -> DataFrame:
    """Only the button, id and form-field rules."""
    return with_document(pages).select("page_id", F.inline(numbered(element_rules())))


def qa_items(pages: DataFrame, preset: str = "", item_selector: str = "") -> DataFrame:
    """Only the item rules."""
    found = found_columns(preset, item_selector, ("items",))
    doc = once(
        found_document(pages, preset, item_selector, 3), ["page_id"], items=found["items"]
    )
    return doc.select("page_id", F.inline(numbered(item_rules())))
