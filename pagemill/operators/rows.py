"""Row families that need no element tree: page header, links, images, headings.

Each ``*_column`` function gives an array inside the page's row, from the columns that
``with_visible`` adds; each ``extract_*`` function explodes it.  No shuffle and no Python on the way from the scan to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import (
    ANY_TAG,
    TAG_REST,
    attrs_map,
    flat_elements,
    html_unescape,
    markup_text,
    non_empty,
    once,
    start_tags,
    visible,
)
from ..functions.text import alt_state, clean, collapse_ws, has_word, let, strip_ws
from ..functions.urls import url_netloc, url_parts, url_resolve
from ..session import reused


def with_visible(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``body``, the page without comments, scripts and styles, and add
    ``base``, the split page URL; both are computed once per page."""
    kept = [c for c in pages.columns if c != "html"]
    return once(pages, kept, body=visible(F.col("html")), base=url_parts(F.col("url")))


# ---------------------------------------------------------------- header


@reused
def header_columns() -> dict[str, Column]:
    body = F.col("body")
    title = F.regexp_extract(body, rf"(?is)<title(?=[\s>/]){TAG_REST}>(.*?)(?:</title|\z)", 1)
    metas = F.transform(start_tags(body, "meta"), attrs_map)
    described = F.filter(metas, lambda m: F.lower(m["name"]) == "description")
    html_tag = F.get(start_tags(body, "html"), F.lit(0))
    return {
        "title": collapse_ws(html_unescape(F.regexp_replace(title, ANY_TAG, " "))),
        "description": F.coalesce(strip_ws(F.get(described, F.lit(0))["content"]), F.lit("")),
        "lang": F.coalesce(attrs_map(html_tag)["lang"], F.lit("")),
    }


def page_header(pages: DataFrame) -> DataFrame:
    """``page_id, title, description, lang``."""
    columns = header_columns()
    return with_visible(pages).select("page_id", *[c.alias(n) for n, c in columns.items()])


# ---------------------------------------------------------------- links


def link_target(href: Column, base: Column) -> Column:
    """``struct<href, type>``; links that are no URL keep their raw text.  ``base`` is the
    page's ``url_parts``."""

    def kept(raw: Column, kind: str) -> Column:
        return F.struct(raw.alias("href"), F.lit(kind).alias("type"))

    def joined(u: Column) -> Column:
        same = F.concat(F.lit("//"), url_netloc(u)) == F.get(base, F.lit(1))
        none = (url_netloc(u) == "") & (F.get(base, F.lit(1)) == "")
        kind = F.when(same | none, "internal").otherwise("external")
        return F.struct(u.alias("href"), kind.alias("type"))

    def resolve(raw: Column) -> Column:
        low = F.lower(F.substring(raw, 1, 11))
        return (
            F.when(raw.startswith("#"), kept(raw, "anchor"))
            .when(low == "javascript:", kept(raw, "javascript"))
            .when(low.startswith("mailto:"), kept(raw, "mailto"))
            .when(low.startswith("tel:"), kept(raw, "tel"))
            .otherwise(let(url_resolve(base, raw), joined))
        )

    return let(strip_ws(href), resolve)


def named_text(text: Column, attrs: Column, first_img: Column) -> Column:
    """Accessible name of a link: its text, else aria-label, title, alt of its first image."""
    return F.coalesce(
        F.when(has_word(text), text),
        non_empty(clean(attrs["aria-label"])),
        non_empty(clean(attrs["title"])),
        clean(first_img["alt"]),
        F.lit(""),
    )


@reused
def links_column() -> Column:
    body, base = F.col("body"), F.col("base")

    def parsed(e: Column) -> Column:
        img = F.get(start_tags(e.inner, "img"), F.lit(0))
        return F.struct(
            attrs_map(e.start).alias("attrs"),
            markup_text(e.inner).alias("text"),
            F.when(e.inner.contains("<"), attrs_map(img)).alias("img"),
        )

    def row(a: Column) -> Column:
        return F.struct(
            named_text(a.text, a.attrs, a.img).alias("text"),
            link_target(a.attrs["href"], base).alias("to"),
        )

    found = F.filter(
        F.transform(flat_elements(body, "a"), parsed), lambda a: a.attrs["href"].isNotNull()
    )
    return F.transform(
        F.transform(found, row),
        lambda r, i: F.struct(
            (i + 1).cast("int").alias("pos"), r.text, r.to.href.alias("href"), r.to.type.alias("type")
        ),
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """Every ``a[href]`` in document order; status and detail are filled by ``check_links``."""
    return (
        with_visible(pages)
        .select("page_id", F.inline(links_column()))
        .select("*", F.lit("").alias("status"), F.lit("").alias("detail"))
    )


# ---------------------------------------------------------------- images


def image_source(attrs: Column) -> Column:
    return F.coalesce(
        non_empty(attrs["src"]), non_empty(attrs["data-src"]), non_empty(attrs["data-lazy-src"]), F.lit("")
    )


@reused
def images_column() -> Column:
    body, base = F.col("body"), F.col("base")

    def row(r: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).cast("int").alias("pos"),
            F.when((r.src == "") | r.src.startswith("data:"), r.src)
            .otherwise(url_resolve(base, r.src))
            .alias("src"),
            F.coalesce(r.a["alt"], F.lit("")).alias("alt"),
            alt_state(r.a["alt"]).alias("alt_state"),
            F.coalesce(r.a["width"], F.lit("")).alias("width"),
            F.coalesce(r.a["height"], F.lit("")).alias("height"),
        )

    attrs = F.transform(start_tags(body, "img"), attrs_map)
    return F.transform(
        F.transform(attrs, lambda a: F.struct(a.alias("a"), image_source(a).alias("src"))), row
    )


def extract_images(pages: DataFrame) -> DataFrame:
    return with_visible(pages).select("page_id", F.inline(images_column()))


# ---------------------------------------------------------------- headings


@reused
def headings_column() -> Column:
    body = F.col("body")
    found = F.filter(
        F.transform(
            flat_elements(body, "h[1-6]"),
            lambda e: F.struct(
                F.substring(e.start, 3, 1).cast("int").alias("level"),
                markup_text(e.inner).alias("text"),
            ),
        ),
        lambda h: h.text != "",
    )
    return F.transform(
        found, lambda h, i: F.struct((i + 1).cast("int").alias("pos"), h.level, h.text)
    )


def extract_headings(pages: DataFrame) -> DataFrame:
    return with_visible(pages).select("page_id", F.inline(headings_column()))


# ---------------------------------------------------------------- counts over links


def links_by_host(pages: DataFrame) -> DataFrame:
    """Number of links per page host and link type."""
    return (
        with_visible(pages)
        .select(url_netloc(F.col("url")).alias("host"), F.explode(links_column().type).alias("type"))
        .groupBy("host", "type")
        .agg(F.count("*").alias("n_links"))
    )
