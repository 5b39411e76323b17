"""Records on a page: repeating groups, items, product pages, tables, the next page.

Everything is computed inside the page's row from ``with_tokens``; rows come out by ``inline``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import (
    class_list,
    inside,
    is_element,
    non_empty,
    once,
    strings,
    text_of,
    with_tokens,
)
from ..functions.selectors import matcher, select, select_one
from ..functions.text import (
    first_price,
    has_price,
    is_generic_label,
    let,
    ordered_distinct_text,
    price,
    selector_class_suffix,
    strip_ws,
)
from ..functions.urls import is_http, url_parts, url_resolve
from ..session import reused
from .classify import detect_cms_column
from .presets import PRESETS, selector_of
from .rows import image_source, named_text

# Fixed values.
NAV_TAGS = ["header", "footer", "nav", "aside"]
NEXT_TEXT = [
    "next", "next page", "next »", "next ›", "›", "»", ">", ">>", "older", "older posts",
]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
AUTO = "auto"
NO_TOKENS = "array<struct<pos:int,tag:string,raw:string,txt:string,attrs:map<string,string>,cls:string,end:int,parent:int,depth:int,nth:int,same:int>>"


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def by_tag(tokens: Column, *tags: str) -> Column:
    return F.filter(tokens, lambda t: t.tag.isin(*tags))


@reused
def page_base() -> Column:
    return url_parts(F.col("url"))


def with_document(pages: DataFrame, min_items: int = 3, **columns: Column) -> DataFrame:
    """``with_tokens`` plus ``base``, the split page URL."""
    return with_tokens(pages, min_items, base=page_base(), **columns)


# ---------------------------------------------------------------- nodes


def html_nodes(pages: DataFrame) -> DataFrame:
    """The element tree, one row per element."""
    nodes = F.filter(F.col("tokens"), is_element)
    return (
        with_tokens(pages)
        .select("page_id", F.explode(nodes).alias("t"))
        .select(
            "page_id",
            F.col("t.pos").alias("node_id"),
            F.col("t.end").alias("end_pos"),
            "t.depth",
            F.col("t.parent").alias("parent_id"),
            "t.tag",
            "t.attrs",
            class_list(F.col("t.cls")).alias("classes"),
        )
    )


def select_nodes(pages: DataFrame, selector: str) -> DataFrame:
    """Elements matching a CSS selector, with their text."""
    tokens = F.col("tokens")
    found = F.transform(
        select(tokens, selector),
        lambda t: F.struct(
            t.pos.alias("node_id"), t.tag.alias("tag"), text_of(inside(tokens, t)).alias("text")
        ),
    )
    return with_tokens(pages).select("page_id", F.inline(found))


def css_path(tokens: Column, t: Column) -> Column:
    """Path from the nearest ancestor with a plain id, or from the top."""

    def climb(acc: Column, _: Column) -> Column:
        here = F.get(tokens, acc.at)
        has_id = here.attrs["id"].rlike(r"(?U)^[A-Za-z][\w-]*$")
        step = (
            F.when(has_id, F.concat(here.tag, F.lit("#"), here.attrs["id"]))
            .when(here.same > 1, F.format_string("%s:nth-of-type(%d)", here.tag, here.nth))
            .otherwise(here.tag)
        )
        path = F.when(acc.path == "", step).otherwise(F.concat(step, F.lit(" > "), acc.path))
        return F.struct(
            here.parent.alias("at"),
            F.when(acc.done, acc.path).otherwise(path).alias("path"),
            (acc.done | F.coalesce(has_id, F.lit(False))).alias("done"),
        )

    zero = F.struct(t.pos.alias("at"), F.lit("").alias("path"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), t.depth), zero, climb, lambda acc: acc.path)


# ---------------------------------------------------------------- repeating groups


@reused
def groups_column() -> Column:
    """Scored sibling groups, best first; ties in document order.

    ``groups`` holds positions of at least ``min_items`` siblings alike in tag and classes.
    """
    tokens, groups = F.col("tokens"), F.col("groups")

    def member(pos: Column) -> Column:
        return let(
            F.get(tokens, pos),
            lambda t: let(
                inside(tokens, t),
                lambda sub: let(
                    text_of(sub),
                    lambda text: F.struct(
                        F.length(text).alias("len"),
                        F.exists(
                            sub, lambda c: (c.tag == "a") & c.attrs["href"].isNotNull()
                        ).cast("int").alias("link"),
                        F.exists(sub, lambda c: c.tag == "img").cast("int").alias("img"),
                        has_price(text).cast("int").alias("price"),
                    ),
                ),
            ),
        )

    def share(m: Column, flag: str, n: Column) -> Column:
        return F.aggregate(m[flag], F.lit(0), lambda a, x: a + x) / n

    def scored(g: Column, i: Column, nav: Column) -> Column:
        m, n = g.members, F.size(g.pos)
        median = F.get(F.array_sort(m["len"]), F.floor(n / 2).cast("int"))
        parent = F.get(tokens, F.get(tokens, g.pos[0]).parent)
        in_nav = F.exists(nav, lambda v: (v.pos <= parent.pos) & (parent.pos <= v.end))
        weight = 1 + share(m, "link", n) + share(m, "img", n) + 2 * share(m, "price", n)
        score = n * F.sqrt(F.least(median, F.lit(300))) * weight * F.when(in_nav, 0.15).otherwise(1.0)
        return F.struct(
            (-F.bround(score, 1)).alias("minus"),
            i.alias("ord"),
            n.alias("count"),
            median.alias("median"),
            parent.pos.alias("parent_id"),
            g.pos.alias("pos"),
        )

    measured = F.transform(
        groups, lambda g: F.struct(g.alias("pos"), F.transform(g, member).alias("members"))
    )
    ranked = let(
        by_tag(tokens, *NAV_TAGS),
        lambda nav: F.transform(measured, lambda g, i: scored(g, i, nav)),
    )
    return F.array_sort(F.filter(ranked, lambda g: g.median >= 8))


def group_selector(tokens: Column, g: Column) -> Column:
    """CSS selector of a group: path of its parent, then tag and classes of its members."""
    one = F.get(tokens, g.pos[0])
    return F.concat(
        css_path(tokens, F.get(tokens, g.parent_id)),
        F.lit(" > "),
        one.tag,
        selector_class_suffix(class_list(one.cls)),
    )


def find_item_groups(pages: DataFrame, min_items: int = 3, top: int | None = None) -> DataFrame:
    """Repeating groups per page: ``rank, score, count, parent_id, selector``; ``top`` keeps the
    best few of each page (1 for the best group, 3 for the candidates)."""
    doc = with_document(pages, min_items)
    doc = once(
        doc, doc.columns, ranked=groups_column()
    )
    ranked = F.col("ranked") if top is None else F.slice("ranked", 1, top)
    rows = F.transform(
        ranked,
        lambda g, i: F.struct(
            (i + 1).cast("int").alias("rank"),
            (-g.minus).alias("score"),
            g["count"].alias("count"),
            g.parent_id,
            group_selector(F.col("tokens"), g).alias("selector"),
        ),
    )
    return doc.select("page_id", F.inline(rows))


def best_item_group(pages: DataFrame, min_items: int = 3) -> DataFrame:
    return find_item_groups(pages, min_items, top=1)


def top_candidates(pages: DataFrame, k: int = 3, min_items: int = 3) -> DataFrame:
    return find_item_groups(pages, min_items, top=k)


# ---------------------------------------------------------------- fields of one item


def _is_title(c: Column) -> Column:
    found = F.length(first_price(c))
    only_price = (found > 0) & (found >= F.length(c) - 2)
    return (F.length(c) >= 3) & ~is_generic_label(c) & ~only_price


def pick_title(sub: Column, base, chosen: list[Column]) -> Column:
    """First usable title among the given hits, headings, title-like classes, links, text tags."""

    def text(t: Column) -> Column:
        return text_of(inside(sub, t, base))

    def name(t: Column) -> Column:
        below = inside(sub, t, base)
        return let(text_of(below), lambda s: named_text(s, t.attrs, first(by_tag(below, "img")).attrs))

    def usable(found: Column, to_text) -> Column:
        return first(F.filter(F.transform(found, to_text), _is_title))

    title_like = F.filter(
        sub, lambda t: F.lower(t.attrs["class"]).contains("title") | F.lower(t.attrs["class"]).contains("name")
    )
    return F.coalesce(
        *[usable(c, text) for c in chosen],
        usable(by_tag(sub, *HEADINGS), text),
        usable(title_like, text),
        usable(by_tag(sub, "a"), name),
        usable(by_tag(sub, "p", "strong", "b", "span"), text),
        F.lit(""),
    )


def first_priced(sub: Column) -> Column:
    return first(F.filter(sub, lambda t: F.lower(t.attrs["class"]).contains("price")))


def preset_hits(preset, field: str, tokens: Column, within: Column | None = None) -> Column:
    """Tokens matching one selector field of a preset; platforms with equal selectors share a branch."""
    empty = F.array().cast(NO_TOKENS)

    def hits(selector: str) -> Column:
        return select(tokens, selector, within) if selector else empty

    if isinstance(preset, str):
        return hits(selector_of(preset, field)) if preset else empty
    platforms: dict[str, list[str]] = {}
    for name, row in PRESETS.items():
        platforms.setdefault(row[field], []).append(name)
    chosen = F.when(F.lit(False), empty)
    for selector, names in platforms.items():
        chosen = chosen.when(preset.isin(names), hits(selector))
    return chosen.otherwise(empty)


def item_struct(tokens: Column, base: Column, n: Column, index: Column, preset) -> Column:
    """One item from the element at token ``n``."""

    def build(sub: Column) -> Column:
        start = n.pos + 1

        def hits(field: str) -> list[Column]:
            return [preset_hits(preset, field, tokens, sub)] if not _is_empty(preset) else []

        def text(t: Column) -> Column:
            return text_of(inside(sub, t, start))

        priced = F.coalesce(
            *[non_empty(text(first(h))) for h in hits("price_selector")],
            non_empty(text(first_priced(sub))),
            text_of(sub),
        )
        anchor = F.coalesce(
            *[first(h) for h in (hits("link_selector") or [by_tag(sub, "a")])],
            first(F.filter(sub, lambda t: (t.tag == "a") & t.attrs["href"].isNotNull())),
        )
        href = strip_ws(F.coalesce(anchor.attrs["href"], F.lit("")))
        img = F.coalesce(
            *[first(h) for h in (hits("image_selector") or [by_tag(sub, "img")])],
            first(by_tag(sub, "img")),
        )
        from_set = F.regexp_extract(F.coalesce(img.attrs["srcset"], F.lit("")), r"^\s*([^\s,]+)", 1)
        src = let(image_source(img.attrs), lambda s: F.when(s != "", s).otherwise(from_set))
        return F.struct(
            index.cast("int").alias("index"),
            pick_title(sub, start, hits("title_selector")).alias("title"),
            price(priced).alias("price"),
            let(
                href,
                lambda h: F.when(
                    (h != "") & ~h.startswith("#") & ~h.startswith("javascript:"),
                    url_resolve(base, h),
                ).otherwise(""),
            ).alias("link"),
            let(
                src,
                lambda s: F.when((s != "") & ~s.startswith("data:"), url_resolve(base, s)).otherwise(""),
            ).alias("image"),
            ordered_distinct_text(strings(sub)).alias("text"),
        )

    return let(inside(tokens, n), build)


def _is_empty(preset) -> bool:
    return isinstance(preset, str) and preset == ""


# ---------------------------------------------------------------- choice of item elements


@reused
def found_columns(preset: str, item_selector: str, wanted: tuple) -> Column:
    """Struct of the ``wanted`` among items, selector, candidates and n_items."""
    tokens, chosen = F.col("tokens"), preset_of(preset)
    if item_selector:
        named, asked = select(tokens, item_selector), F.lit(item_selector)
    else:
        named, asked = preset_hits(chosen, "item_selector", tokens), _wanted(chosen)
    suffix = F.lit("")
    if preset:
        name = chosen if preset == AUTO else F.lit(preset)
        suffix = F.concat(F.lit("  (preset:"), name, F.lit(")"))

    def nodes(s: Column, hit: Column) -> Column:
        of_best = F.transform(first(s.ranked).pos, lambda p: F.get(tokens, p))
        return F.when(hit, s.named).otherwise(F.coalesce(of_best, F.array().cast(NO_TOKENS)))

    def selector(s: Column, hit: Column) -> Column:
        auto = F.coalesce(group_selector(tokens, first(s.ranked)), asked)
        return (
            F.when(hit, F.concat(asked, suffix))
            .when(asked != "", F.concat(auto, F.lit("  [auto-fallback]")))
            .otherwise(auto)
        )

    def candidates(s: Column, hit: Column) -> Column:
        top = F.transform(
            F.slice(s.ranked, 1, 3),
            lambda g: F.struct(
                group_selector(tokens, g).alias("selector"),
                g["count"].alias("count"),
                (-g.minus).alias("score"),
            ),
        )
        return F.when(hit, F.slice(top, 1, 0)).otherwise(top)

    def items(s: Column, hit: Column) -> Column:
        return F.transform(
            nodes(s, hit), lambda n, i: item_struct(tokens, F.col("base"), n, i + 1, chosen)
        )

    makers = {
        "items": items,
        "selector": selector,
        "candidates": candidates,
        "n_items": lambda s, hit: F.size(nodes(s, hit)),
    }

    def found(s: Column) -> Column:
        hit = F.size(s.named) > 0
        return F.struct(*[makers[w](s, hit).alias(w) for w in wanted])

    return let(F.struct(named.alias("named"), groups_column().alias("ranked")), found)


def found_document(pages: DataFrame, preset: str, item_selector: str, min_items: int, **columns):
    """``with_document`` for ``found_columns``: checks the names and adds the page's preset."""
    if preset == AUTO:
        columns["preset"] = detect_cms_column(F.col("html")).preset
    elif preset:
        selector_of(preset, "item_selector")
    if item_selector:
        matcher(item_selector)
    return with_document(pages, min_items, **columns)


def _wanted(preset) -> Column:
    if isinstance(preset, str):
        return F.lit(selector_of(preset, "item_selector") if preset else "")
    wanted = F.lit("")
    for name, row in PRESETS.items():
        wanted = F.when(preset == name, row["item_selector"]).otherwise(wanted)
    return wanted


def extract_items(
    pages: DataFrame, preset: str = "", item_selector: str = "", min_items: int = 3
) -> DataFrame:
    """Items of every page: ``page_id, index, title, price, link, image, text``.

    ``item_selector`` goes before the preset's selector; without a hit, or without either, the
    best repeating group is taken.  ``preset`` is a name, '' for none, or 'auto' to detect the
    platform of every page.
    """
    found = found_columns(preset, item_selector, ("items",))
    doc = found_document(pages, preset, item_selector, min_items)
    return doc.select("page_id", F.inline(found["items"]))


def item_selectors(pages: DataFrame, preset: str = "", item_selector: str = "") -> DataFrame:
    """How each page's items were found, and how many there are."""
    found = found_columns(preset, item_selector, ("selector", "n_items"))
    doc = found_document(pages, preset, item_selector, 3)
    return doc.select("page_id", F.inline(F.array(found)))


# ---------------------------------------------------------------- hand-written page kinds


@reused
def product_column() -> Column:
    """A product page is one item, even when empty."""
    tokens, base, page_url = F.col("tokens"), F.col("base"), F.col("url")

    def text(selector: str) -> Column:
        t = select_one(tokens, selector)
        return F.coalesce(let(t, lambda t: text_of(inside(tokens, t))), F.lit(""))

    pictures = F.filter(
        F.transform(
            select(tokens, '[class*="gallery" i] img, [itemprop="image"], img'),
            lambda t: image_source(t.attrs),
        ),
        lambda s: (s != "") & ~s.startswith("data:"),
    )
    return F.array(
        F.struct(
            F.lit(1).alias("index"),
            text("h1").alias("title"),
            price(text('[class*="price" i]')).alias("price"),
            page_url.alias("link"),
            F.coalesce(url_resolve(base, first(pictures)), F.lit("")).alias("image"),
            text('[class*="description" i], #description').alias("text"),
        )
    )


def extract_product(pages: DataFrame) -> DataFrame:
    return with_document(pages).select("page_id", F.inline(product_column()))


@reused
def book_cards_column() -> Column:
    tokens, base = F.col("tokens"), F.col("base")

    def card(n: Column, i: Column) -> Column:
        def build(sub: Column) -> Column:
            start = n.pos + 1
            a = select_one(tokens, "h3 a", sub)
            cost = select_one(tokens, "p.price_color", sub)
            img = first(by_tag(sub, "img"))

            def resolved(raw: Column) -> Column:
                return F.when(F.coalesce(raw, F.lit("")) != "", url_resolve(base, raw)).otherwise("")

            return F.struct(
                (i + 1).cast("int").alias("index"),
                let(
                    a,
                    lambda a: F.coalesce(
                        non_empty(a.attrs["title"]), text_of(inside(sub, a, start)), F.lit("")
                    ),
                ).alias("title"),
                F.coalesce(
                    price(let(cost, lambda c: text_of(inside(sub, c, start)))), F.lit("")
                ).alias("price"),
                let(a.attrs["href"], resolved).alias("link"),
                let(img.attrs["src"], resolved).alias("image"),
                text_of(sub).alias("text"),
            )

        return let(inside(tokens, n), build)

    return F.transform(select(tokens, "article.product_pod"), card)


def extract_book_cards(pages: DataFrame) -> DataFrame:
    return with_document(pages).select("page_id", F.inline(book_cards_column()))


# ---------------------------------------------------------------- tables


@reused
def tables_column() -> Column:
    """HTML tables with at least two rows and two columns; short rows are filled with ''."""
    tokens = F.col("tokens")

    def cells(tr: Column) -> Column:
        return F.transform(
            by_tag(inside(tokens, tr), "th", "td"),
            lambda c: F.struct(c.tag.alias("tag"), text_of(inside(tokens, c)).alias("text")),
        )

    def parsed(t: Column) -> Column:
        def build(sub: Column) -> Column:
            rows = F.filter(F.transform(by_tag(sub, "tr"), cells), lambda r: F.size(r) > 0)
            cap = first(by_tag(sub, "caption"))
            return F.struct(
                rows.alias("rows"),
                F.coalesce(let(cap, lambda c: text_of(inside(tokens, c))), F.lit("")).alias("caption"),
            )

        return let(inside(tokens, t), build)

    def shaped(t: Column) -> Column:
        width = F.array_max(F.transform(t.rows, F.size))
        head = F.forall(F.get(t.rows, F.lit(0)), lambda c: c.tag == "th")
        texts = F.transform(t.rows, lambda r: F.transform(r, lambda c: c.text))
        return F.struct(t.caption, width.alias("width"), head.alias("head"), texts.alias("texts"))

    def padded(row: Column, width: Column) -> Column:
        return F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))

    def block(t: Column, i: Column) -> Column:
        numbered = F.transform(
            F.sequence(F.lit(1), t.width), lambda n: F.concat(F.lit("col_"), n.cast("string"))
        )
        body = F.when(t["head"], F.slice(t.texts, F.lit(2), F.size(t.texts))).otherwise(t.texts)
        return F.struct(
            (i + 1).cast("int").alias("table_no"),
            t.caption,
            F.when(t["head"], padded(t.texts[0], t.width)).otherwise(numbered).alias("header"),
            F.transform(body, lambda r: padded(r, t.width)).alias("rows"),
        )

    found = F.filter(
        F.transform(by_tag(tokens, "table"), parsed),
        lambda t: (F.size(t.rows) >= 2) & F.exists(t.rows, lambda r: F.size(r) >= 2),
    )
    return F.transform(F.transform(found, shaped), block)


def extract_tables(pages: DataFrame) -> DataFrame:
    return with_tokens(pages).select("page_id", F.inline(tables_column()))


def table_cells(tables: DataFrame) -> DataFrame:
    """Long form: one row per cell; a blank heading becomes ``col_n``.  Columns that share a
    heading stay apart by ``col_no``."""
    named = F.transform(
        "header",
        lambda h, i: F.when(h == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(h),
    )
    return (
        tables.select("page_id", "table_no", named.alias("names"), F.posexplode("rows").alias("r", "row"))
        .select("page_id", "table_no", "r", "names", F.posexplode("row").alias("c", "cell"))
        .select(
            "page_id",
            "table_no",
            (F.col("r") + 1).alias("row_no"),
            (F.col("c") + 1).alias("col_no"),
            F.get("names", F.col("c")).alias("col_name"),
            "cell",
        )
    )


# ---------------------------------------------------------------- next page


def preset_of(name: str) -> Column | str:
    """The name itself, or the ``preset`` column when every page has its own."""
    return F.col("preset") if name == AUTO else name


@reused
def next_column(name: str = "") -> Column:
    """URL of the following page, or null."""
    tokens, base, preset = F.col("tokens"), F.col("base"), preset_of(name)

    def looks_next(t: Column) -> Column:
        label = F.lower(F.coalesce(t.attrs["aria-label"], F.lit("")))
        return (
            (t.tag == "a")
            & t.attrs["href"].isNotNull()
            & (
                label.contains("next")
                | F.array_contains(F.split(F.lower(t.cls), " "), "next")
                | F.lower(text_of(inside(tokens, t))).isin(NEXT_TEXT)
            )
        )

    chosen = F.coalesce(
        *([] if _is_empty(preset) else [first(preset_hits(preset, "next_selector", tokens))]),
        select_one(tokens, 'a[rel~="next"][href], link[rel~="next"][href]'),
        first(F.filter(tokens, looks_next)),
    )

    def target(t: Column) -> Column:
        up = F.when(t.parent >= 0, F.get(tokens, t.parent).cls)
        holder = F.lower(F.concat_ws(" ", t.cls, up))
        off = holder.contains("disabled") | F.coalesce(t.attrs["aria-disabled"] == "true", F.lit(False))
        u = let(t.attrs["href"], lambda h: F.when(h != "", url_resolve(base, h)))
        return F.when(~off, let(u, lambda u: F.when(is_http(u), u)))

    return let(chosen, target)


def find_next(pages: DataFrame, preset: str = "") -> DataFrame:
    """``page_id, next_url`` with '' where a page has no next one."""
    if preset:
        selector_of(preset, "next_selector")
    found = F.coalesce(next_column(preset), F.lit(""))
    return with_document(pages).select("page_id", found.alias("next_url"))
