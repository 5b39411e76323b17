"""HTML as Spark arrays: tokens, attributes, element tree, text.

``with_tokens`` turns each page row into ``tokens``, an array of structs in document order:

    pos     position in the page, from 0
    tag     'a' open, '/a' close, '' text, '!' comment or declaration
    raw     decoded text of a text token, '' otherwise
    txt     its ``clean_string``; null for other tokens and for white space
    attrs   map of attributes of an open tag (first of a repeated name wins)
    cls     class names joined by one blank
    end     last position inside the element (its own position for text and void elements)
    parent  position of the parent element, -1 at the top
    depth   1 at the top
    nth, same   ordinal among, and number of, siblings with the same tag

All of it stays inside the page's row, so reading a page never shuffles and no page can make
another one's task bigger.  Tags are cut by regular expressions in the JVM; only tag and class
names go through Arrow to the stack pass that pairs them.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reused
from .text import WHITESPACE, clean, clean_string, html_unescape, let

# The stack pass travels to the executors as code: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Inside of a tag: a quote counts only after '='.  The loop is possessive, so it does not recurse.
TAG_REST = r"""(?:[^>"'=]++|=\s*"[^"]*"|=\s*'[^']*'|=|"|')*+"""
HIDDEN = r"<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]).*?(?:</\1\s*>|\z)"
TOKEN = (
    rf"(?is){HIDDEN}|</?[a-z]{TAG_REST}>|<[!?][^>]*>|(?:[^<]++|<(?![a-z/!?]))++|<"
)
ANY_TAG = rf"(?is)</?[a-z]{TAG_REST}>|<[!?][^>]*>"
ATTR = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""

# Fixed values of the HTML language.
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
]
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table",
    "ul",
]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# An open tag ends these open elements, but never looks past the given boundary elements.
ENDS = {
    "li": (["li"], ["ul", "ol", "menu"]),
    "dt": (["dt", "dd"], ["dl"]),
    "dd": (["dt", "dd"], ["dl"]),
    "option": (["option"], ["select", "datalist"]),
    "td": (["td", "th"], ["tr", "table"]),
    "th": (["td", "th"], ["tr", "table"]),
    "tr": (["tr"], ["table"]),
    "thead": (["tr", "thead", "tbody", "tfoot", "caption"], ["table"]),
    "tbody": (["tr", "thead", "tbody", "tfoot", "caption"], ["table"]),
    "tfoot": (["tr", "thead", "tbody", "tfoot", "caption"], ["table"]),
    "a": (["a"], ["table", "td", "th"]),
    "body": (["head"], []),
}
HEADING_BOUNDARY = {"table", "td", "th", "section", "article", "div", "li"}
P_BOUNDARY = ["td", "th", "table", "button", "div", "li", "object"]
# A close tag does not reach past an open element of higher rank.
RANK = {
    "div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5,
    "head": 6, "body": 6, "html": 7,
}
# Parents and children that never form a group of records.
SKIP_PARENTS = [
    "html", "head", "script", "style", "svg", "table", "thead", "tbody", "tfoot", "tr",
    "select", "datalist", "colgroup",
]
SKIP_CHILDREN = ["script", "style", "br", "hr"]

LEAVES = {*VOID_TAGS, "script", "style"}
NO_RECORDS_IN, NO_RECORDS = set(SKIP_PARENTS), set(SKIP_CHILDREN)

TREE_TYPE = (
    "struct<end:array<int>,parent:array<int>,depth:array<int>,nth:array<int>,"
    "same:array<int>,groups:array<array<int>>>"
)


def _ends_for(tag: str) -> list[tuple[set, set]]:
    """What an open tag ends, and what it doesn't look past, one after the other."""
    rules = [(set(HEADINGS), HEADING_BOUNDARY)] if tag in HEADINGS else []
    ends, stop = ENDS.get(tag, ((), ()))
    if tag in BLOCK_TAGS:
        return [*rules, ({*ends, "p"}, {*stop, *P_BOUNDARY} - set(ends))]
    return [*rules, (set(ends), set(stop))] if ends else rules


def pair_tags(codes, min_items: int, rules: dict) -> tuple:
    """One pass over a page's ``tag<TAB>class`` codes; linear in their number."""
    n = len(codes)
    end, parent, depth = list(range(n)), [-1] * n, [0] * n
    nth, same = [0] * n, [0] * n
    stack: list[tuple[str, int]] = []
    of_type: dict = {}
    siblings: dict = {}

    def pop_to(level: int, last: int) -> None:
        for _, opened in stack[level:]:
            end[opened] = last
        del stack[level:]

    for pos, code in enumerate(codes):
        tag, _, cls = code.partition("\t")
        if tag.startswith("/"):
            name = tag[1:]
            rank = RANK.get(name, 0)
            for level in range(len(stack) - 1, -1, -1):
                if stack[level][0] == name:
                    pop_to(level + 1, pos - 1)
                    pop_to(level, pos)
                    break
                if RANK.get(stack[level][0], 0) > rank:
                    break
            parent[pos] = stack[-1][1] if stack else -1
            continue
        if tag not in ("", "!"):
            if tag not in rules:
                rules[tag] = _ends_for(tag)
            for ends, stop in rules[tag]:
                for level in range(len(stack) - 1, -1, -1):
                    if stack[level][0] in ends:
                        pop_to(level, pos - 1)
                        break
                    if stack[level][0] in stop:
                        break
        up = stack[-1][1] if stack else -1
        parent[pos], depth[pos] = up, len(stack) + 1
        if tag in ("", "!"):
            continue
        of_type.setdefault((up, tag), []).append(pos)
        if up >= 0 and stack[-1][0] not in NO_RECORDS_IN and tag not in NO_RECORDS:
            siblings.setdefault((up, tag, cls), []).append(pos)
        if tag not in LEAVES:
            stack.append((tag, pos))
    pop_to(0, n - 1)
    for members in of_type.values():
        for k, pos in enumerate(members, 1):
            nth[pos], same[pos] = k, len(members)
    # groups in document order of parent, then of first member
    groups = sorted(
        (m for m in siblings.values() if len(m) >= min_items), key=lambda m: (parent[m[0]], m[0])
    )
    return end, parent, depth, nth, same, groups


def element_tree(min_items: int = 3):
    """Arrow UDF ``array<tag code> -> struct of int arrays``."""

    @F.pandas_udf(TREE_TYPE)
    def tree(codes: pd.Series) -> pd.DataFrame:
        rules: dict = {}
        rows = [pair_tags(c, min_items, rules) for c in codes]
        return pd.DataFrame(rows, columns=["end", "parent", "depth", "nth", "same", "groups"])

    return tree


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that the optimizer cannot copy their expressions into
    every later use."""
    row = F.struct(*keep, *[c.alias(n) for n, c in columns.items()])
    return df.select(F.inline(F.array(row)))


# ---------------------------------------------------------------- attributes


def class_list(cls: Column) -> Column:
    return F.filter(F.split(cls, WHITESPACE + "+"), lambda c: c != "")


def attrs_map(start_tag: Column) -> Column:
    """Attributes of a start tag; names in lower case, values decoded, first wins."""

    def value(v: Column) -> Column:
        quoted = v.startswith('"') | v.startswith("'")
        return html_unescape(F.when(quoted, v.substr(F.lit(2), F.length(v) - 2)).otherwise(v))

    def found(body: Column) -> Column:
        return F.struct(
            F.transform(F.regexp_extract_all(body, F.lit(ATTR), F.lit(1)), F.lower).alias("names"),
            F.transform(F.regexp_extract_all(body, F.lit(ATTR), F.lit(2)), value).alias("values"),
        )

    def to_map(s: Column) -> Column:
        firsts = F.filter(
            F.arrays_zip(s.names, s["values"]),
            lambda x, i: F.array_position(s.names, x["names"]) == i + 1,
        )
        distinct = F.size(F.array_distinct(s.names)) == F.size(s.names)
        return F.when(distinct, F.map_from_arrays(s.names, s["values"])).otherwise(
            F.map_from_entries(firsts)
        )

    def parsed(body: Column) -> Column:
        return F.when(body.rlike(r"[^\s/>]"), let(found(body), to_map)).otherwise(
            F.create_map().cast("map<string,string>")
        )

    return let(F.regexp_replace(start_tag, r"^<[^\s/>]+", ""), parsed)


def tag_name(token: Column) -> Column:
    """'a', '/a', '!' for comments and declarations, '' for text."""
    return (
        F.when(~token.startswith("<"), "")
        .when(token.rlike("^</?[a-zA-Z]"), F.lower(F.regexp_extract(token, r"^<(/?[^\s/>]+)", 1)))
        .when(token.rlike("^<[!?]"), "!")
        .otherwise("")
    )


# ---------------------------------------------------------------- tokens


def raw_tokens(html: Column) -> Column:
    """All tokens of a page; a script or style element and a comment are one token each."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


@reused
def cut_column() -> Column:
    """Tokens with tag, text and attributes, before they are paired.

    Each kind of token takes its own branch; only open tags with attributes are parsed.
    """

    def fields(tag, raw="", txt=None, attrs=None, cls="") -> Column:
        def col(x) -> Column:
            return x if isinstance(x, Column) else F.lit(x)

        return F.struct(
            col(tag).alias("tag"),
            col(raw).alias("raw"),
            col(txt).cast("string").alias("txt"),
            col(attrs).cast("map<string,string>").alias("attrs"),
            col(cls).alias("cls"),
        )

    def text(r: Column) -> Column:
        return let(html_unescape(r), lambda u: fields("", u, clean_string(u)))

    def opened(r: Column, tag: Column) -> Column:
        start = F.when(
            tag.isin("script", "style"), F.regexp_extract(r, rf"(?s)^<[^>]?{TAG_REST}>", 0)
        ).otherwise(r)

        def named(a: Column) -> Column:
            cls = F.when(
                a["class"].isNotNull(), F.array_join(class_list(a["class"]), " ")
            ).otherwise("")
            return fields(tag, attrs=a, cls=cls)

        bare = fields(tag, attrs=F.create_map())
        return F.when(r.rlike(r"^<[^\s/>]+[\s/]+[^\s/>]"), let(attrs_map(start), named)).otherwise(bare)

    def markup(r: Column, tag: Column) -> Column:
        return (
            F.when(tag.startswith("/"), fields(tag))
            .when(tag != "", opened(r, tag))
            .when(r.rlike("^<[!?]"), fields("!"))
            .otherwise(text(r))
        )

    def token(r: Column) -> Column:
        name = F.lower(F.regexp_extract(r, r"^<(/?[a-zA-Z][^\s/>]*)", 1))
        return F.when(r.startswith("<"), let(name, lambda tag: markup(r, tag))).otherwise(text(r))

    return F.transform(raw_tokens(F.col("html")), token)


@reused
def paired_column() -> Column:
    """Tokens joined with their places in the tree."""

    def merged(t: Column, i: Column) -> Column:
        places = ("end", "parent", "depth", "nth", "same")
        at = [F.get(F.col("tree")[n], i).alias(n) for n in places]
        return F.struct(i.cast("int").alias("pos"), t.tag, t.raw, t.txt, t.attrs, t.cls, *at)

    return F.transform("cut", merged)


def with_tokens(pages: DataFrame, min_items: int = 3, **columns: Column) -> DataFrame:
    """``page_id, url, html -> page_id, url, tokens, groups``; see the module text.  Further
    ``columns`` may read the page before ``html`` is let go."""
    kept = [c for c in pages.columns if c != "html"]
    cut = once(pages, kept, cut=cut_column(), **columns)
    kept += columns
    codes = F.transform("cut", lambda t: F.concat(t.tag, F.lit("\t"), t.cls))
    treed = cut.select(*kept, "cut", element_tree(min_items)(codes).alias("tree"))
    return once(treed, kept, tokens=paired_column(), groups=F.col("tree.groups"))


def is_element(t: Column) -> Column:
    return (t.tag != "") & (t.tag != "!") & ~t.tag.startswith("/")


def inside(tokens: Column, t: Column, base=0) -> Column:
    """Tokens below element ``t``; ``base`` is the position of the first token in ``tokens``."""
    return F.slice(tokens, t.pos - base + 2, t.end - t.pos)


def strings(tokens: Column) -> Column:
    """Cleaned strings, each text token by itself."""
    return F.transform(F.filter(tokens, lambda t: t.txt.isNotNull()), lambda t: F.trim(t.txt))


def text_of(tokens: Column) -> Column:
    """Cleaned text of all strings in ``tokens``, joined by a blank."""
    texts = F.transform(F.filter(tokens, lambda t: t.txt.isNotNull()), lambda t: t.txt)
    return F.trim(F.array_join(texts, " "))


def non_empty(c: Column) -> Column:
    """Null when empty, so that ``coalesce`` takes the next one."""
    return F.when(c != "", c)


# ---------------------------------------------------------------- elements without a tree


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, "(?is)" + HIDDEN, " ")


def flat_elements(html: Column, tag: str) -> Column:
    """Start tag and inner markup of elements that cannot hold their own kind (a, h1..h6).

    An element without end tag goes up to the next of its kind, but not beyond the end tag of a
    block or the next list item or cell: what it was in has ended there.
    """
    pattern = rf"(?is)<{tag}(?=[\s/>]){TAG_REST}>.*?(?:</{tag}(?=[\s>])|(?=<{tag}[\s/>])|\z)"
    start = rf"(?is)^<{tag}{TAG_REST}>"
    end = rf"(?is)</{tag}\z"
    blocks = "|".join([*BLOCK_TAGS, "td", "th", "tr", "body", "html"])
    in_block = rf"(?is)^(.*?)(?=</(?:{blocks})[\s>]|<(?:li|dt|dd|td|th|tr)[\s/>]|\z)"

    def inner(rest: Column) -> Column:
        return F.when(rest.rlike(end), F.regexp_replace(rest, end, "")).otherwise(F.regexp_extract(rest, in_block, 1))

    def cut(e: Column) -> Column:
        def parts(s: Column) -> Column:
            rest = e.substr(F.length(s) + 1, F.length(e))
            return F.struct(s.alias("start"), let(rest, inner).alias("inner"))

        return let(F.regexp_extract(e, start, 0), parts)

    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), cut)


def start_tags(html: Column, tag: str) -> Column:
    pattern = rf"(?is)<{tag}(?=[\s/>]){TAG_REST}>"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def markup_text(inner: Column) -> Column:
    """Cleaned text of a piece of markup."""
    return clean(html_unescape(F.regexp_replace(inner, ANY_TAG, " ")))
