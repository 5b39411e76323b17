"""Text expressions: cleaning, prices, labels, entities.  Every function is ``Column -> Column``."""

from __future__ import annotations

import functools
import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The price pattern and the call-to-action words decide what counts as a match.
PRICE = (
    r"(?:[$€£¥₹]|\b(?:USD|MYR|RM|Rs\.?|INR|EUR|GBP))\s?\d[\d,]*(?:\.\d+)?"
    r"|\d[\d,]*(?:\.\d+)?\s?(?:USD|MYR|RM|€|£)"
)
GENERIC_LABEL = (
    r"^(add to (cart|bag|basket)|view( product| details| more)?|buy( now)?|read more|"
    r"learn more|details|more|shop now|quick view|see more|select options|sign ?up|log ?in)$"
)
SEVERITIES = ["High", "Medium", "Low"]

DIGIT = r"\p{Nd}"

# White space as str.split() knows it; Java's \s is ASCII only.  Java looks single characters below
# 256 up in one table, but tries ranges one by one: hence the singles, and a fence around the rest.
WHITESPACE = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
# Anything but printable characters of Latin-1, by the same table.
UNUSUAL = "[^%s]" % "".join(
    f"\\x{c:02x}" for c in [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
)
NOT_PRINTABLE = r"\p{C}"  # line and paragraph separators are white space
ENTITY_PIECES = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
NAME_BUCKETS = 512
LONGEST_BARE = max(len(n) for n in html5 if not n.endswith(";"))  # names that count without semicolon


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` can use it often but compute it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse_ws(t: Column) -> Column:
    def slow(t: Column) -> Column:
        return F.regexp_replace(t, WHITESPACE + "+", " ")

    return let(
        t, lambda t: F.trim(F.when(t.rlike(UNUSUAL) | t.contains("  "), slow(t)).otherwise(t))
    )


def strip_ws(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")


def clean_string(t: Column) -> Column:
    """White space collapsed, then unprintable characters dropped, but blanks beside those kept;
    null when there is only white space.  ``clean`` of strings joined by a blank is the trimmed
    join of their ``clean_string``."""

    def given(t: Column) -> Column:
        return F.when(t != "", t)

    def plain(t: Column) -> Column:
        return let(F.trim(F.when(t.contains("  "), F.regexp_replace(t, " +", " ")).otherwise(t)), given)

    def other(t: Column) -> Column:
        collapsed = let(F.trim(F.regexp_replace(t, WHITESPACE + "+", " ")), given)
        return F.regexp_replace(collapsed, NOT_PRINTABLE, "")

    return let(t, lambda t: F.when(t.rlike(UNUSUAL), other(t)).otherwise(plain(t)))


def clean(t: Column) -> Column:
    """Collapse white space, drop unprintable characters, strip."""
    return F.trim(F.coalesce(clean_string(t), F.lit("")))


def first_price(t: Column) -> Column:
    """First price in the text as it stands, or ''.  Most texts have no digit and skip the search."""
    return F.when(t.rlike(DIGIT), F.regexp_extract(t, "(?iU)" + PRICE, 0)).otherwise("")


def has_price(t: Column) -> Column:
    return F.when(t.rlike(DIGIT), t.rlike("(?iU)" + PRICE)).otherwise(False)


def price(t: Column) -> Column:
    return F.trim(first_price(t))


def price_amount(t: Column) -> Column:
    """Number in a price text with at most four other characters on either side; null if none."""
    digits = F.regexp_extract(t, r"^[^0-9\-]{0,4}(-?[0-9][0-9,]*(?:\.[0-9]+)?)[^0-9]{0,4}$", 1)
    return F.regexp_replace(digits, ",", "").try_cast("double")


def is_generic_label(t: Column) -> Column:
    return t.rlike("(?iu)" + GENERIC_LABEL)


def has_word(t: Column) -> Column:
    """Does the text hold at least one letter or digit?"""
    return t.rlike(r"[\p{L}\p{N}]")


def truncate(t: Column, n: int | None) -> Column:
    """The first ``n`` characters, or all of them."""
    return t if n is None else F.substring(t, 1, n)


def alt_state(alt: Column) -> Column:
    return F.when(alt.isNull(), "missing").when(strip_ws(alt) == "", "empty").otherwise("ok")


def severity_rank(s: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for n, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(s == name, n).otherwise(rank)
    return rank


def strip_json_fences(s: Column) -> Column:
    """Remove a surrounding ``` fence and a leading ``json`` tag."""
    s = strip_ws(s)
    body = F.regexp_replace(s, r"^`+|`+\z", "")
    body = F.when(
        F.lower(body).startswith("json"),
        F.regexp_replace(body, rf"(?i)^json{WHITESPACE}*", ""),
    ).otherwise(body)
    return F.when(s.startswith("```"), body).otherwise(s)


def selector_class_suffix(classes: Column) -> Column:
    """``.a.b`` from those class names that are plain identifiers."""
    valid = F.filter(classes, lambda c: c.rlike(r"(?U)^[A-Za-z_][\w-]*$"))
    return F.array_join(F.transform(valid, lambda c: F.concat(F.lit("."), c)), "")


def ordered_distinct_text(cleaned: Column, sep: str = " | ", cap: int | None = None) -> Column:
    """Distinct non-empty texts in order of first use, joined; the texts must be clean."""
    cleaned = F.filter(cleaned, lambda s: s != "")
    return truncate(F.array_join(F.array_distinct(cleaned), sep), cap)


def _number(digits: Column, base: int) -> Column:
    """A number of any length; those too long for a character become one that is no character."""
    bare = F.regexp_replace(digits, "^0+", "")
    value = F.when(bare == "", "0").otherwise(F.conv(bare, base, 10)).try_cast("bigint")
    return F.when(F.length(bare) > 8, F.lit(0x110000).cast("bigint")).otherwise(value)


def _code_point(n: Column) -> Column:
    """References to the 32 places after 127 mean the characters that Windows has there; those to
    other control and non-characters mean nothing."""
    windows = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160))
    in_windows = F.lit(windows).substr((n - 127).cast("int"), F.lit(1))
    nothing = F.hex(n).rlike("^([1-8BEF]|1.|7F|FD[DE].|[0-9A-F]?FFF[EF]|10FFF[EF])$")
    bad = (n < 1) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(bad, "\ufffd").when(n.between(128, 159), in_windows).when(nothing, "").otherwise(char)


@functools.cache
def _names() -> str:
    """Names and their characters as JSON, in buckets by checksum, as a look-up in a map reads it from its start."""
    buckets: list[dict] = [{} for _ in range(NAME_BUCKETS)]
    for known, chars in html5.items():
        buckets[zlib.crc32(known.encode()) % NAME_BUCKETS][known] = chars
    return json.dumps(buckets)


def _name_or_prefix(piece: Column, names: Column) -> Column:
    """The whole name, or else the longest beginning that is one without semicolon."""

    def named(name: Column) -> Column:
        return F.get(names, (F.crc32(name.cast("binary")) % NAME_BUCKETS).cast("int"))[name]

    def beginning(n: Column) -> Column:
        return F.concat(named(body.substr(F.lit(1), n)), body.substr(n + 1, F.lit(40)))

    body = F.substring(piece, 2, 40)
    lengths = F.filter(F.lit(list(range(LONGEST_BARE, 1, -1))), lambda n: n < F.length(body))
    shorter = F.filter(F.transform(lengths, beginning), F.isnotnull)
    return F.coalesce(named(body), F.get(shorter, F.lit(0)), piece)


def _entity(piece: Column, names: Column) -> Column:
    body = F.regexp_replace(piece, "^&|;$", "")
    return (
        F.when(
            piece.rlike("^&#[xX]"),
            _code_point(_number(F.regexp_replace(body, "^#[xX]", ""), 16)),
        )
        .when(piece.rlike("^&#[0-9]"), _code_point(_number(F.regexp_replace(body, "^#", ""), 10)))
        .when(piece.rlike("^&."), _name_or_prefix(piece, names))
        .otherwise(piece)
    )


def html_unescape(s: Column) -> Column:
    """Decode named and numeric character references."""

    table = F.from_json(F.lit(_names()), "array<map<string,string>>")

    def decoded(s: Column) -> Column:
        pieces = F.regexp_extract_all(s, F.lit(ENTITY_PIECES), F.lit(0))
        # The table is a constant that stands in the expression once.
        joined = let(table, lambda names: F.array_join(F.transform(pieces, lambda p: _entity(p, names)), ""))
        return F.when(s.contains("&"), joined).otherwise(s)

    return let(s, decoded)
