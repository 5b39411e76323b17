"""CSS selectors as conditions on a token.

Supported: tag, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]`` with ``~= ^= $= *=`` and the
``i`` flag, compounds of these, descendants (blank) and lists (comma).
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import is_element

PIECE = re.compile(
    r"""(?P<tag>[A-Za-z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<value>"[^"]*"|'[^']*'|[\w-]+)\s*(?P<flag>[iI])?\s*)?\]""",
    re.X,
)
OUTSIDE = r"""(?=(?:[^"'\[\]]|\[[^\]]*\])*$)"""


def _test(part: re.Match, t: Column) -> Column:
    if part["tag"]:
        return F.lit(True) if part["tag"] == "*" else t.tag == part["tag"].lower()
    if part["cls"]:
        return F.concat(F.lit(" "), t.cls, F.lit(" ")).contains(f" {part['cls']} ")
    if part["id"]:
        return F.coalesce(t.attrs["id"] == part["id"], F.lit(False))
    found = t.attrs[part["attr"].lower()]
    if not part["op"]:
        return found.isNotNull()
    value = part["value"].strip("\"'")
    if part["flag"]:
        found, value = F.lower(found), value.lower()
    if part["op"] == "=":
        hit = found == value
    elif value == "":
        hit = F.lit(False)
    elif part["op"] == "~=":
        hit = F.array_contains(F.split(found, r"\s+"), value)
    elif part["op"] == "^=":
        hit = found.startswith(value)
    elif part["op"] == "$=":
        hit = found.endswith(value)
    else:
        hit = found.contains(value)
    return F.coalesce(hit, F.lit(False))


def _compound(text: str):
    parts, at = [], 0
    while at < len(text):
        m = PIECE.match(text, at)
        if m is None or (m["tag"] and at > 0):
            raise ValueError(f"Invalid item selector '{text}'")
        parts.append(m)
        at = m.end()
    return lambda t: reduce(and_, [_test(p, t) for p in parts])


def _descendant(steps: list, tokens: Column, t: Column) -> Column:
    """Walk up the parents of ``t``, ticking off the steps from the right."""
    above = steps[:-1]

    def climb(acc: Column, _: Column) -> Column:
        here = F.get(tokens, acc.at)
        hit = reduce(
            or_, [(acc.left == k) & step(here) for k, step in enumerate(above, 1)]
        )
        return F.struct(
            here.parent.alias("at"),
            F.when(hit, acc.left - 1).otherwise(acc.left).alias("left"),
        )

    zero = F.struct(t.parent.alias("at"), F.lit(len(above)).alias("left"))
    up = F.when(t.depth > 1, F.sequence(F.lit(1), t.depth - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(up, zero, climb, lambda acc: acc.left == 0)


def matcher(selector: str):
    """``(tokens, token) -> boolean Column``; a bad selector raises ValueError."""
    options = []
    for option in re.split("," + OUTSIDE, selector):
        if not option.strip():
            raise ValueError(f"Invalid item selector '{selector}'")
        options.append([_compound(s) for s in re.split(r"\s+" + OUTSIDE, option.strip())])

    def match(tokens: Column, t: Column) -> Column:
        tests = []
        for steps in options:
            own = is_element(t) & steps[-1](t)
            tests.append(F.when(own, _descendant(steps, tokens, t)).otherwise(False) if len(steps) > 1 else own)
        return reduce(or_, tests)

    return match


def select(tokens: Column, selector: str, within: Column | None = None) -> Column:
    """Matching tokens in document order, of ``within`` if given (a part of ``tokens``)."""
    match = matcher(selector)
    return F.filter(tokens if within is None else within, lambda t: match(tokens, t))


def select_one(tokens: Column, selector: str, within: Column | None = None) -> Column:
    return F.get(select(tokens, selector, within), F.lit(0))
