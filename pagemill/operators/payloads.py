"""Items from JSON payloads and from the text of model replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip_json_fences

# Key names per field, in order of preference.
FIELD_NAMES = {
    "title": ["title", "name", "product_name", "heading", "headline"],
    "price": ["price", "cost", "amount", "value"],
    "link": ["url", "link", "href", "permalink"],
    "image": ["image", "img", "image_url", "thumbnail", "photo"],
    "text": ["description", "text", "summary", "body", "content"],
}
FALSY = r'^\s*(\{\s*\}|\[\s*\]|""|-?0(\.0*)?|false|null)\s*$'
VARIANTS = "array<variant>"
OBJECT = "map<string,variant>"


def try_json(text: Column) -> Column:
    """VARIANT of the whole text, null when it is no JSON."""
    return F.try_parse_json(text)


def _none() -> Column:
    return F.array().cast(VARIANTS)


def _child(value: Column, name: str) -> Column:
    """Value under a key; a path cannot spell every key, a map can."""
    if re.fullmatch(r"[\w $:@-]+", name):
        return F.try_variant_get(value, f"$['{name}']", "variant")
    return F.element_at(F.try_variant_get(value, "$", OBJECT), F.lit(name))


def json_path(value: Column, path: str) -> Column:
    """Values at a dotted path as ``array<variant>``.

    ``[*]`` spreads a list and ends the path.  A list met on the way gives one key of each of its
    objects and ends the path too.  A missing key or a scalar on the way gives nothing.
    """
    steps: list[str] = []
    for part in path.split(".") if path else []:
        head = part.replace("[*]", "")
        if head or "[*]" not in part:
            steps.append(head)
        if "[*]" in part:
            steps.append("*")

    def as_list(v: Column) -> Column:
        return F.try_variant_get(v, "$", VARIANTS)

    def present(v: Column) -> Column:
        return v.isNotNull() & ~F.is_variant_null(v)

    def walk(v: Column, rest: list[str]) -> Column:
        if not rest:
            return F.coalesce(as_list(v), F.array(v))
        if rest[0] == "*":
            return F.coalesce(as_list(v), _none())

        def child(of: Column) -> Column:
            return _child(of, rest[0])

        def of_list(items: Column) -> Column:
            return F.filter(F.transform(items, child), present)

        inner = let(child(v), lambda c: F.when(present(c), walk(c, rest[1:])).otherwise(_none()))
        return let(as_list(v), lambda a: F.when(a.isNotNull(), of_list(a)).otherwise(inner))

    return F.when(value.isNotNull(), walk(value, steps)).otherwise(_none())


def objects_of(rows: Column) -> Column:
    """The objects among values, each as ``map<string,variant>``."""
    return F.filter(
        F.transform(rows, lambda v: F.try_variant_get(v, "$", OBJECT)), lambda m: m.isNotNull()
    )


def field_map_column(keys: Column) -> Column:
    """``map<field, key>`` guessed from the keys of one object; '' where nothing fits."""
    keys = F.coalesce(keys, F.array().cast("array<string>"))

    def pick(keys: Column, names: list[str]) -> Column:
        hits = F.transform(
            F.array(*map(F.lit, names)),
            lambda n: F.element_at(
                F.concat(F.array(F.lit("")), F.filter(keys, lambda k: F.lower(k) == n)), -1
            ),
        )
        return F.coalesce(F.get(F.filter(hits, lambda h: h != ""), F.lit(0)), F.lit(""))

    def fields(keys: Column) -> Column:
        pairs = [x for f, names in FIELD_NAMES.items() for x in (F.lit(f), pick(keys, names))]
        return F.create_map(*pairs)

    return let(keys, fields)


def get_by_path(fields: Column, key: Column) -> Column:
    """Text at a dotted key of an object given as ``map<string,variant>``; '' when missing."""

    def step(v: Column, part: Column) -> Column:
        return F.element_at(F.try_variant_get(v, "$", OBJECT), part)

    def found(parts: Column) -> Column:
        return F.aggregate(
            F.slice(parts, F.lit(2), F.size(parts)), F.element_at(fields, F.get(parts, F.lit(0))), step
        )

    def text(v: Column) -> Column:
        gone = v.isNull() | F.is_variant_null(v)
        return F.when(gone, "").otherwise(
            F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
        )

    return F.when(key == "", "").otherwise(let(let(F.split(key, r"\."), found), text))


def item_rows(rows: Column, field_map: dict[str, str] | None, max_items: int | None) -> Column:
    """Array of item structs from the objects among ``rows``."""

    def build(objects: Column) -> Column:
        if field_map is None:
            keys = field_map_column(F.map_keys(F.get(objects, F.lit(0))))
        else:
            keys = F.create_map(
                *[F.lit(x) for f in FIELD_NAMES for x in (f, field_map.get(f, ""))]
            )
        chosen = objects if max_items is None else F.slice(objects, 1, max_items)

        def item(k: Column) -> Column:
            return F.transform(
                chosen,
                lambda m, i: F.struct(
                    (i + 1).cast("int").alias("index"),
                    *[get_by_path(m, k[f]).alias(f) for f in FIELD_NAMES],
                ),
            )

        return let(keys, item)

    return let(objects_of(rows), build)


def items_from_json(
    payloads: DataFrame,
    path: str = "",
    field_map: dict[str, str] | None = None,
    max_items: int | None = None,
    body: str = "body",
) -> DataFrame:
    """Items of each payload's list at ``path``: other columns, index, title, price, link, image,
    text.  Without ``field_map`` the keys are guessed from the first object of the payload.  All
    items of a payload are returned unless ``max_items`` is given.

    Of a key that an object has twice the last value counts where the session sets
    ``spark.sql.variant.allowDuplicateKeys``; else the payload is in ``rejected_payloads``."""
    text = F.col(body)
    value = F.when(~text.rlike(FALSY), F.try_parse_json(text))
    kept = [c for c in payloads.columns if c != body]
    parsed = payloads.select(*kept, F.inline(F.array(F.struct(value.alias("_json")))))
    items = item_rows(json_path(F.col("_json"), path), field_map, max_items)
    return parsed.select(*kept, F.inline(items))


def rejected_payloads(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Other columns and body of the payloads that can't be read as JSON: no JSON, repeated keys
    where the session doesn't allow them, or more than a VARIANT holds."""
    text = F.col(body)
    unread = text.isNull() | F.try_parse_json(text).isNull()
    return payloads.where(unread & ~F.coalesce(text.rlike(FALSY), F.lit(False)))


def json_field_map(payloads: DataFrame, path: str = "", body: str = "body") -> DataFrame:
    """The guessed key of every field, one row per payload and field."""
    kept = [c for c in payloads.columns if c != body]
    value = F.when(~F.col(body).rlike(FALSY), F.try_parse_json(F.col(body)))
    first = F.get(objects_of(json_path(value, path)), F.lit(0))
    keys = payloads.select(*kept, F.map_keys(first).alias("_keys"))
    return keys.where("_keys is not null").select(
        *kept, F.explode(field_map_column(F.col("_keys"))).alias("field", "key")
    )


def items_from_reply(replies: DataFrame, text: str = "text") -> DataFrame:
    """Items listed in a model's reply: fences stripped, a list or an object holding one under
    ``items`` or ``data``; anything else gives no rows."""
    kept = [c for c in replies.columns if c != text]
    value = F.try_parse_json(strip_json_fences(F.col(text)))
    parsed = replies.select(*kept, F.inline(F.array(F.struct(value.alias("_json")))))

    def listed(v: Column) -> Column:
        def at(key: str) -> Column:
            found = F.try_variant_get(v, f"$.{key}", VARIANTS)
            return F.when(F.size(found) > 0, found)

        own = F.try_variant_get(v, "$", VARIANTS)
        return F.coalesce(own, at("items"), at("data"), _none())

    names = {f: f for f in FIELD_NAMES}
    return parsed.select(*kept, F.inline(item_rows(listed(F.col("_json")), names, None)))
