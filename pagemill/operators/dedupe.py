"""Fingerprints and removal of duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_netloc, url_norm, url_path


def fingerprint(link: Column, image: Column, title: Column, price: Column, text: Column) -> Column:
    """Key by link without scheme and query, else image and title, else title and price, else text."""
    key = (
        F.when(link != "", F.concat(url_netloc(link), url_path(link)))
        .when((image != "") & (title != ""), F.concat(image, F.lit("|"), title))
        .when(title != "", F.concat(title, F.lit("|"), price))
        .otherwise(text)
    )
    return F.substring(F.sha1(key), 1, 16)


def with_fingerprint(items: DataFrame) -> DataFrame:
    return items.withColumn(
        "fingerprint", fingerprint(*map(F.col, ("link", "image", "title", "price", "text")))
    )


def _bits(kind: str) -> int | None:
    return {"boolean": 1, "tinyint": 8, "smallint": 16, "int": 32, "date": 32, "bigint": 64, "timestamp": 64, "timestamp_ntz": 64}.get(kind)


def _whole_number(column: Column, kind: str) -> Column:
    if kind == "date":
        return F.unix_date(column)
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    return column.cast("bigint")


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def row_address(df: DataFrame, order: Sequence[str]) -> Column:
    """A value that orders rows by the columns, ties by hash of the row.

    Whole numbers and times are packed in one decimal of 38 digits, which a hash aggregate holds in
    place; other columns become a struct.  Null is before all values."""
    kinds = dict(df.dtypes)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not kinds[c].startswith(("map", "variant"))])
    widths = [_bits(kinds[c]) for c in order]
    if None in widths or sum(widths) + len(widths) > 110:
        return F.struct(*[F.col(f"`{c}`") for c in order], row_hash.alias("_hash"))
    left = min(63, 122 - sum(widths) - len(widths))
    packed = _big(0)
    for c, width in zip(order, widths, strict=True):
        value = _whole_number(F.col(f"`{c}`"), kinds[c]).cast("decimal(38,0)") + _big(2 ** (width - 1) + 1)
        packed = packed * _big(2 ** (width + 1)) + F.coalesce(value, _big(0))
        packed = packed.cast("decimal(38,0)")
    tie = F.pmod(row_hash, F.lit(2**left if left < 63 else 2**63 - 1)).cast("decimal(38,0)")
    return (packed * _big(2**left) + tie).cast("decimal(38,0)")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first row of each key, or the last one, in the order of the columns; of equal rows one.

    Two phases: the best address of each key by a hash aggregate over keys and addresses, then the
    rows at those addresses.  No whole row is sorted or aggregated; addresses differ from row to row,
    so a key of very many rows is spread over all tasks."""
    addressed = df.withColumn("_address", row_address(df, order))
    best = addressed.groupBy(*[F.col(f"`{k}`").alias(f"_key{n}") for n, k in enumerate(keys)])
    best = best.agg((F.max if last else F.min)("_address").alias("_best"))
    same = addressed["_address"] == best["_best"]
    for n, k in enumerate(keys):
        same = same & addressed[f"`{k}`"].eqNullSafe(best[f"_key{n}"])
    return addressed.join(best, same, "left_semi").distinct().select(*[F.col(f"`{c}`") for c in df.columns])


def dedupe_items(items: DataFrame) -> DataFrame:
    """First item of each fingerprint in (page_id, index) order."""
    marked = with_fingerprint(items)
    columns = [c for c in marked.columns if c != "fingerprint"] + ["fingerprint"]
    return first_rows(marked, ["fingerprint"], ["page_id", "index"]).select(*[F.col(f"`{c}`") for c in columns])


def dedupe_stats(items: DataFrame) -> DataFrame:
    """One row: items, unique, removed."""
    per_key = with_fingerprint(items).groupBy("fingerprint").agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count("*").alias("unique")
    ).select("items", "unique", (F.col("items") - F.col("unique")).alias("removed"))


def dedupe_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct URLs without fragment and trailing slash."""
    return urls.select(url_norm(F.col(url)).alias("norm_url")).distinct()
