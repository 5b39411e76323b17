"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 1_000_000


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "left", heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """``left.join(right, key, how)`` for a ``left`` with keys of very many rows and a ``right`` with
    few rows for a key; for keys that are unique on the left use a plain join.

    The rows of every key of ``left`` are counted, summed by task before the shuffle.  A key of more
    than ``heavy_rows`` is cut in as many parts as its count asks for, by a hash of the row, and only
    its rows of ``right`` are there once for each part; all other keys stay as they are.  The table
    of heavy keys is broadcast: it has at most one row for ``heavy_rows`` rows of ``left``.  The hash
    is repeatable, so a lost task can be run again.  ``how`` is left, inner, left_semi or left_anti.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    counts = left.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.count("*").alias("_n"))
    heavy = counts.where((F.col("_n") > heavy_rows) & F.col("_key").isNotNull())
    heavy = F.broadcast(heavy.select("_key", F.ceil(F.col("_n") / heavy_rows).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    others = [f"`{c}`" for c in left.columns if c != key]
    hashed = F.xxhash64(*others) if others else F.lit(0).cast("long")
    dealt = left.join(heavy, left[key] == heavy["_key"], "left")
    dealt = dealt.withColumn("_salt", F.pmod(hashed, parts).cast("int")).drop("_key", "_parts")
    copies = right.join(heavy, right[key] == heavy["_key"], "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_key", "_parts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")
