"""Counts, completeness and report orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_rank, strip_ws
from ..functions.urls import host_or_local
from ..session import stored

# Rows shown in the report's previews.
PREVIEW_ROWS = {"items": 2000, "links": 1000, "images": 500, "tables": 500}


def run_counts(
    extracted: DataFrame, checked_links: int = 0, deduped_items: int = 0
) -> DataFrame:
    """``what, n`` over the pages of ``extract_pages``; sizes are read from the page rows, so
    nothing is exploded."""
    sizes = {f: F.sum(F.size(c)) for f, c in [
        ("items", "items"), ("links", "links"), ("images", "images"), ("tables", "tables"),
        ("qa_issues", "issues"),
    ]}
    totals = extracted.agg(
        F.count("*").alias("pages"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in sizes.items()],
        F.lit(checked_links).cast("bigint").alias("checked_links"),
        F.lit(deduped_items).cast("bigint").alias("deduped_items"),
    )
    return totals.unpivot([], totals.columns, "what", "n")


def page_metrics(extracted: DataFrame) -> DataFrame:
    """Rows of each family per page."""
    return extracted.select(
        "page_id",
        *[F.size(c).alias(f"n_{c}") for c in ("items", "links", "images", "tables", "issues")],
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def completeness(items: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: items, missing fields, repeated fingerprints, issues and High issues."""

    def missing(c: str) -> Column:
        return F.count_if(strip_ws(F.coalesce(F.col(c), F.lit(""))) == "").alias(f"missing_{c}")

    fp = F.when(F.col("fingerprint") != "", F.col("fingerprint"))
    per_item = items.agg(
        F.count("*").alias("total"),
        *[missing(c) for c in ("title", "price", "link", "image")],
        (F.count(fp) - F.count_distinct(fp)).alias("duplicate_fingerprints"),
    )
    per_issue = issues.agg(
        F.count("*").alias("qa_issues_total"),
        F.count_if(F.lower("severity") == "high").alias("qa_issues_high"),
    )
    # one row each, brought together by a sum and not by a join
    both = per_item.unionByName(per_issue, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def quality_summary(done: DataFrame) -> DataFrame:
    """One sentence per ``completeness`` row."""

    def part(c: str, words: str) -> Column:
        return F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {words}")))

    text = F.concat_ws(
        "; ",
        part("missing_title", "missing titles"),
        part("missing_price", "missing prices"),
        part("duplicate_fingerprints", "duplicates"),
        part("qa_issues_high", "HIGH-severity issues"),
    )
    clean = "clean — all rows complete, no HIGH-severity issues"
    return done.select(F.when(text == "", clean).otherwise(text).alias("summary"))


def run_meta(
    extracted: DataFrame,
    method: str = "static",
    preset: str = "",
    mode: str = "single",
    secs: float = 0.0,
    checked: int = 0,
    deduped_items: int = 0,
    session: str = "",
    concurrency: int = 1,
    strict: bool = False,
    resumed_from: str = "",
) -> DataFrame:
    """One row about the run; url and selector are those of the first page."""
    head = F.struct("url", "selector")
    first = extracted.agg(F.min_by(head, "page_id").alias("first"), F.count("*").alias("pages"))
    url = F.col("first.url")
    return first.where("pages > 0").select(
        url.alias("url"),
        host_or_local(url).alias("host"),
        F.current_timestamp().alias("when"),
        F.lit(method).alias("method"),
        F.lit(float(secs)).alias("secs"),
        F.col("pages"),
        F.lit(checked).alias("checked"),
        F.col("first.selector").alias("selector"),
        F.lit(preset).alias("preset"),
        F.lit(session).alias("session"),
        F.lit(mode).alias("mode"),
        (F.col("pages") if mode == "crawl" else F.lit(0).cast("bigint")).alias("crawled_urls"),
        F.lit(deduped_items).alias("deduped_items"),
        F.lit(concurrency if mode == "crawl" else 1).alias("concurrency"),
        F.lit(strict).alias("strict"),
        F.lit(resumed_from).alias("resumed_from"),
    )


def sort_issues(issues: DataFrame) -> DataFrame:
    """High first, then in page order."""
    return issues.orderBy(severity_rank(F.col("severity")), "page_id", "pos")


def preview(df: DataFrame, kind: str, rows: int | None = None) -> DataFrame:
    """The first rows a report shows of a family."""
    return df.orderBy(*_own_order(df)).limit(PREVIEW_ROWS[kind] if rows is None else rows)


def _own_order(df: DataFrame) -> list[Column]:
    order = [c for c in ("page_id", "table_no", "index", "pos", "row_no", "col_no") if c in df.columns]
    return [F.col(f"`{c}`") for c in order]


def natural_key(text: Column) -> Column:
    """A text that sorts as people sort: runs of digits by value, letters by alphabet and not by case.

    A run of digits is its length, without zeros in front, and its digits."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def sortable(piece: Column) -> Column:
        digits = F.regexp_replace(piece, "^0+(?=.)", "")
        return F.when(piece.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)).otherwise(piece)

    return F.array_join(F.transform(pieces, sortable), "")


def report_number(cell: Column) -> Column:
    """The number that a cell is, with at most four other characters on either side; else null."""
    found = F.regexp_extract(cell, r"(?U)^\s*[^0-9\-\s]{0,4}\s?(-?[0-9][0-9,]*(?:\.[0-9]+)?)\s?[^0-9\s]{0,4}\s*$", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")


def report_sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Rows whose cell reads as a number by number, the others after them in natural order of their text, in
    the alphabet's order of Unicode.  Equal cells keep the order of the rows.  Descending turns it round."""
    cell = F.trim(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))
    number = report_number(cell)
    key = F.collate(F.when(number.isNull(), natural_key(cell)), "UNICODE")
    if ascending:
        return df.orderBy(number.asc_nulls_last(), key.asc(), *_own_order(df))
    return df.orderBy(number.desc_nulls_first(), key.desc(), *_own_order(df))


def with_place(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a sorted table with their place in it, from 1.

    The sort leaves ranges of rows; they are stored with their place in the range, and only one count for each range
    comes to the driver, so no task numbers all rows."""
    spark = ordered.sparkSession
    kept = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "places")
    part, within = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(kept.groupBy(part.alias("part")).count().collect())
    before = [(r["part"], sum(q["count"] for q in sizes[:n])) for n, r in enumerate(sizes)]
    moves = spark.createDataFrame(before, "_part int, _before bigint")
    placed = kept.withColumn("_part", part).join(F.broadcast(moves), "_part")
    return placed.select((F.col("_before") + within + 1).alias(name), *[F.col(f"`{c}`") for c in ordered.columns])
