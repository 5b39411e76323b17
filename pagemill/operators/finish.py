"""A finished run: what was extracted, with link checks, without repeated items, issues in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_rank
from .dedupe import dedupe_items
from .links import broken_links, check_links
from .pages import family


def finished_run(run: DataFrame, responses: DataFrame) -> dict[str, DataFrame]:
    """The tables of a run from its page rows and the answers of link checks (``href, code, error``).

    Links carry status and detail, items are the first of each fingerprint and carry it, and issues
    hold those of broken links too, with ``rank`` for the order of severity.  ``run`` should come
    from ``save_extracted``: each table then reads the columns it needs.
    """
    links = family(run, "links")
    hrefs = links.select("href").distinct()
    asked = responses.join(hrefs, "href", "left_semi")
    issues = family(run, "issues").unionByName(broken_links(asked), allowMissingColumns=True)
    return {
        "items": dedupe_items(family(run, "items")),
        "links": check_links(links, responses),
        "images": family(run, "images"),
        "headings": family(run, "headings"),
        "qa_issues": issues.withColumn("rank", severity_rank(F.col("severity"))),
    }


def finished_counts(run: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``what, n``: pages, items found and kept, links and checked links, and issues by severity."""
    one = F.count("*").alias("n")
    parts = [
        run.select(F.lit("pages").alias("what")).groupBy("what").agg(one),
        run.select(F.lit("items").alias("what"), F.size("items").cast("long").alias("n")).groupBy("what").agg(F.sum("n").alias("n")),
        tables["items"].select(F.lit("deduped_items").alias("what")).groupBy("what").agg(one),
        tables["links"].groupBy(F.when(F.col("status") == "", "unchecked_links").otherwise("checked_links").alias("what")).agg(one),
        tables["qa_issues"].groupBy(F.concat(F.lit("issues_"), F.lower("severity")).alias("what")).agg(one),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
