"""Link checks: which links to ask for, and the answers joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_http, url_netloc, url_norm
from .classify import link_status
from .joins import salted_join


def link_candidates(links: DataFrame, external: bool = False, n: int | None = None) -> DataFrame:
    """Distinct http(s) link targets in order of first use; the first ``n`` if given.

    Targets are counted once per task before the shuffle, and a limit is a top-n per task.
    """
    kinds = ["internal", "external"] if external else ["internal"]
    firsts = (
        links.where(F.col("type").isin(kinds) & is_http(F.col("href")))
        .groupBy("href")
        .agg(F.min(F.struct("page_id", "pos")).alias("at"))
    )
    if n is not None:
        firsts = firsts.orderBy("at").limit(n)
    return firsts.select("href", F.col("at.page_id").alias("page_id"), F.col("at.pos").alias("pos"))


def link_results(responses: DataFrame) -> DataFrame:
    """``href, status, detail`` from ``href, code, error``: the error's name or the code."""
    status = link_status(F.col("code"), F.col("error"))
    detail = F.when(status == "ERROR", F.col("error")).otherwise(F.col("code").cast("string"))
    return responses.select("href", status.alias("status"), detail.alias("detail"))


def check_links(links: DataFrame, responses: DataFrame) -> DataFrame:
    """Fill status and detail of links from one response per href; '' where there is none.

    The home page's link may be a third of all rows: the join deals such an href over many tasks.
    """
    found = link_results(responses).select(
        "href", F.col("status").alias("_status"), F.col("detail").alias("_detail")
    )
    joined = salted_join(links.drop("status", "detail"), found, "href", "left")
    return joined.select(
        "page_id",
        "pos",
        "text",
        "href",
        "type",
        F.coalesce("_status", F.lit("")).alias("status"),
        F.coalesce("_detail", F.lit("")).alias("detail"),
    )


def broken_links(responses: DataFrame) -> DataFrame:
    """Run-level issues, without page, for broken links and failed checks."""
    bad = link_results(responses).where("status in ('BROKEN', 'ERROR')")
    broken = F.col("status") == "BROKEN"
    return bad.select(
        F.lit(None).cast("bigint").alias("page_id"),
        F.when(broken, "High").otherwise("Medium").alias("severity"),
        F.when(broken, "Broken link").otherwise("Link check failed").alias("check"),
        F.concat("status", F.lit(" ("), "detail", F.lit(")")).alias("detail"),
        F.col("href").alias("where"),
    )


def crawlable_links(links: DataFrame, same_host: str = "") -> DataFrame:
    """Links a crawl would follow: ``page_id, pos, url`` normalised, of one host if given."""
    target = url_norm(F.col("href"))
    found = links.where(F.col("type").isin("internal", "external")).select(
        "page_id", "pos", target.alias("url")
    )
    found = found.where(is_http(F.col("url")))
    return found.where(url_netloc(F.col("url")) == same_host) if same_host else found
