"""Walks over links: breadth-first crawl and pagination chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import is_single_document, url_netloc, url_norm
from ..session import bucketed, discard, stored
from .joins import HEAVY_ROWS, salted_join
from .rows import links_column, with_visible

MERGE_EVERY = 8


def _numbered(marked: DataFrame, start: int) -> tuple[DataFrame, DataFrame, int]:
    """Number the ``live`` rows in order of ``order_key``, from ``start`` + 1.

    The sort splits the rows into ranges, which are stored.  Each range is numbered for itself and
    then moved by the live rows before it; only one count per range comes to the driver.
    """
    spark = marked.sparkSession
    kept = stored(
        marked.sort("order_key").withColumn("part", F.spark_partition_id()), "crawl-round"
    )
    sizes = kept.groupBy("part").agg(F.count_if("live").alias("live")).collect()
    before, lives = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before.append((r["part"], start + lives))
        lives += r["live"]
    within = Window.partitionBy("part").orderBy("order_key")
    moves = spark.createDataFrame(before, "part int, before bigint")
    numbered = (
        kept.where("live")
        .withColumn("at", F.row_number().over(within))
        .join(moves, "part")
        .select("url", (F.col("at") + F.col("before")).alias("visit_no"))
    )
    return kept, numbered, lives


def page_edges(pages: DataFrame) -> DataFrame:
    """``src_url, dst_url, pos``: the links of fetched pages that a crawl could follow.

    Where pages have a ``final_url``, the URL after redirects, links are resolved against it; the
    source stays the URL that was asked for, under which ``crawl`` knows the page.
    """
    asked = pages.select("*", F.col("url").alias("src_url"))
    if "final_url" in pages.columns:
        asked = asked.withColumn("url", F.coalesce("final_url", "url")).drop("final_url")
    links = with_visible(asked.select("src_url", "url", "html")).select("src_url", F.inline(links_column()))
    return links.where(F.col("type").isin("internal", "external")).select(
        "src_url", F.col("href").alias("dst_url"), "pos"
    )


def crawl(
    seeds: str,
    edges: DataFrame,
    fetched: DataFrame,
    max_pages: int | None = None,
    same_host: bool = True,
    disallowed: DataFrame | None = None,
) -> DataFrame:
    """Breadth-first walk from one URL: ``url, depth, visit_no`` in order of visit.

    ``edges`` has ``src_url, dst_url, pos``; ``fetched`` the URLs (``url``) that answer;
    ``disallowed`` those that robots.txt forbids.  URLs that do not answer or are forbidden are
    seen but neither counted nor followed.  The walk ends after ``max_pages`` pages, if given.

    One round per depth.  The round's new URLs are the targets of the last round's pages without
    the URLs seen before, each with its smallest (parent's number, position); tasks keep one row
    per target before the shuffle.  Links are stored once, in buckets of their source, and pages that
    answer in buckets of their URL, so a round shuffles its frontier and never those tables; the links of a source with
    more than ``HEAVY_ROWS`` are cut in parts over several buckets.  Every round is stored in the
    shared folder, so a lost executor costs no more than the running round, and only counts come to the driver.
    """
    spark = edges.sparkSession
    host = url_netloc(F.lit(seeds))
    links = edges.select(
        url_norm(F.col("src_url")).alias("src_url"), url_norm(F.col("dst_url")).alias("url"), "pos"
    ).where(F.col("url").startswith("http://") | F.col("url").startswith("https://"))
    if same_host:
        links = links.where(url_netloc(F.col("url")) == host)
    graph = LinkGraph(links)
    live = fetched.select(url_norm(F.col("url")).alias("url")).distinct()
    if disallowed is not None:
        barred = disallowed.select(url_norm(F.col("url")).alias("url")).distinct()
        live = live.join(barred, "url", "left_anti")
    live = bucketed(live.withColumn("live", F.lit(True)), "crawl-live", "url")

    fresh = spark.range(1).select(
        url_norm(F.lit(seeds)).alias("url"),
        F.struct(F.lit(0).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("pos")).alias(
            "order_key"
        ),
    )
    rounds: list[DataFrame] = []
    seen: list[DataFrame] = []
    used: list[DataFrame] = []
    depth, total = 0, 0
    while max_pages is None or total < max_pages:
        marked = fresh.join(live, "url", "left").withColumn("live", F.col("live").isNotNull())
        kept, visited, found = _numbered(marked, total)
        used.append(kept)
        if found == 0:
            break
        if max_pages is not None:
            visited = visited.where(F.col("visit_no") <= max_pages)
        visited = visited.withColumn("depth", F.lit(depth))
        seen.append(kept.select("url"))
        rounds.append(visited)
        if len(rounds) > MERGE_EVERY:
            seen = [stored(_union(seen), "crawl-seen")]
            rounds = [stored(_union(rounds), "crawl-rounds")]
            discard(*used[:-1])  # this round's table is read once more
            used = [*seen, *rounds, kept]
        total, depth = total + found, depth + 1
        parents = visited.select(F.col("url").alias("src_url"), F.col("visit_no").alias("parent"))
        fresh = (
            graph.targets(parents)
            .groupBy("url")
            .agg(F.min(F.struct("parent", F.col("pos").cast("bigint").alias("pos"))).alias("order_key"))
            .join(_union(seen), "url", "left_anti")
        )
    if rounds:
        rows = _union(rounds).select("url", "depth", F.col("visit_no").cast("bigint").alias("visit_no"))
        walked = stored(rows, "crawl")
    else:
        walked = spark.createDataFrame([], "url string, depth int, visit_no bigint")
    discard(live, *used, *graph.tables)
    return walked


class LinkGraph:
    """Links in buckets of their source; the links of a heavy source lie in several."""

    def __init__(self, links: DataFrame, heavy_rows: int = HEAVY_ROWS):
        counts = links.groupBy("src_url").agg(F.count("*").alias("n")).where(F.col("n") > heavy_rows)
        # At most one row for heavy_rows links.
        self.heavy = stored(counts.select("src_url", F.ceil(F.col("n") / heavy_rows).cast("int").alias("parts")), "crawl-heavy")
        parts = F.coalesce("parts", F.lit(1))
        dealt = links.join(F.broadcast(self.heavy), "src_url", "left")
        dealt = dealt.select("src_url", F.pmod(F.xxhash64("url", "pos"), parts).cast("int").alias("part"), "url", "pos")
        self.links = bucketed(dealt, "crawl-links", "src_url", "part")
        self.tables = [self.heavy, self.links]

    def targets(self, parents: DataFrame) -> DataFrame:
        """``src_url, part, parent, url, pos``: the links of ``src_url, parent``."""
        split = parents.join(F.broadcast(self.heavy), "src_url", "left")
        parts = F.coalesce("parts", F.lit(1))
        split = split.select("src_url", "parent", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        return split.join(self.links, ["src_url", "part"])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def paginate(
    starts: DataFrame,
    next_links: DataFrame,
    max_pages: int | None = None,
    disallowed: DataFrame | None = None,
    ignore_robots: bool = False,
) -> DataFrame:
    """Follow ``next_url`` from every start: ``start, page_no, url``.

    ``starts`` has ``url``; ``next_links`` has ``url, next_url``.  A chain ends at ``max_pages``, if given,
    at a page without next, at a page it has been to, and for a start that is a single document.
    A forbidden first page is read all the same; a later one ends the chain, unless
    ``ignore_robots``.  Of several next links of a page the first in text order counts.

    Chains double in every round: behind the n pages known of a start come the pages n steps after each, which
    a table of n-step jumps gives.  A page has one next, so all that follows a repeated page is
    repeated too: the first round that brings fewer than n new pages ends a chain.  A chain of n pages takes
    log2(n) rounds; every round is stored.
    """
    follow = next_links.where("next_url is not null and next_url != ''").select("url", "next_url")
    if disallowed is not None and not ignore_robots:
        barred = disallowed.select(F.col("url").alias("next_url")).distinct()
        follow = follow.join(barred, "next_url", "left_anti")
    jumps = stored(follow.groupBy("url").agg(F.min("next_url").alias("next_url")), "pages-jumps")
    first = starts.select(F.col("url").alias("start"), F.lit(1).alias("page_no"), "url").distinct()
    first = stored(first, "pages")
    known = first.where(~is_single_document(F.col("start")))
    done, used, length = [first], [], 1
    while max_pages is None or length < max_pages:
        ahead = salted_join(known, jumps, "url", "inner").select(
            "start", (F.col("page_no") + length).alias("page_no"), F.col("next_url").alias("url")
        )
        both = known.unionByName(ahead).groupBy("start", "url").agg(F.min("page_no").alias("page_no"))
        both = stored(both.select("start", "page_no", "url"), "pages")
        fresh = both.where(F.col("page_no") > length)
        full = fresh.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") == length).select("start")
        done.append(fresh)
        full = stored(full, "pages-open")
        used += [both, full, jumps]
        if full.isEmpty():
            break
        known = salted_join(both, full, "start", "left_semi")
        further = jumps.select(F.col("url").alias("from_url"), F.col("next_url").alias("url"))
        further = salted_join(further, jumps, "url", "inner")
        jumps = stored(further.select(F.col("from_url").alias("url"), "next_url"), "pages-jumps")
        length *= 2
    chains = _union(done)
    if max_pages is not None:
        chains = chains.where(F.col("page_no") <= max(1, max_pages))
    chains = stored(chains, "pages-chains")
    discard(first, jumps, *used)
    return chains
