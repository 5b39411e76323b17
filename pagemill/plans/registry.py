"""The registered queries: every operator over whole tables, by name."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ur
from ..functions.markup import raw_tokens, tag_name
from ..operators import classify, crawl, dedupe, finish, guarded, incremental, links, payloads, records, rows, summary
from ..operators import pages as whole
from ..operators.presets import presets_table
from ..sources import readers, writers
from ..session import new_folder, stored
from ..streaming import live
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def no_pos(df: DataFrame) -> DataFrame:
    return df.drop("pos")


# ---------------------------------------------------------------- pages as they are


@query
def page_header(spark, d):
    return rows.page_header(fx.pages(spark, d))


@query
def extract_links(spark, d):
    return rows.extract_links(fx.pages(spark, d))


@query
def links_by_host(spark, d):
    return rows.links_by_host(fx.pages(spark, d))


@query
def extract_headings(spark, d):
    return rows.extract_headings(fx.pages(spark, d))


@query
def token_counts(spark, d):
    return fx.pages(spark, d).select(
        "page_id", F.size(raw_tokens(F.col("html"))).alias("n_tokens")
    )


@query
def tag_histogram(spark, d):
    tokens = fx.pages(spark, d).select(F.explode(raw_tokens(F.col("html"))).alias("token"))
    tags = tokens.select(tag_name(F.col("token")).alias("tag")).where("tag not in ('', '!')")
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query
def html_nodes(spark, d):
    nodes = records.html_nodes(fx.pages(spark, d))
    return nodes.groupBy("tag").agg(
        F.count("*").alias("n"), F.count_if(F.col("end_pos") < F.col("node_id")).alias("bad_ends")
    )


@query
def nav_nodes(spark, d):
    found = records.select_nodes(fx.pages(spark, d), "nav li a")
    return found.select("page_id", "tag", "text")


@query
def nav_groups(spark, d):
    """A check of ``item_groups``: those groups that SQL can say, of list entries."""
    groups = records.find_item_groups(fx.pages(spark, d))
    return groups.where("selector like '%> li'").select("page_id", "count", "score", "selector")


@query
def item_groups(spark, d):
    """All repeating groups; ``nav_groups`` has those that its SQL can say."""
    return records.find_item_groups(fx.pages(spark, d)).select("page_id", "rank", "count", "score", "selector")


@query
def qa_header(spark, d):
    return no_pos(whole.qa_header(fx.pages(spark, d)))


@query
def qa_summary(spark, d):
    return summary.severity_counts(whole.qa_header(fx.pages(spark, d)))


@query
def page_flags(spark, d):
    return classify.page_flags(fx.pages(spark, d))


@query
def fetch_verdict(spark, d):
    n = F.col("page_id") % 5
    responses = fx.pages(spark, d).select(
        "page_id",
        "html",
        F.when(n == 0, 404).when(n == 1, 503).otherwise(200).alias("status"),
        F.when(F.col("page_id") % 3 == 0, "static")
        .when(F.col("page_id") % 3 == 1, "auto")
        .otherwise("headless")
        .alias("mode"),
    )
    return classify.fetch_verdict(responses).select("page_id", "usable", "next_step")


@query
def detect_cms(spark, d):
    return classify.detect_cms(fx.pages(spark, d))


@query
def detect_platforms(spark, d):
    return classify.detect_cms(fx.platform_pages(spark, d))


@query
def stream_page_header(spark, d):
    stream = live.stream_pages(spark, d, "pages.parquet")
    return live.drain(live.stream_extract(stream, rows.page_header), "page-header")


# ---------------------------------------------------------------- text and URLs


@query
def clean_text(spark, d):
    docs = fx.spread_table(spark, d, "documents")
    return docs.select("doc_id", F.sha1(tx.clean(F.col("text"))).alias("cleaned"))


@query
def price_parse(spark, d):
    docs = fx.spread_table(spark, d, "documents")
    found = docs.select("doc_id", tx.price(F.col("text")).alias("price"))
    return found.select("doc_id", "price", tx.price_amount(F.col("price")).alias("amount"))


@query
def distinct_lines(spark, d):
    docs = fx.spread_table(spark, d, "documents")
    return docs.select(
        "doc_id",
        tx.ordered_distinct_text(F.transform(F.split("text", "\n"), tx.clean)).alias("lines"),
    )


@query
def label_kinds(spark, d):
    turns = fx.table(spark, d, "conversations")
    return turns.groupBy(tx.is_generic_label(tx.clean(F.col("text"))).alias("generic")).agg(
        F.count("*").alias("n")
    )


@query
def url_parts(spark, d):
    u = F.col("url")
    return fx.table(spark, d, "pages").select(
        "page_id",
        ur.url_scheme(u).alias("scheme"),
        ur.url_netloc(u).alias("netloc"),
        ur.url_path(u).alias("path"),
        ur.url_defrag(u).alias("defrag"),
        ur.url_norm(u).alias("norm"),
        ur.host_label(u).alias("label"),
        ur.is_single_document(u).alias("single"),
    )


@query
def url_join(spark, d):
    k = F.col("p_partkey")
    kind = k % 8
    ref = (
        F.when(kind == 0, "//cdn.example.net/a/../b")
        .when(kind == 1, fx.text("/x/./", k, "/../y?z=1#f"))
        .when(kind == 2, fx.text("?page=", k))
        .when(kind == 3, fx.text("../../../up", k))
        .when(kind == 4, fx.text("sub/", k, "/"))
        .when(kind == 5, "mailto:a@example.com")
        .when(kind == 6, fx.text("#s", k))
        .otherwise("")
    )
    base = fx.text("http://h.example.com:80/a/b", k, "/c;p?q=", k, "#old")
    return fx.table(spark, d, "part").select("p_partkey", ur.url_join(base, ref).alias("url"))


@query
def url_dedupe(spark, d):
    return dedupe.dedupe_urls(fx.table(spark, d, "pages"))


@query
def known_hard(spark, d):
    return fx.table(spark, d, "pages").select(
        "page_id", classify.known_hard(F.regexp_replace("url", "example", "amazonx")).alias("reason")
    )


# ---------------------------------------------------------------- records


@query
def catalog_items(spark, d):
    return records.extract_items(fx.catalog_pages(spark, d))


@query
def catalog_groups(spark, d):
    return records.best_item_group(fx.catalog_pages(spark, d)).drop("parent_id")


@query
def catalog_candidates(spark, d):
    return records.top_candidates(fx.faulty_listing(spark, d)).select("page_id", "rank", "count", "selector")


@query
def preset_items(spark, d):
    return records.extract_items(fx.preset_pages(spark, d), preset="auto").select(
        "page_id", "index", "title", "price", "link"
    )


@query
def item_selectors(spark, d):
    return records.item_selectors(fx.preset_pages(spark, d), preset="auto")


@query
def presets(spark, d):
    """The platform of every page joined to its preset."""
    found = classify.detect_cms(fx.platform_pages(spark, d))
    # eight rows whatever the data
    known = F.broadcast(presets_table(spark))
    return found.join(known, found.preset == known.name).select(
        "page_id", "preset", "item_selector", "next_selector"
    )


@query
def book_cards(spark, d):
    return records.extract_book_cards(fx.catalog_pages(spark, d))


@query
def product_page(spark, d):
    return records.extract_product(fx.product_pages(spark, d))


@query
def next_links(spark, d):
    return records.find_next(fx.next_pages(spark, d))


@query
def html_tables(spark, d):
    tables = records.extract_tables(fx.table_pages(spark, d))
    return tables.select(
        "page_id", "table_no", "caption", F.array_join("header", "|").alias("header"),
        F.size("rows").alias("n_rows"),
    )


@query
def table_cells(spark, d):
    return records.table_cells(records.extract_tables(fx.table_pages(spark, d)))


@query
def extract_images(spark, d):
    return rows.extract_images(fx.faulty_pages(spark, d))


# ---------------------------------------------------------------- rules


@query
def qa_rows(spark, d):
    # Fifteen of a kind and a count of the rest is the report that this query is.
    return no_pos(whole.qa_rows(fx.faulty_pages(spark, d), shown=15))


@query
def qa_elements(spark, d):
    return no_pos(whole.qa_elements(fx.faulty_pages(spark, d)))


@query
def qa_items(spark, d):
    return no_pos(whole.qa_items(fx.faulty_listing(spark, d)))


@query
def qa_faulty_header(spark, d):
    return no_pos(whole.qa_header(fx.faulty_pages(spark, d)))


@query
def qa_issues(spark, d):
    issues = whole.qa_issues(fx.faulty_pages(spark, d), item_selector="div")
    return issues.groupBy("page_id", "severity", "check").agg(F.count("*").alias("n"))


@query
def strict_gate(spark, d):
    return classify.strict_gate(whole.qa_header(fx.faulty_pages(spark, d)))


@query
def sorted_issues(spark, d):
    return no_pos(summary.sort_issues(whole.qa_header(fx.faulty_pages(spark, d))))


# ---------------------------------------------------------------- duplicates, completeness


def _repeat_items(spark, d):
    return records.extract_items(fx.catalog_repeats(spark, d))


@query
def dedupe_items(spark, d):
    return dedupe.dedupe_items(stored(_repeat_items(spark, d), "items"))


@query
def dedupe_stats(spark, d):
    return dedupe.dedupe_stats(_repeat_items(spark, d))


@query
def completeness(spark, d):
    items = dedupe.with_fingerprint(records.extract_items(fx.faulty_listing(spark, d)))
    return summary.completeness(items, whole.qa_header(fx.faulty_listing(spark, d)))


@query
def quality_summary(spark, d):
    return summary.quality_summary(completeness(spark, d))


# ---------------------------------------------------------------- runs


def _catalog_run(spark, d):
    return whole.extract_pages(fx.catalog_pages(spark, d))


@query
def extract_pages(spark, d):
    return _catalog_run(spark, d).select(
        "page_id", "title", "description", "lang", "selector", "next_url",
        F.size("candidates").alias("n_candidates"),
    )


@query
def page_metrics(spark, d):
    return summary.page_metrics(_catalog_run(spark, d))


@query
def run_counts(spark, d):
    return summary.run_counts(_catalog_run(spark, d))


@query
def run_meta(spark, d):
    """Needs no family of rows, so none is worked out."""
    run = whole.extract_pages(fx.catalog_pages(spark, d), families=())
    return summary.run_meta(run, mode="crawl").drop("when", "secs")


@query
def run_documents(spark, d):
    docs = writers.run_documents(_catalog_run(spark, d))
    price = F.get_json_object("document", "$.items[0].price")
    return docs.select(
        "page_id",
        F.get_json_object("document", "$.meta.title").alias("title"),
        price.alias("price"),
    )


@query
def saved_tables(spark, d):
    """Page rows stored once; links and items are then read from the stored columns."""
    stored = writers.save_extracted(_catalog_run(spark, d), new_folder(spark, "run"))
    tables = writers.run_tables(stored)
    items = tables["items"].groupBy("page").agg(F.count("*").alias("items"), F.max("idx").alias("last"))
    nav = tables["links"].groupBy("page").agg(F.count("*").alias("links"))
    return items.join(nav, "page")


@query
def csv_round_trip(spark, d):
    """Items written as CSV and read back with their types."""
    path = new_folder(spark, "csv") + "/items.csv"
    writers.write_csv(records.extract_items(fx.catalog_pages(spark, d)), path)
    schema = "page_id bigint, `index` int, title string, price string, link string, image string, text string"
    return readers.read_report_csv(spark, path, schema)


@query
def sink_rows(spark, d):
    return writers.sink_row(dedupe.dedupe_items(_repeat_items(spark, d)))


@query
def jsonl_round_trip(spark, d):
    """Items written as JSON lines and read back."""
    path = new_folder(spark, "jsonl")
    items = records.extract_items(fx.catalog_pages(spark, d))
    writers.write_jsonl(items, path)
    return spark.read.schema(items.schema).json(path)


@query
def document_files(spark, d):
    """A JSON document for each page, written with the export and parsed again item by item."""
    run = writers.save_extracted(_catalog_run(spark, d), new_folder(spark, "run"))
    path = new_folder(spark, "export")
    writers.export_all(run, path, {"json"})
    item = "struct<`index`: int, title: string, price: string, link: string, image: string, text: string>"
    parsed = F.from_json("document", f"items array<{item}>")
    return spark.read.schema("page_id bigint, document string").json(f"{path}/run.json").select("page_id", F.inline(parsed["items"]))


@query
def catalog_tables(spark, d):
    """The tables of a run saved in the catalog, twice, and counted there."""
    run = writers.save_extracted(_catalog_run(spark, d), new_folder(spark, "run"))
    database = f"run_{uuid.uuid4().hex}"
    spark.sql(f"create database {database} location '{new_folder(spark, 'database')}'")
    for _ in range(2):
        writers.save_tables(run, summary.run_meta(run), database)
    names = ["items", "links", "images", "headings", "qa_issues", "run_meta"]
    counts = [spark.table(f"{database}.{n}").agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in names]
    counted = stored(functools.reduce(DataFrame.unionByName, counts), "counts")
    spark.sql(f"drop database {database} cascade")
    return counted


@query
def table_files(spark, d):
    """Cells of all HTML tables written as CSV and read back."""
    path = new_folder(spark, "tables")
    writers.write_html_tables(records.extract_tables(fx.table_pages(spark, d)), path)
    cells = records.table_cells(records.extract_tables(fx.table_pages(spark, d)))
    back = readers.read_report_csv(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema))
    return back


@query
def pushed_rows(spark, d):
    """Items pushed twice in place of what was there, then added once more: the rows of two pushes."""
    path = new_folder(spark, "sink")
    items = stored(dedupe.with_fingerprint(records.extract_items(fx.catalog_pages(spark, d))), "items")
    pushes = [writers.push(items, path, mode) for mode in ("replace", "replace", "append")]
    rows = writers.pushed(spark, path).groupBy("fingerprint", "title").agg(F.count("*").alias("times"))
    return rows.withColumn("pushed", F.lit(pushes[-1]).cast("long"))


@query
def html_files(spark, d):
    """Every page written as a file of its own and read back by its path."""
    sources = writers.write_html_files(fx.pages(spark, d), new_folder(spark, "html"), "page_id")
    back = readers.read_html_files(spark, sources)
    page_id = F.regexp_extract("url", "-page_id=(-?[0-9]*)[.]html$", 1).try_cast("bigint")
    return rows.page_header(back.withColumn("page_id", page_id)).select("page_id", "title", "lang")


@query
def payload_files(spark, d):
    """Every payload written as a file of its own, read back and parsed."""
    sources = writers.write_payload_files(fx.json_payloads(spark, d), new_folder(spark, "payloads"), "payload_id")
    back = readers.read_payload_files(sources)
    payload_id = F.regexp_extract("source", "-payload_id=(-?[0-9]*)[.]json$", 1).try_cast("bigint").alias("payload_id")
    return payloads.items_from_json(back, "data.items[*]").select(payload_id, "index", "title", "price")


@query
def capped_json_items(spark, d):
    """The first seven items of each payload, which holds more."""
    return payloads.items_from_json(fx.json_payloads(spark, d), "data.items[*]", max_items=7).select("payload_id", "index", "title")


@query
def done_twice(spark, d):
    """Pages done in three batches, one of them written twice, and what is left to do."""
    path = new_folder(spark, "done")
    pages = fx.table(spark, d, "pages").select("page_id", "url", F.lit("").alias("next_url"))
    for batch in (0, 1, 1, 2):
        incremental.mark_done(pages.where(F.col("page_id") % 4 == batch), path, batch_id=batch)
    done, bits = incremental.done_pages(spark, path), incremental.done_bits(spark, path)
    left = incremental.pending_pages(pages, done, bits=bits)
    counted = done.groupBy("url").agg(F.count("*").alias("times"), F.lit(True).alias("done"))
    return counted.unionByName(left.groupBy("url").agg(F.count("*").alias("times"), F.lit(False).alias("done")))


@query
def manifest(spark, d):
    run = writers.save_extracted(_catalog_run(spark, d), new_folder(spark, "run"))
    path = new_folder(spark, "export")
    writers.export_all(run, path, {"jsonl"})
    files = writers.manifest_files(spark, path)
    found = writers.manifest(summary.run_meta(run), summary.run_counts(run), files)
    return found.select(
        F.col("meta.url").alias("url"),
        F.col("counts")["items"].alias("items"),
        F.col("counts")["links"].alias("links"),
        "schema_version",
        (F.col("files.n") > 0).alias("has_files"),
    )


def _finished(spark, d):
    run = writers.save_extracted(whole.extract_pages(fx.catalog_repeats(spark, d)), new_folder(spark, "run"))
    hrefs = links.link_candidates(whole.family(run, "links")).select("href")
    return run, finish.finished_run(run, fx.answers(hrefs))


@query
def finished_run(spark, d):
    """Counts of a run with link checks, its repeated items gone, and issues of broken links."""
    return finish.finished_counts(*_finished(spark, d))


@query
def finished_items(spark, d):
    return _finished(spark, d)[1]["items"]


@query
def manifest_folders(spark, d):
    """The folders of an export, from the places of its files."""
    run = writers.save_extracted(_catalog_run(spark, d), new_folder(spark, "run"))
    path = new_folder(spark, "export")
    writers.export_all(run, path, {"csv", "jsonl", "json", "tables"})
    files = writers.manifest_files(spark, path).where("file not like '%.crc'")
    return files.select(F.regexp_extract("file", "^(.*)/[^/]+$", 1).alias("folder")).distinct()


@query
def report_filter(spark, d):
    return classify.report_filter(records.extract_items(fx.catalog_pages(spark, d)), "BRAND#1")


@query
def report_sort(spark, d):
    items = records.extract_items(fx.catalog_pages(spark, d))
    return summary.report_sort(items, "price", ascending=False).select("page_id", "index", "price")


@query
def report_order(spark, d):
    """Items by falling price, with their place."""
    items = stored(records.extract_items(fx.catalog_pages(spark, d)), "items")
    return summary.with_place(summary.report_sort(items, "price", ascending=False)).select("place", "page_id", "index")


@query
def report_title_order(spark, d):
    """Items in natural order of titles that end in a number."""
    items = stored(records.extract_items(fx.catalog_pages(spark, d)), "items")
    titles = items.withColumn("title", F.regexp_extract("title", r"no\. \d+$", 0))
    return summary.with_place(summary.report_sort(titles, "title")).select("place", "page_id", "index", "title")


@query
def issue_order(spark, d):
    """Issues from High to Low, with their place."""
    issues = stored(whole.qa_header(fx.faulty_pages(spark, d)), "issues")
    return summary.with_place(summary.sort_issues(issues)).select("place", "page_id", "severity", "check")


@query
def preview_images(spark, d):
    """The first 500 pictures that a report shows."""
    images = whole.family(whole.extract_pages(fx.catalog_pages(spark, d), families=["images"]), "images")
    return summary.preview(images, "images").select("page_id", "src", "alt")


@query
def preview(spark, d):
    return summary.preview(records.extract_items(fx.catalog_pages(spark, d)), "items")


# ---------------------------------------------------------------- JSON


@query
def json_items(spark, d):
    return payloads.items_from_json(fx.json_payloads(spark, d), "data.items[*]")


@query
def json_mapped_items(spark, d):
    names = {"title": "meta.level", "price": "cost", "text": "meta.n", "image": "none"}
    return payloads.items_from_json(fx.json_payloads(spark, d), "data.items", names)


@query
def json_field_map(spark, d):
    return payloads.json_field_map(fx.json_payloads(spark, d), "data.items")


@query
def json_path_values(spark, d):
    """A key of every object of a list met on the way."""
    values = payloads.json_path(payloads.try_json(F.col("body")), "data.items.meta")
    found = fx.json_payloads(spark, d).select("payload_id", F.explode(values).alias("v"))
    return found.groupBy("payload_id").agg(
        F.count("*").alias("n"), F.sum(F.variant_get("v", "$.n", "bigint")).alias("total")
    )


@query
def event_items(spark, d):
    """Items from the events' own JSON; their one key is no field name."""
    events = fx.table(spark, d, "events").select("event_id", "props")
    return payloads.items_from_json(events, "", {"title": "k"}, body="props").select(
        "event_id", "index", "title"
    )


@query
def reply_items(spark, d):
    return payloads.items_from_reply(fx.model_replies(spark, d))


# ---------------------------------------------------------------- links, sites, graphs


@query
def check_links(spark, d):
    found = rows.extract_links(fx.pages(spark, d))
    return links.check_links(found, fx.link_responses(spark, d))


@query
def broken_links(spark, d):
    return links.broken_links(fx.link_responses(spark, d))


@query
def link_candidates(spark, d):
    return links.link_candidates(rows.extract_links(fx.pages(spark, d)), external=True)


@query
def first_link_candidates(spark, d):
    return links.link_candidates(rows.extract_links(fx.pages(spark, d)), n=100)


@query
def crawlable_links(spark, d):
    return links.crawlable_links(rows.extract_links(fx.pages(spark, d)))


@query
def robots_filter(spark, d):
    urls = fx.table(spark, d, "pages").select("page_id", "url")
    return classify.robots_allows(urls, fx.robots(spark, d)).select("page_id", "allowed")


@query
def crawl_site(spark, d):
    edges, fetched = fx.site_graph(spark, d)
    return crawl.crawl(fx.SITE + "0", edges, fetched)


@query
def paginate(spark, d):
    chain = fx.next_chain(spark, d)
    return crawl.paginate(chain.select("url"), chain)


@query
def page_signals(spark, d):
    return classify.page_signals(fx.audit_pages(spark, d)).drop("url")


@query
def verdicts(spark, d):
    signals = classify.page_signals(fx.audit_pages(spark, d))
    allowed = signals.withColumn("allowed", F.col("page_id") % 7 != 6)
    return classify.verdict(allowed).select("page_id", "verdict", "reason")


# ---------------------------------------------------------------- incremental, errors


@query
def pending_pages(spark, d):
    pages = fx.table(spark, d, "pages").select("page_id", "url")
    done = fx.table(spark, d, "pages").where(F.length("url") % 2 == 0).select("url")
    return incremental.pending_pages(pages, done)


@query
def latest_by_key(spark, d):
    events = fx.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return incremental.latest_by_key(events, "user_id", ["event_id"])


@query
def upsert_users(spark, d):
    """The last event of every user; those of odd id come as updates and go before the others."""
    events = fx.table(spark, d, "events").select("user_id", "event_id", "event_type")
    first = incremental.latest_by_key(events.where("event_id % 2 = 0"), "user_id", ["event_id"])
    return incremental.upsert(first, events.where("event_id % 2 <> 0"), "user_id", ["event_id"])


@query
def stream_dedupe(spark, d):
    schema = fx.table(spark, d, "events").schema
    events = live.stream_files(spark, d, schema, "events.parquet")
    items = events.select(
        "ts",
        fx.text("https://e.example.com/u/", F.col("user_id"), "?e=", F.col("event_id")).alias("link"),
        *[F.lit("").alias(c) for c in ("image", "title", "price", "text")],
        F.col("event_id").alias("page_id"),
        F.lit(1).alias("index"),
    )
    found = live.drain(live.stream_dedupe(items, "ts", "1 day"), "dedupe")
    return live.settled(found).select("fingerprint", "page_id")


@query
def map_with_errors(spark, d):
    def double(row: dict) -> str:
        k = json.loads(row["props"])["k"]
        if k % 10 == 0:
            raise ValueError("round number")
        return str(2 * k)

    events = fx.table(spark, d, "events").select("event_id", "props")
    return guarded.map_with_errors(events, double).select("event_id", "result", "error")


@query
def skip_bad_rows(spark, d):
    def positive(row: dict) -> float:
        return 1 / (row["event_id"] % 4)

    events = fx.table(spark, d, "events").select("event_id")
    return guarded.skip_bad_rows(guarded.map_with_errors(events, positive, "double"))
